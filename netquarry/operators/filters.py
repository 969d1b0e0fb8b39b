"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.dates import as_date
from netquarry.functions.text import ColumnLike, as_column

Members = DataFrame | Sequence[str]


def _member_keys(members: DataFrame, name: str) -> DataFrame:
    return members.select(F.col(f"`{members.columns[0]}`").alias(name))


def members(df: DataFrame, column: str, wanted: Members) -> DataFrame:
    """Rows whose ``column`` is in the working set: a list or the first column of a frame.

    A list becomes literals in the plan, a frame a semi-join; pass a long set as a frame.
    """
    if isinstance(wanted, DataFrame):
        return df.join(_member_keys(wanted, column), on=column, how="left_semi")
    return df.where(F.col(column).isin(list(wanted)))


def not_members(df: DataFrame, column: str, unwanted: Members) -> DataFrame:
    """Rows whose ``column`` is not in the set; rows with a NULL there are kept."""
    if isinstance(unwanted, DataFrame):
        return df.join(_member_keys(unwanted, column), on=column, how="left_anti")
    return df.where(~F.coalesce(F.col(column).isin(list(unwanted)), F.lit(False)))


# Size of the bitmap in front of a join, in words of 64 bits: 1 MB of bits, whatever the names.
BITMAP_WORDS = 1 << 17


def _place(value: Column) -> Column:
    """The bit of the bitmap that stands for a value."""
    return F.pmod(F.xxhash64(value), F.lit(64 * BITMAP_WORDS))


def _marks(wanted: DataFrame) -> DataFrame:
    """One row ``__word, __bits`` per value in the first column of ``wanted``."""
    name = F.col(f"`{wanted.columns[0]}`")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("__place", F.lit(64)).cast("int"))
    places = wanted.where(name.isNotNull()).select(_place(name).alias("__place"))
    return places.select(F.shiftright("__place", 6).alias("__word"), one.alias("__bits"))


def _bit(bits: Column, place: Column) -> Column:
    shifted = F.call_function("shiftright", bits, F.pmod(place, F.lit(64)).cast("int"))
    return shifted.bitwiseAND(F.lit(1))


def probable_members(df: DataFrame, column: Column, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be among the first column of ``wanted``; no member is lost.

    Stands below a join that shuffles ``df``, so that rows without a partner are not shuffled.  The names
    are hashed into a bitmap of fixed size, so it may be broadcast however many names there are; a row
    that only shares a bit passes and is left to the join.
    """
    words = _marks(wanted).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    own = _place(column)
    return (
        df.join(F.broadcast(words), F.shiftright(own, 6) == F.col("__word"))
        .where(column.isNotNull() & (_bit(F.col("__bits"), own) == 1))
        .drop("__word", "__bits")
    )


def maybe_member(column: Column, wanted: DataFrame) -> Column:
    """Whether ``column`` may be among the first column of ``wanted``: the bitmap as a condition.

    It is a scalar subquery, not a join, so Spark moves it down through joins, ``distinct`` and projections
    of what is filtered, in front of their shuffles.
    """
    empty = wanted.sparkSession.range(BITMAP_WORDS).select(
        F.col("id").alias("__word"), F.lit(0).cast("long").alias("__bits")
    )
    words = _marks(wanted).unionByName(empty).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    in_order = F.array_sort(F.collect_list(F.struct("__word", "__bits")))
    bitmap = words.agg(in_order["__bits"].alias("bitmap")).scalar()
    own = _place(column)
    return _bit(F.get(bitmap, F.shiftright(own, 6).cast("int")), own) == 1


def site_part(dn: ColumnLike, depth: int = 3) -> Column:
    """The first ``depth`` parts of a DN; three of them name a site."""
    return F.substring_index(as_column(dn), "/", depth)


def in_sites(df: DataFrame, dn: str, sites: Members, depth: int = 3) -> DataFrame:
    """Rows whose object belongs to one of the site DNs, compared as whole DN parts."""
    key = "__site"
    return members(df.withColumn(key, site_part(dn, depth)), key, sites).drop(key)


def by_prefix(df: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """Rows whose ``column`` starts with one of the prefixes, taken literally (``-1`` fits ``-10``).

    Every distinct value is cut to the lengths that occur among the prefixes and matched by
    equality, so there is no pairwise comparison of values and prefixes.
    """
    wanted = _member_keys(prefixes, "__prefix").where(F.col("__prefix").isNotNull())
    lengths = wanted.agg(F.collect_set(F.length("__prefix")).alias("lengths")).scalar()
    matching = (
        df.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .select(column, F.explode(lengths).alias("__length"))
        .select(column, F.substring(F.col(column), F.lit(1), F.col("__length")).alias("__prefix"))
        .join(wanted, on="__prefix", how="left_semi")
        .select(column)
    )
    return df.join(matching, on=column, how="left_semi")


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any (of the given) columns."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def differs(actual: ColumnLike, expected: ColumnLike) -> Column:
    """True unless both values are present and equal: a NULL always counts as a deviation."""
    return ~F.coalesce(as_column(actual) == as_column(expected), F.lit(False))


def at_least(df: DataFrame, column: str, threshold: float | str) -> DataFrame:
    """``column >= threshold``; a text threshold names a per-row threshold column."""
    return df.where(F.col(column) >= _threshold(threshold))


def above(df: DataFrame, column: str, threshold: float | str) -> DataFrame:
    return df.where(F.col(column) > _threshold(threshold))


def _threshold(threshold: float | str) -> Column:
    return F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)


def trailing_days(df: DataFrame, ts: str, days: int, today: str | date) -> DataFrame:
    """Rows after the midnight ``days`` days before ``today`` (that instant itself is out)."""
    start = as_date(today) - timedelta(days=days)
    return df.where(F.col(ts) > F.lit(f"{start} 00:00:00").cast("timestamp"))


def between_days(df: DataFrame, day: str, start: str | date, end: str | date) -> DataFrame:
    """Rows from the first moment of ``start`` up to, and without, the day after ``end``."""
    after = as_date(end) + timedelta(days=1)
    low = F.lit(f"{as_date(start)} 00:00:00").cast("timestamp")
    high = F.lit(f"{after} 00:00:00").cast("timestamp")
    return df.where((F.col(day) >= low) & (F.col(day) < high))
