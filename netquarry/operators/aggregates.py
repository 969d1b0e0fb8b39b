"""Grouped aggregates, time roll-ups, shares and the split of KPIs by magnitude."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netquarry.functions.dates import local_bucket
from netquarry.functions.numeric import log_magnitude, percent
from netquarry.session import resolved


def grouped_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums per key; rows with a NULL key drop out and a sum over NULLs only is 0."""
    return (
        df.na.drop("any", subset=list(keys))
        .groupBy(*keys)
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    )


def scaled_means(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], divisor: float = 10, digits: int = 2
) -> DataFrame:
    """``round(avg(column) / divisor, digits)`` per key; ``columns`` maps source to result name."""
    return df.groupBy(*keys).agg(
        *[F.round(F.avg(c) / F.lit(divisor), digits).alias(name) for c, name in columns.items()]
    )


def column_minimums(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.min(f"`{c}`").alias(c) for c in columns])
    )


def multi_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value: ``key, count, nunique``.  NULL values do not count."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(value).alias("count"), F.count_distinct(value).alias("nunique"))
        .where(F.col("nunique") > 1)
    )


def disagreeing_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose rows disagree, with ``values`` (distinct, sorted) and ``counts`` beside them.

    The two arrays hold the same information as the list of all values.  They are built from counts
    per (key, value), so the size of a row depends on the distinct values only, not on how many
    rows a key has.
    """
    tallied = (
        df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(key, value)
        .agg(F.count("*").alias("n"))
    )
    pairs = F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col("n").alias("n"))))
    return (
        tallied.groupBy(key)
        .agg(pairs.alias("pairs"))
        .where(F.size("pairs") > 1)
        .select(key, F.col("pairs.v").alias("values"), F.col("pairs.n").alias("counts"))
    )


def with_group_total(
    df: DataFrame, group: Sequence[str], part: str, total: str, of: DataFrame | None = None
) -> DataFrame:
    """The sum of ``part`` over the group beside each row.

    Totals are a partial aggregate joined back, so a group with a large share of all rows is never
    gathered in one place as a window frame would.  ``of`` has the rows that count, if not those of ``df``.
    """
    totals = (df if of is None else of).groupBy(*group).agg(F.sum(part).alias(total))
    return df.join(totals, on=list(group))


def share_of_total(
    df: DataFrame,
    group: Sequence[str],
    part: str,
    total: str = "total",
    share: str = "share",
    of: DataFrame | None = None,
) -> DataFrame:
    """Whole percent (truncated) each row holds of its group's total; NULL if that is 0."""
    whole = with_group_total(df, group, part, total, of)
    truncated = F.expr(f"100 * cast(`{part}` as bigint) div cast(`{total}` as bigint)")
    return whole.withColumn(share, F.when(F.col(total) != 0, truncated))


def deviation_summary(
    totals: DataFrame, deviated: DataFrame, keys: Sequence[str], exclude_zero: bool = True
) -> DataFrame:
    """Join counts ``total`` and ``deviated`` per key and add the percentage ``deviation``.

    With ``exclude_zero`` keys without any deviation are left out.
    """
    joined = totals.join(deviated, on=list(keys), how="inner" if exclude_zero else "left")
    return joined.withColumn("deviated", F.coalesce("deviated", F.lit(0))).withColumn(
        "deviation", percent("deviated", "total")
    )


def time_rollup(
    df: DataFrame,
    unit: str,
    tz: str,
    element: Mapping[str, Column],
    aggregates: Mapping[str, Column | str],
    ts: str = "measTime",
    bucket: str = "measTime",
) -> DataFrame:
    """Aggregate per local time bucket and element.

    ``element`` names the grouping columns (empty for the whole set).  An aggregate is a column or
    the SQL text of one, such as a catalog formula; all of them share one pass.
    """
    grouped = df.groupBy(
        local_bucket(ts, unit, tz).alias(bucket), *[c.alias(n) for n, c in element.items()]
    )
    return grouped.agg(
        *[
            (F.expr(a) if isinstance(a, str) else a).alias(name)
            for name, a in aggregates.items()
        ]
    )


def offered_to_levels(
    df: DataFrame, levels: Mapping[str, Column], level: str = "level", element: str = "element"
) -> DataFrame:
    """Every row once per level, with the level's name and its element.

    Grouped by both, all levels are aggregated in one scan, and partial aggregates keep what is shuffled
    at one row per element.
    """
    offers = [F.struct(F.lit(name).alias(level), c.cast("string").alias(element)) for name, c in levels.items()]
    return df.select("*", F.inline(F.array(*offers)))


def split_kpis_by_scale(long: DataFrame, kpi: str = "KPI", value: str = "Value") -> DataFrame:
    """Add ``Cluster`` 0 or 1 by the magnitude of each KPI's maximum (0 is the smaller scale).

    The split is the two-means one.  On a line its clusters are the two sides of a cut, so every cut
    of the ordered magnitudes is scored from running sums and the best one taken: exact, repeatable
    and without iterations.  The window sees one row per KPI, as many as the catalog query asked for.
    Rows of KPIs without a value, or without a name, are cluster 0.  One KPI alone, or KPIs of one
    magnitude, are all cluster 0.  The input is evaluated once, into a file that both the magnitudes and
    the result are read from.
    """
    long = resolved(long, "kpi-rows")
    peaks = (
        long.where(F.col(kpi).isNotNull())
        .groupBy(kpi)
        .agg(F.max(F.col(value).cast("double")).alias("peak"))
        .where(F.col("peak").isNotNull())
        .select(kpi, log_magnitude("peak").alias("m"))
    )
    everything = Window.partitionBy()
    up_to_here = Window.orderBy("m").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below, below_sum = F.count("m").over(up_to_here), F.sum("m").over(up_to_here)
    above, above_sum = F.count("m").over(everything) - below, F.sum("m").over(everything) - below_sum
    # The smaller the spread within both sides, the larger this sum.
    score = below_sum * below_sum / below + F.try_divide(above_sum * above_sum, above)
    cut = F.max(F.when(F.col("score").isNotNull(), F.struct("score", "m"))).over(everything)
    labels = (
        peaks.withColumn("score", score)
        .withColumn("cut", cut["m"])
        .select(kpi, F.coalesce(F.col("m") > F.col("cut"), F.lit(False)).cast("int").alias("Cluster"))
    )
    return long.join(labels, on=kpi, how="left").na.fill(0, subset=["Cluster"])
