"""Newest snapshot of a class, current record per key, one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class SnapshotStore(Protocol):
    """Snapshots whose days are known without reading them, such as :class:`netquarry.sources.Dump`."""

    def newest(self, mo_class: str | None = None) -> date | None: ...

    def rows(self, mo_class: str | None = None, day: str | date | None = None) -> DataFrame: ...


Snapshots = DataFrame | SnapshotStore


def newest_day(cm: DataFrame, mo_class: str | None = None) -> DataFrame:
    """One row ``last_date``: the newest snapshot day, of one class if given."""
    rows = cm if mo_class is None else cm.where(F.col("mo_class") == mo_class)
    return rows.agg(F.max("raml_date").alias("last_date"))


def latest_snapshot(cm: Snapshots, mo_class: str, dated_by: str | None = None) -> DataFrame:
    """Rows of ``mo_class`` on its newest day, or on the newest day of class ``dated_by``.

    A store knows its newest day, so the files of that day are the only ones that are listed and read.
    Of a plain frame the day is a scalar subquery, not a join: it is computed once and then prunes the
    date partitions of the scan at run time.
    """
    if not isinstance(cm, DataFrame):
        day = cm.newest(dated_by or mo_class)
        return cm.rows(mo_class, day) if day is not None else cm.rows(mo_class).limit(0)
    day = newest_day(cm, dated_by or mo_class)
    return cm.where((F.col("mo_class") == mo_class) & (F.col("raml_date") == day.scalar()))


def latest_per_key(
    history: DataFrame,
    keys: Sequence[str],
    ts: str,
    as_of: str | date | datetime | None = None,
) -> DataFrame:
    """Rows carrying the newest ``ts`` of their key; ties are all kept, NULL keys drop out.

    The history is read once, and every task keeps only the rows with the newest ``ts`` it has seen of a
    key (window group limit) before anything is shuffled.  A key that owns a large share of the history
    sends its newest rows per task; the ties of one key end in one task, which holds them on disk if
    they are many.  ``as_of`` looks only at rows up to that time.
    """
    past = history
    if as_of is not None:
        past = history.where(F.col(ts) <= F.lit(str(as_of)).cast(history.schema[ts].dataType))
    if not keys:
        return past.join(past.agg(F.max(ts).alias(ts)), on=ts, how="left_semi")
    ranking = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    position = "__position"
    others = [f"`{c}`" for c in history.columns if c not in (*keys, ts)]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, ts)])
    return (
        past.where(known)
        .withColumn(position, F.rank().over(ranking))
        .where(F.col(position) == 1)
        .select(*keys, ts, *others)
    )


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order``, then by every other column that can be ordered.

    Spark cuts each key to its best row before the shuffle (window group limit), so a key with very
    many copies sends one row per task.
    """
    sortable = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, T.MapType) and f.name not in keys and f.name not in order
    ]
    ranking = Window.partitionBy(*keys).orderBy(*order, *(sortable or ([] if order else keys)))
    position = "__position"
    return df.withColumn(position, F.row_number().over(ranking)).where(F.col(position) == 1).drop(
        position
    )
