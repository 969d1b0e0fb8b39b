"""Incremental roll-up of interval counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.dates import local_bucket

# The window lengths a stream may ask for.
WINDOW_UNITS = ("hour", "day", "week")


def _until(instant: Column, close: Column) -> Column:
    """The interval from ``instant`` to ``close``."""
    left = (F.unix_micros(close) - F.unix_micros(instant)).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.make_interval(secs=left.cast("decimal(18,6)"))


def stream_rollup(
    counters: DataFrame,
    unit: str,
    element: Sequence[str],
    aggregates: Mapping[str, Column],
    copies_share: Sequence[str],
    ts: str = "measTime",
    tz: str = "UTC",
    delay: str = "1 hour",
) -> DataFrame:
    """Aggregate a stream of counter rows per local window and element, dropping repeated rows.

    Rows equal in ``copies_share`` (the time column among them) count once while they lie within
    ``delay``.  Event time and watermark are UTC instants, so the watermark trails by ``delay`` and no
    more in every zone; windows are hours, days and weeks of the wall clock of ``tz``.  A window of the
    wall clock has no fixed length in UTC, so it is a session whose gap runs, for each row, to the
    instant at which the row's window closes: all rows of a window share that end.  A day of 25 hours
    is one window, and so is an hour that clocks repeat, as in the batch roll-up.

    For append mode: a window is emitted once the watermark has reached its end.
    """
    if unit not in WINDOW_UNITS:
        raise ValueError(f"unit {unit!r} has no fixed length; use one of {', '.join(WINDOW_UNITS)}")
    instant, window = "__instant", "__window"
    known = counters.withColumn(instant, F.col(ts).cast("timestamp")).withWatermark(instant, delay)
    copy_key = [instant if name == ts else name for name in copies_share]
    unique = known.dropDuplicatesWithinWatermark(copy_key)
    placed = unique.withColumn(window, local_bucket(instant, unit, tz))
    close = F.to_utc_timestamp(F.col(window) + F.expr(f"interval 1 {unit}"), tz)
    session = F.session_window(instant, _until(F.col(instant), close)).alias("__open")
    grouped = placed.groupBy(session, window, *element).agg(*[a.alias(name) for name, a in aggregates.items()])
    return grouped.select(F.col(window).alias(ts), *element, *[F.col(name) for name in aggregates])
