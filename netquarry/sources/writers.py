"""Sinks.  All of them write from the executors; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_audit(
    parts: Mapping[str, DataFrame], folder: str, file_format: str = "csv"
) -> dict[str, str]:
    """Write the frames of an audit (such as summary and detail) below ``folder``; returns paths."""
    paths = {}
    for name, frame in parts.items():
        paths[name] = f"{folder}/{name}"
        writer = frame.write.mode("overwrite")
        (writer.option("header", True) if file_format == "csv" else writer).format(
            file_format
        ).save(paths[name])
    return paths


def write_report(
    report: DataFrame,
    path: str,
    sort_keys: Sequence[str],
    file_format: str = "parquet",
    partitions: int | None = None,
) -> None:
    """Write a report in global order of ``sort_keys``.

    Rows are range partitioned on the keys and sorted inside each file, so files in name order give
    the sorted report.  All sort keys take part in the ranges: many rows with the same first key
    (one element with a third of all periods) still spread over several files.
    """
    keys = [F.col(f"`{k}`") for k in sort_keys]
    ranged = (
        report.repartitionByRange(partitions, *keys)
        if partitions
        else report.repartitionByRange(*keys)
    )
    writer = ranged.sortWithinPartitions(*keys).write.mode("overwrite")
    (writer.option("header", True) if file_format == "csv" else writer).format(file_format).save(
        path
    )


def write_class_tables(
    tables: Mapping[str, DataFrame],
    target: str,
    as_tables: bool = False,
    parallel: int = 4,
) -> list[str]:
    """Write one table per name, replacing what was there.

    With ``as_tables`` the target is a database, else a folder with one parquet folder per name.
    Small classes leave most of a cluster idle, so a few writes are in flight at a time.
    """

    def write_one(item: tuple[str, DataFrame]) -> str:
        name, frame = item
        writer = frame.write.mode("overwrite")
        if as_tables:
            writer.saveAsTable(f"{target}.{name}")
        else:
            writer.parquet(f"{target}/{name}")
        return name

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(write_one, tables.items()))


def write_csv_export(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def bundle_audits(
    audits: Mapping[str, DataFrame | Callable[[], DataFrame]],
) -> tuple[DataFrame | None, dict[str, str]]:
    """Gather audits of different shapes as rows ``(audit, row as JSON)``.

    An audit may be a function; one that raises while its plan is built is left out and reported in
    the second value.  Each name appears once.  The bundle is one plan, so an audit that fails in a task
    fails all of it; :func:`deliver_audits` writes them one by one.
    """
    gathered: DataFrame | None = None
    skipped: dict[str, str] = {}
    for name, audit in audits.items():
        try:
            frame = audit() if callable(audit) else audit
            rows = _json_rows(frame).select(F.lit(name).alias("audit"), "row")
        except Exception as error:  # the other audits must still be delivered
            skipped[name] = f"{type(error).__name__}: {error}"
            continue
        gathered = rows if gathered is None else gathered.unionByName(rows)
    return gathered, skipped


def deliver(
    parts: Mapping[str, DataFrame | Callable[[], DataFrame]],
    write: Callable[[str, DataFrame], object],
    parallel: int = 4,
) -> tuple[list[str], dict[str, str]]:
    """Write each deliverable by itself; returns the names that were delivered and what stopped the others.

    A part may be a function.  Whether it fails while its plan is built or in a task, the others are still
    written, a few at a time.
    """

    def attempt(name: str) -> str | None:
        part = parts[name]
        try:
            write(name, part() if callable(part) else part)
        except Exception as error:  # the others must still be delivered
            return f"{type(error).__name__}: {error}"
        return None

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        outcome = dict(zip(parts, pool.map(attempt, parts), strict=True))
    return [n for n, error in outcome.items() if error is None], {n: e for n, e in outcome.items() if e is not None}


def deliver_audits(
    audits: Mapping[str, DataFrame | Callable[[], DataFrame]], path: str, parallel: int = 4
) -> tuple[list[str], dict[str, str]]:
    """Write the audits of a run as one bundle of rows ``(audit, row as JSON)``, each judged by itself."""

    def write(name: str, frame: DataFrame) -> None:
        _json_rows(frame).write.mode("overwrite").parquet(f"{path}/audit={name}")

    return deliver(audits, write, parallel)


def _json_rows(frame: DataFrame) -> DataFrame:
    whole = F.struct(*[F.col(f"`{c}`") for c in frame.columns])
    return frame.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("row"))


def write_bundle(bundle: DataFrame, path: str) -> None:
    bundle.write.mode("overwrite").partitionBy("audit").parquet(path)
