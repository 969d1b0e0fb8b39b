"""Directory of current cells and the cascade that narrows it down to a working set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.operators.filters import Members, drop_incomplete, members
from netquarry.plans.views import History, newest_sites

# Fixed value: the cluster of sites that belong to none.
NO_CLUSTER = "0"

# Where the cells of a selection come from.
MODES = ("set", "baseline", "intersection")


def site_directory(histories: Mapping[str, History]) -> DataFrame:
    """``site_name, sector_name, region, cluster, Technology`` of all current, complete cells.

    ``histories`` maps a technology tag to its site history.
    """
    branches = [
        newest_sites(history)
        .where(F.col("level_2") != NO_CLUSTER)
        .select(
            "site_name",
            "sector_name",
            F.col("level_1").alias("region"),
            F.col("level_2").alias("cluster"),
        )
        .distinct()
        .withColumn("Technology", F.lit(tag))
        for tag, history in histories.items()
    ]
    return drop_incomplete(reduce(DataFrame.unionByName, branches))


def choices(directory: DataFrame, column: str, min_length: int | None = None) -> DataFrame:
    """Sorted distinct values for a choice list; ``min_length`` asks for more characters than that."""
    values = directory.select(column).distinct()
    if min_length is not None:
        values = values.where(F.length(column) > min_length)
    return values.orderBy(column)


def within_cascade(
    directory: DataFrame,
    technology: str,
    region: str | None = None,
    cluster: str | None = None,
    site_names: Sequence[str] = (),
) -> DataFrame:
    """Directory rows below a region, a cluster of it and some of its sites."""
    rows = directory.where(F.col("Technology") == technology)
    if region is not None:
        rows = rows.where(F.col("region") == region)
    if cluster is not None:
        rows = rows.where(F.col("cluster") == cluster)
    return members(rows, "site_name", site_names) if site_names else rows


def select_cells(
    directory: DataFrame,
    technology: str,
    region: str | None = None,
    cluster: str | None = None,
    site_names: Sequence[str] = (),
    cells: Sequence[str] = (),
    working_set: Members | None = None,
    mode: str = "baseline",
) -> DataFrame:
    """Distinct ``sector_name`` of the selection.

    ``set`` takes the working set as it is, ``baseline`` the directory, ``intersection`` the
    directory cells that are in the working set.  Cells named one by one override the cascade.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {', '.join(MODES)}")
    if mode != "baseline" and working_set is None:
        raise ValueError(f"mode {mode!r} needs a working set")
    if mode == "set":
        if isinstance(working_set, DataFrame):
            return working_set.select(F.col(working_set.columns[0]).alias("sector_name")).distinct()
        rows = [(name,) for name in working_set]
        return directory.sparkSession.createDataFrame(rows, "sector_name string").distinct()
    base = directory if mode == "baseline" else members(directory, "sector_name", working_set)
    if cells:
        return members(base, "sector_name", cells).select("sector_name").distinct()
    return (
        within_cascade(base, technology, region, cluster, site_names)
        .select("sector_name")
        .distinct()
    )
