"""Audits of the area codes (TAC and LAC) configured per site."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.maps import map_columns
from netquarry.functions.text import text_before
from netquarry.operators.aggregates import multi_valued
from netquarry.operators.filters import Members, members
from netquarry.operators.joins import equi_join
from netquarry.operators.snapshots import Snapshots, latest_snapshot
from netquarry.plans.views import History, newest_sites, shared
from netquarry.session import resolved

# Fixed value: the status, and the filler of missing codes, of a pair not seen elsewhere.
NOT_OK = "NO-OK"
_CELL_COLUMNS = ("moDistName", "sector_name", "site_name", "longitud", "latitud")


def current_cells(site_history: History, as_of: str | date | None = None) -> DataFrame:
    """Current cells with ``parent``, the DN of their site."""
    return (
        newest_sites(site_history, as_of=as_of)
        .select(
            F.col("moDistName").alias("mo_distname"),
            "sector_name",
            "site_name",
            "longitud",
            "latitud",
        )
        .withColumn("parent", text_before("mo_distname", "LNCEL", back=1))
    )


def with_area_code(cells: DataFrame, cm: Snapshots, mo_class: str, parameter: str, name: str) -> DataFrame:
    """Cells with an area code from the newest snapshot, matched on DN and cell name."""
    codes = latest_snapshot(cm, mo_class).select(
        "mo_distname", *map_columns("parameters", {"name": "sector_name", parameter: name})
    )
    return cells.join(codes, on=["mo_distname", "sector_name"])


def _set_of(site_dns: Members, cells: DataFrame) -> DataFrame:
    """``parent, in_set`` of the sites in the set that have cells."""
    return members(cells.select("parent").distinct(), "parent", site_dns).withColumn("in_set", F.lit(True))


def evaluated_sites(cells: DataFrame, site_dns: Members) -> DataFrame:
    return members(cells, "parent", site_dns).select("site_name").distinct()


def audit_multi_tac(
    lte_sites: History, cm: Snapshots, site_dns: Members, as_of: str | date | None = None
) -> DataFrame:
    """Sites of the set that carry more than one area code."""
    coded = with_area_code(current_cells(lte_sites, as_of), cm, "LNCEL", "tac", "TAC")
    found = multi_valued(members(coded, "parent", site_dns), "site_name", "TAC")
    return found.withColumnsRenamed({"count": "TAC_count", "nunique": "TAC_nunique"})


def audit_tac_lac(
    lte_sites: History,
    umts_sites: History,
    cm: Snapshots,
    site_dns: Members,
    as_of: str | date | None = None,
) -> DataFrame:
    """Whether the (TAC, LAC) pairs of the evaluated sites also occur at any other site.

    A site known at several positions gives a row for each of them.  The coded cells and the network of
    pairs are resolved once; sites are flagged, and a partial count per pair tells which occur elsewhere.
    """
    lte, umts = current_cells(shared(lte_sites, _CELL_COLUMNS), as_of), current_cells(umts_sites, as_of)
    # Whether any cell of a site is in the set; cells without an area code count too.
    marked = lte.join(_set_of(site_dns, lte), on="parent", how="left")
    evaluated = marked.groupBy("site_name").agg(F.max(F.coalesce("in_set", F.lit(False))).alias("evaluated"))
    coded = with_area_code(lte, cm, "LNCEL", "tac", "TAC")
    places = resolved(
        coded.select("site_name", "TAC", "longitud", "latitud").distinct().join(evaluated, on="site_name"), "tac-sites"
    )
    lac = with_area_code(umts, cm, "WCEL", "LAC", "LAC").select("site_name", "LAC").distinct()
    pairs = places.select("site_name", "TAC", "evaluated").distinct().join(lac, on="site_name")
    network = resolved(pairs, "area-pairs")
    elsewhere = (
        network.where(~F.col("evaluated")).groupBy("TAC", "LAC").agg(F.lit("OK").alias("Status"))
    )
    judged = equi_join(
        network.where("evaluated").drop("evaluated"), elsewhere, ["TAC", "LAC"], how="left", null_safe=True
    ).na.fill(NOT_OK, subset=["TAC", "LAC", "Status"])
    positions = places.where("evaluated").select("site_name", "longitud", "latitud").distinct()
    return judged.join(positions, on="site_name").select("site_name", "TAC", "LAC", "Status")
