"""Handover shares, code conflicts between neighbours and missing relations."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.maps import map_columns
from netquarry.functions.numeric import angle_gap, distance_m
from netquarry.functions.text import target_cell_id, text_before
from netquarry.operators.aggregates import share_of_total
from netquarry.operators.filters import Members, in_sites, maybe_member, probable_members, site_part, trailing_days
from netquarry.operators.joins import join_within_angle, missing_relations, neighbour_pairs, suffixed
from netquarry.operators.snapshots import Snapshots, latest_snapshot, one_per_key
from netquarry.plans.views import History, newest_sites
from netquarry.session import resolved

# Parameters read from the two cell classes.
CELL_PARAMETERS = {"name": "LNCEL_Name", "phyCellId": "phyCellId", "eutraCelId": "eutraCelId"}
CARRIER_PARAMETERS = ["earfcnDL", "rootSeqIndex", "prachCS", "prachFreqOff", "prachConfIndex"]


def lte_cells(cm: Snapshots, columns: Sequence[str] | None = None) -> DataFrame:
    """Current cells with their carrier settings, from the two configuration classes.

    Several audits of a run, and each of them more than once, read them, so they are resolved to a file.
    ``columns`` are those that the run needs; no others are shuffled and written.
    """
    ids = map_columns("ids", {"LNCEL": "LNCEL_id", "LNBTS": "LNBTS_id"})
    cells = latest_snapshot(cm, "LNCEL").select(
        *ids, "mo_distname", *map_columns("parameters", CELL_PARAMETERS)
    )
    carriers = latest_snapshot(cm, "LNCEL_FDD").select(
        *ids, *map_columns("parameters", CARRIER_PARAMETERS)
    )
    found = cells.join(carriers, on=["LNCEL_id", "LNBTS_id"])
    return resolved(found if columns is None else found.select(*columns), "lte-cells")


def site_adjacency(cm: Snapshots, sites: Members | None = None) -> DataFrame:
    """Sites and their current adjacent sites.

    Those of all sites are resolved to a file.  The newest day and its rows then come from one shuffle of the
    relations; with the conditions of a later join on the rows alone, they would be computed twice.  Those of
    chosen sites are left to the reader, whose conditions go in front of the join with the sites.
    """
    # Single values go through the join with the sites, not whole maps.
    current = latest_snapshot(cm, "LNADJ").select(
        "mo_distname", *map_columns("ids", {"LNBTS": "LNBTS_id"}), *map_columns("parameters", ["adjEnbId"])
    )
    if sites is None:
        return resolved(current.drop("mo_distname"), "site-adjacency")
    return in_sites(current, "mo_distname", sites).drop("mo_distname")


def handover_share(
    handovers: DataFrame,
    site_history: History,
    cells: DataFrame,
    today: str | date,
    days: int = 3,
    sites: Members | None = None,
    dedupe: list[str] | None = None,
) -> DataFrame:
    """Share of a cell's handover attempts that goes to each target cell, in whole percent.

    ``dedupe`` names the key of a counter row where the store may hold copies of it.
    """
    recent = trailing_days(handovers, "measTime", days, today)
    current = newest_sites(site_history).select(
        "sector_name", F.col("moDistName").alias("distName")
    )
    by_name = isinstance(sites, DataFrame) and not dedupe
    if by_name:
        # The cells, which are fewer than their counters, are joined with the sites.  A bitmap keeps most
        # counters of other sites out of the shuffle.
        recent = probable_members(recent, site_part("distName"), sites.select(F.col(f"`{sites.columns[0]}`").cast("string")))
        current = in_sites(current, "distName", sites)
    elif sites is not None:
        recent = in_sites(recent, "distName", sites)
    if dedupe:
        recent = one_per_key(recent, dedupe)
    attempts = recent.where(F.col("M8015C8") > 0).select(
        "distName", target_cell_id("extendedDistName").alias("ECI"), "M8015C8"
    )
    # Attempts are summed per pair of names before the site view is joined in, so the join sees one
    # row per neighbour instead of one per interval.  Counters of a large set of sites are dealt by name once,
    # for the sums and the view.  Records of a cell that tie are counted, so that the sums need not be grouped
    # again.  Rows and totals of the share read the sums from a file, so counters and sites are scanned once.
    if by_name:
        parts = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        attempts = attempts.repartition(parts, "distName")
    named = current.repartition("distName").groupBy("sector_name", "distName").agg(F.count("*").alias("records"))
    per_pair = resolved(
        attempts.groupBy("distName", "ECI")
        .agg(F.sum("M8015C8").cast("bigint").alias("attempts"))
        .join(named, on="distName")
        .select("sector_name", "ECI", (F.col("attempts") * F.col("records")).alias("INTER_HO_ATT_NB")),
        "handover-pairs",
    )
    targets = cells.where(F.col("eutraCelId").isNotNull()).select(
        F.col("eutraCelId").alias("target"), F.col("LNCEL_Name").alias("LNCEL_Name_tgt")
    )
    # A pair without a target id counts in the total only.  Totals come last, so that the rows stay dealt by
    # the cell that a reader joins next.
    known = per_pair.join(targets, F.col("ECI") == F.col("target"))
    shares = share_of_total(known, ["sector_name"], "INTER_HO_ATT_NB", "Total_ATT", "Share", of=per_pair)
    return shares.select(
        F.col("sector_name").alias("LNCEL_Name"),
        "LNCEL_Name_tgt",
        "INTER_HO_ATT_NB",
        "Total_ATT",
        "Share",
    )


def audit_code_conflicts(
    cells: DataFrame,
    site_history: History,
    adjacency: DataFrame,
    ho_share: DataFrame,
    code: str,
    min_share: float,
    as_of: str | date | None = None,
) -> DataFrame:
    """Neighbours on adjacent sites with equal carrier and equal ``code`` and enough handovers.

    The pairs are found by the names and settings of their cells alone.  Then the cells that are in conflict,
    and no others, are placed; they are both ends of a pair and are resolved once for them.
    """
    settings = ["LNBTS_id", "LNCEL_Name", "earfcnDL", code]
    pairs = ho_share.where(F.col("Share") >= min_share).select(
        F.col("LNCEL_Name").alias("LNCEL_Name_Orig"),
        F.col("LNCEL_Name_tgt").alias("LNCEL_Name_Dest"),
        "Share",
    )
    # Cells alike in all of these are one here, and all of them again when they are placed.  They are dealt
    # by name, which is what both ends are joined by.
    alike = cells.select(*settings).repartition("LNCEL_Name").distinct()
    found = resolved(neighbour_pairs(pairs, alike, adjacency, code, sift=True), "conflicts")
    ends = [F.col(f"LNCEL_Name{end}").alias("name") for end in ("_Orig", "_Dest")]
    named = found.select(ends[0]).union(found.select(ends[1]))
    concerned = cells.where(maybe_member(F.col("LNCEL_Name"), named)).select("mo_distname", *settings)
    positions = newest_sites(site_history, as_of=as_of).select(
        F.col("moDistName").alias("mo_distname"), "site_name", "latitud", "longitud"
    )
    if positions.schema["mo_distname"].dataType == concerned.schema["mo_distname"].dataType:
        positions = positions.where(maybe_member(F.col("mo_distname"), concerned.select("mo_distname")))
    placed = resolved(concerned.join(positions, on="mo_distname").drop("mo_distname"), "placed-cells")
    for end in ("_Orig", "_Dest"):
        found = found.join(suffixed(placed, end), on=[f"{column}{end}" for column in settings])
    return found.select(
        "site_name_Orig",
        "LNCEL_Name_Orig",
        "LNCEL_Name_Dest",
        F.col(f"{code}_Orig").alias(code),
        "Share",
        distance_m("latitud_Orig", "longitud_Orig", "latitud_Dest", "longitud_Dest").alias(
            "distance_m"
        ),
    )


def audit_missing_relations(
    lte_sites: History,
    umts_sites: History,
    cm: Snapshots,
    sites: Members,
    tolerance: float = 20,
    as_of: str | date | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Co-located cells of two technologies with no configured relation; ``(summary, detail)``.

    The summary counts the missing pairs of a site without forming them: expected pairs are products
    of the cells per bearing, and the relations that are configured as expected are taken off.
    """

    def current(history: History, suffix: str) -> DataFrame:
        view = newest_sites(history, as_of=as_of)
        return view.select(
            F.col("moDistName").alias(f"mo_distname{suffix}"),
            F.col("sector_name").alias(f"sector_name{suffix}"),
            "site_name",
            F.col("azimuth").alias(f"azimuth{suffix}"),
        )

    sources = in_sites(current(lte_sites, "_src"), "mo_distname_src", sites)
    targets = current(umts_sites, "_tgt")
    expected = join_within_angle(
        sources, targets, "site_name", "azimuth_src", "azimuth_tgt", tolerance
    )
    configured = latest_snapshot(cm, "LNRELW").select(
        "mo_distname", *map_columns("parameters", {"targetCellDn": "mo_distname_tgt"})
    )
    relations = in_sites(configured, "mo_distname", sites).select(
        text_before("mo_distname", "LNRELW", back=1).alias("mo_distname_src"), "mo_distname_tgt"
    )
    detail = missing_relations(expected, relations, ["mo_distname_src", "mo_distname_tgt"])

    def per_bearing(cells: DataFrame, side: str) -> DataFrame:
        return cells.groupBy("site_name", f"azimuth_{side}").agg(F.count("*").alias(f"n_{side}"))

    wanted = (
        join_within_angle(
            per_bearing(sources, "src"),
            per_bearing(targets, "tgt"),
            "site_name",
            "azimuth_src",
            "azimuth_tgt",
            tolerance,
        )
        .groupBy("site_name")
        .agg(F.sum(F.col("n_src") * F.col("n_tgt")).alias("wanted"))
    )
    present = (
        relations.distinct()
        .join(sources, on="mo_distname_src")
        .join(targets, on=["mo_distname_tgt", "site_name"])
        .where(angle_gap("azimuth_src", "azimuth_tgt") <= tolerance)
        .groupBy("site_name")
        .agg(F.count("*").alias("present"))
    )
    summary = (
        wanted.join(present, on="site_name", how="left")
        .withColumn("sector_name_tgt", F.col("wanted") - F.coalesce("present", F.lit(0)))
        .where(F.col("sector_name_tgt") > 0)
        .select("site_name", "sector_name_tgt")
    )
    return summary, detail
