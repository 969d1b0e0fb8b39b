"""Audits of received power, antenna tilt and the KPI history sheet."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.dates import as_date, week_of_year, weekday_name
from netquarry.functions.maps import map_columns
from netquarry.functions.numeric import port_mean, port_spread, row_max, success_product
from netquarry.functions.text import day_text
from netquarry.operators.aggregates import column_minimums, disagreeing_values, scaled_means
from netquarry.operators.columns import with_report_schema
from netquarry.operators.filters import (
    Members,
    above,
    at_least,
    differs,
    in_sites,
    members,
    trailing_days,
)
from netquarry.operators.reshape import transpose
from netquarry.operators.snapshots import Snapshots, latest_snapshot, one_per_key
from netquarry.plans.views import History, newest_sites
from netquarry.plans.area_audits import current_cells, evaluated_sites

# KPI ids, counters and labels of the power audits.
PUCCH_KPI = "LTE_5441b"
PUSCH_KPI = "LTE_5444b"
PUCCH_LABEL = "Avg RSSI for PUCCH"
PUSCH_LABEL = "Avg RSSI for PUSCH"
PORT_COUNTERS = {
    "M8005C306": "AVG_RTWP_RX_ANT_1",
    "M8005C307": "AVG_RTWP_RX_ANT_2",
    "M8005C308": "AVG_RTWP_RX_ANT_3",
    "M8005C309": "AVG_RTWP_RX_ANT_4",
}
SILENT_PORT_DBM = -120.0

# The KPI history sheet.
HISTORY_DAYS = 20
HISTORY_HEADER = ["Week", "Date", "Day", "Dummy"]
ACCESS_PRODUCT = "Acc RRC All  * Acc S1  * Acc ERAB "
ACCESS_PARTS = ("LTE_5218g", "LTE_5526a", "LTE_5017a")
RAB_TRAFFIC = "RAB_Traffic All RAB"
RAB_PARTS = ("LTE_5800e", "LTE_5801e")
ABSENT_KPI = "-9999"


def audit_rssi(
    kpis: DataFrame,
    site_history: History,
    threshold_indoor: float,
    threshold_outdoor: float,
    site_dns: Members | None = None,
    as_of: str | date | None = None,
) -> DataFrame:
    """Cells whose lowest uplink shared-channel power still exceeds the threshold of their site type.

    ``kpis`` holds ``Date, Cell`` and the two power KPIs.  Both minima are shown, only one is tested.
    """
    lowest = column_minimums(kpis, "Cell", [PUCCH_KPI, PUSCH_KPI]).withColumnsRenamed(
        {PUCCH_KPI: PUCCH_LABEL, PUSCH_KPI: PUSCH_LABEL}
    )
    current = newest_sites(site_history, as_of=as_of)
    if site_dns is not None:
        evaluated = evaluated_sites(current_cells(site_history, as_of), site_dns)
        current = members(current, "site_name", evaluated)
    cells = current.select(F.col("sector_name").alias("Cell"), "site_type")
    threshold = F.when(F.col("site_type") == "Indoor", F.lit(threshold_indoor)).otherwise(
        F.lit(threshold_outdoor)
    )
    rated = lowest.join(cells, on="Cell").withColumn("Threshold", threshold)
    return above(rated, PUSCH_LABEL, "Threshold")


def audit_rtwp(
    power: DataFrame,
    site_history: History,
    max_diff: float,
    threshold: float,
    today: str | date,
    days: int = 1,
    sites: Members | None = None,
    dedupe: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cells with unequal antenna ports and cells with a high mean level: ``(port_diff, level)``."""
    recent = trailing_days(power, "measTime", days, today)
    if sites is not None:
        recent = in_sites(recent, "distName", sites)
    if dedupe:
        recent = one_per_key(recent, dedupe)
    current = (
        newest_sites(site_history)
        .select("sector_name", F.col("moDistName").alias("distName"))
        .distinct()
    )
    ports = list(PORT_COUNTERS.values())
    # Averaged per object first: the join then sees one row per cell, not one per interval.
    levels = (
        scaled_means(recent, ["distName"], PORT_COUNTERS)
        .join(current, on="distName")
        .select("sector_name", "distName", *ports)
        .na.fill(SILENT_PORT_DBM, subset=ports)
        .withColumn("Max_RTWP_Diff", port_spread(ports))
        .withColumn("Avg_RTWP", port_mean(ports))
    )
    return at_least(levels, "Max_RTWP_Diff", max_diff), at_least(levels, "Avg_RTWP", threshold)


def antenna_tilts(cm: Snapshots, sites: Members | None = None) -> DataFrame:
    """Tilt reported by the antenna units of every cell: ``name, mo_distname, antlDN, tilt``.

    Channels tie a cell to antenna lines, units list the lines they move.  Units are taken on the
    newest day of the ALD class.  Only distinct tilts are asked for, so both sides are made distinct
    before they meet: many copies of a line would otherwise multiply.  Rows are dealt by what they are
    joined on next, here and in the audits, before they are made distinct, so one shuffle serves both.
    """
    channels = (
        latest_snapshot(cm, "CHANNEL")
        .select(
            *map_columns("ids", {"MRBTS": "MRBTS_id", "LCELL": "LCELL_id"}),
            *map_columns("parameters", ["antlDN"]),
        )
        .where(F.col("LCELL_id").isNotNull())
        .repartition("MRBTS_id", "LCELL_id")
        .distinct()
    )
    cells = latest_snapshot(cm, "LNCEL").select(
        *map_columns("ids", {"MRBTS": "MRBTS_id"}),
        "mo_distname",
        *map_columns("parameters", {"lcrId": "LCELL_id", "name": "name"}),
    )
    if sites is not None:
        cells = in_sites(cells, "mo_distname", sites)
    units = latest_snapshot(cm, "RETU", dated_by="ALD").select(
        *map_columns("ids", {"MRBTS": "MRBTS_id"}),
        *map_columns("parameters", ["angle"]),
        F.explode(F.element_at("p_lists", F.lit("antlDNList"))).alias("antlDN"),
    )
    units = units.repartition("MRBTS_id", "antlDN").distinct()
    return (
        channels.join(cells, on=["MRBTS_id", "LCELL_id"])
        .join(units, on=["MRBTS_id", "antlDN"])
        .select("name", "mo_distname", "antlDN", "angle")
        .repartition("name")
        .distinct()
        .select(
            "name",
            "mo_distname",
            "antlDN",
            (F.col("angle").cast("int") / F.lit(10.0)).alias("RET_electrical_tilt"),
        )
    )


def _planned(site_history: History, sites: Members | None, as_of: str | date | None) -> DataFrame:
    current = newest_sites(site_history, as_of=as_of)
    if sites is not None:
        current = in_sites(current, "moDistName", sites)
    return current.select("site_name", "sector_name", "electrical_tilt")


def audit_tilt_same_sector(
    tilts: DataFrame,
    site_history: History,
    sites: Members | None = None,
    as_of: str | date | None = None,
) -> DataFrame:
    """Cells whose antenna units report different tilts: the tilts and how many units have each."""
    mixed = disagreeing_values(tilts, "name", "RET_electrical_tilt").select(
        F.col("name").alias("sector_name"),
        F.col("values").alias("Angles"),
        F.col("counts").alias("Angle_Units"),
    )
    planned = _planned(site_history, sites, as_of)
    return mixed.join(planned, on="sector_name").select(
        "sector_name", "Angles", "Angle_Units", "electrical_tilt"
    )


def audit_tilt_vs_baseline(
    tilts: DataFrame,
    site_history: History,
    sites: Members | None = None,
    as_of: str | date | None = None,
) -> DataFrame:
    """Cells with a reported tilt that is not the planned one."""
    planned = _planned(site_history, sites, as_of)
    return (
        tilts.withColumnRenamed("name", "sector_name")
        .join(planned, on="sector_name")
        .where(differs("RET_electrical_tilt", "electrical_tilt"))
        .select("site_name", "sector_name", "mo_distname", "RET_electrical_tilt", "electrical_tilt")
        .distinct()
    )


def kpi_history(
    kpis: DataFrame,
    wanted: Sequence[str],
    order: Sequence[str],
    today: str | date,
    days: int = HISTORY_DAYS,
) -> DataFrame:
    """The last days up to yesterday, turned so that KPIs are rows and days are columns.

    ``kpis`` has one row per ``Date`` (``yyyy-MM-dd HH:mm:ss``); the window is a plain range on that text,
    which reaches the scan.  KPIs the frame lacks are 0, two
    composites are added, ``order`` picks and orders the KPI rows below the header rows.
    """
    start = as_date(today) - timedelta(days=days)
    window = kpis.where((F.col("Date") >= str(start)) & (F.col("Date") < str(as_date(today))))
    needed = list(dict.fromkeys([*wanted, *ACCESS_PARTS, *RAB_PARTS]))
    complete = with_report_schema(window, ["Date", *needed], fill=0.0)
    day = F.to_date(day_text("Date"))
    sheet = complete.select(
        F.date_format(day, "yyyy-MM-dd").alias("Date"),
        F.lpad(week_of_year(day).cast("string"), 2, "0").alias("Week"),
        weekday_name(day).alias("Day"),
        F.lit("").alias("Dummy"),
        *needed,
        success_product(*ACCESS_PARTS).alias(ACCESS_PRODUCT),
        row_max(*RAB_PARTS).alias(RAB_TRAFFIC),
    )
    # At most one column per day of the window.
    found = [r[0] for r in sheet.select("Date").distinct().orderBy("Date").collect()]
    return transpose(sheet, "Date", [*HISTORY_HEADER, *order], found, fill=ABSENT_KPI)
