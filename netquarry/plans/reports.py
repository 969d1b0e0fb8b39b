"""Fixed-schema KPI reports per technology and level.

Each report is a lazy frame with its full column list; ``write_report`` puts it in the order named
in ``SORT_KEYS`` when it is written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.dates import (
    ReportRange,
    as_date,
    check_unit,
    clamp_range,
    local_bucket,
    within_local_days,
)
from netquarry.functions.numeric import delivery_ratio
from netquarry.functions.text import nth_integer, parent_dn, text_before
from netquarry.operators.aggregates import grouped_sums
from netquarry.operators.columns import with_report_schema
from netquarry.operators.filters import Members, members
from netquarry.operators.snapshots import one_per_key
from netquarry.plans.views import History, newest_sites

# The KPI columns of the five reports, in report order.
LTE_CELL_KPIS = [
    "LTE_5239a", "LTE_1072a", "LTE_5569a", "LTE_753c", "LTE_5218f", "LTE_5116a", "LTE_5003a", "LTE_5118a",
    "LTE_5017a", "LTE_5123b", "LTE_5043b", "LTE_5058b", "LTE_5240a", "LTE_1078a", "LTE_5114a", "LTE_5289d",
    "LTE_5292d", "LTE_5212a", "LTE_5213a", "LTE_5427c", "M8005C306", "M8005C307", "M8005C308", "M8005C309",
    "LTE_1339a", "LTE_1067c", "LTE_717b", "LTE_5025h", "LTE_5218g", "LTE_291b", "LTE_5023h", "LTE_6265a",
    "LTE_249b", "LTE_250b",
]
LTE_SITE_KPIS = [
    "LTE_5240a", "LTE_1472a", "M8014C6", "LTE_5408a", "LTE_1473a", "LTE_5058b",
]
LTE_PROBE_KPIS = [
    "LTE_1652a", "M51132C0", "M51132C1",
]
UMTS_CELL_KPIS = [
    "RNC_183c", "RNC_231d", "RNC_217g", "RNC_5505b", "RNC_2697a", "RNC_5093b", "RNC_280d", "RNC_19a",
    "M1006C128", "M1006C129", "M1006C130", "M1006C131", "M1006C132", "M1006C133", "M1006C134", "M1006C135",
    "M1006C136", "M1006C137", "M1006C138", "M1006C139", "M1006C140", "M1006C141", "M1006C142", "M1006C143",
    "usuarios_dch_ul_ce_new", "usuarios_dch_dl_ce_new", "RNC_1686a", "RNC_920b", "RNC_605b", "RNC_645c",
    "RNC_1687a", "RNC_921c", "RNC_913b", "RNC_1036b", "RNC_1254a", "M1022C71", "RNC_1255c", "RNC_931a",
    "RNC_5043a", "RNC_5053a", "RNC_339b", "RNC_3124a", "RNC_3125a", "RNC_706b", "avgprachdelay", "RNC_609a",
    "RNC_1879e",
]
UMTS_BLANK_KPI = "RNC_2697a"
UMTS_SITE_KPIS = [
    "RNC_5409a", "RNC_1255c", "RNC_1254a",
]
UMTS_PROBE_KPIS = [
    "RNC_2627b", "M5126C0", "M5126C1",
]
GSM_CELL_KPIS = [
    "dcr_5", "blck_8i", "blck_5a_bh", "c003038", "dlq_2_4", "ulq_2_4", "uav_15b", "ulq_1a", "dlq_1a",
    "denied", "trf_377", "trf_1d", "c057017", "tbf_15a", "tbf_16b", "tbf_37d", "tbf_38d", "trf_233c",
    "trf_234", "trf_235b", "trf_236", "dcr_31b", "blck_5a", "ava_1g", "ava_68", "dis_1", "trf_215a",
    "trf_214a", "trf_213c", "trf_212c", "c001033", "trf_119",
]
GSM_COPIED_KPIS = {"blck_5a_bh": "blck_5a", "trf_119": "trf_1d"}
GSM_BLANK_KPI = "ava_68"
PROBE_COUNTERS = [
    "avgRTT_15Min",
    "maxRTT_15Min",
    "minRTT_15Min",
    "lostTwampMessages",
    "txTwampMessages",
]
PROBE_KEY = ["measTime", "measInterval", "distName", "extendedDistName"]
SORT_KEYS = {
    "lte_cell": ["LNCEL name", "Period start time"],
    "lte_site": ["LNBTS name", "Period start time"],
    "umts_cell": ["WCEL name", "Period start time"],
    "umts_site": ["WBTS name", "Period start time"],
    "gsm_cell": ["BTS name", "Period start time"],
}
# The order in which a run makes its reports.
REPORT_ORDER = ["gsm_cell", "umts_site", "umts_cell", "lte_cell", "lte_site"]

# How many days after its start a bucket may still hold a moment.
_BUCKET_DAYS = {"hour": 0, "day": 0, "week": 6, "month": 30, "quarter": 91, "year": 365}


def kpis_to_request(report: str) -> list[str]:
    """KPIs that have to be computed for a report; copied and blanked columns are left out."""
    columns = {
        "lte_cell": LTE_CELL_KPIS,
        "lte_site": LTE_SITE_KPIS,
        "umts_cell": UMTS_CELL_KPIS,
        "umts_site": UMTS_SITE_KPIS,
        "gsm_cell": GSM_CELL_KPIS,
    }[report]
    derived = {*GSM_COPIED_KPIS, GSM_BLANK_KPI, UMTS_BLANK_KPI}
    return [k for k in columns if k not in derived]


def _merged(kpis: DataFrame, more: DataFrame | None) -> DataFrame:
    return kpis if more is None else kpis.join(more, on=["Date", "Cell"])


def _report(frame: DataFrame, labels: Mapping[str, Column], kpis: Sequence[str]) -> DataFrame:
    labelled = frame.withColumns(dict(labels))
    return with_report_schema(labelled, [*labels, *kpis])


def report_lte_cell(kpis: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """KPIs per cell and period.  ``more`` is a second frame on the same ``Date, Cell``."""
    site = text_before("Cell", "_")
    labels = {
        "Period start time": F.col("Date"),
        "MRBTS/SBTS name": F.concat(F.lit("MRBTS-"), site),
        "LNBTS name": site,
        "LNCEL name": F.col("Cell"),
    }
    return _report(_merged(kpis, more), labels, LTE_CELL_KPIS)


def sites_by_parent(site_history: History, marker: str) -> DataFrame:
    """Distinct ``mo_distname, name`` of the sites that hold the current cells."""
    current = newest_sites(site_history)
    return current.select(
        parent_dn("moDistName", marker).alias("mo_distname"), F.col("site_name").alias("name")
    ).distinct()


def probe_kpis(
    probes: DataFrame,
    sites: DataFrame,
    unit: str,
    start: str | date,
    end: str | date,
    tz: str,
    names: Sequence[str],
    working_set: Members | None = None,
) -> DataFrame:
    """Transport probe totals per period and site: ``Date, Site`` and the three ``names``.

    Copies of a probe row are dropped first.  Sums per probe object and sums of those per site are
    one sum, so a single aggregation on the site's DN does both levels.
    """
    last = as_date(end)
    bucket = local_bucket("measTime", unit, tz)
    first_moment = F.lit(f"{as_date(start)} 00:00:00").cast("timestamp")
    after = F.lit(f"{last + timedelta(days=1)} 00:00:00").cast("timestamp")
    # The bucket decides; the plain range around it is what the scan can use.
    slack = last + timedelta(days=_BUCKET_DAYS[check_unit(unit)])
    in_range = probes.where(within_local_days("measTime", start, slack, tz)).where(
        (bucket >= first_moment) & (bucket < after)
    )
    wanted = sites if working_set is None else members(sites, "name", working_set)
    if working_set is not None:
        # Only probes of wanted sites are shuffled and sorted below.
        parent = "__parent"
        in_range = members(
            in_range.withColumn(parent, text_before("distName", "FTM-", back=1)),
            parent,
            wanted.select("mo_distname"),
        )
    keyed = one_per_key(in_range.select(*PROBE_KEY, *PROBE_COUNTERS), PROBE_KEY).select(
        bucket.alias("measTime"),
        text_before("distName", "FTM-", back=1).alias("mo_distname"),
        *PROBE_COUNTERS,
    )
    ratio, mean_rtt, max_rtt = names
    return (
        grouped_sums(keyed, ["measTime", "mo_distname"], PROBE_COUNTERS)
        .join(wanted, on="mo_distname")
        .select(
            F.date_format("measTime", "yyyy-MM-dd HH:mm:ss").alias("Date"),
            F.col("name").alias("Site"),
            delivery_ratio("txTwampMessages", "lostTwampMessages").alias(ratio),
            F.col("avgRTT_15Min").alias(mean_rtt),
            F.col("maxRTT_15Min").alias(max_rtt),
        )
    )


def report_lte_site(kpis: DataFrame, probe_frame: DataFrame) -> DataFrame:
    """KPIs per site and period with the transport probe columns beside them."""
    labels = {
        "Period start time": F.col("Date"),
        "MRBTS name": F.concat(F.lit("MRBTS-"), F.col("Site")),
        "LNBTS name": F.col("Site"),
    }
    joined = kpis.join(probe_frame, on=["Date", "Site"], how="left")
    return _report(joined, labels, [*LTE_SITE_KPIS, *LTE_PROBE_KPIS])


def controllers(site_history: History, name_column: str) -> DataFrame:
    """Controller name and the three ids in the DN of every current cell, distinct.

    The rows are dealt by the cell they are joined on, so one shuffle makes them distinct and joins them.
    """
    current = newest_sites(site_history)
    return current.select(
        F.col(name_column).alias("controller"),
        *[nth_integer("moDistName", n).alias(f"id_{n}") for n in (1, 2, 3)],
        F.col("sector_name").alias("Cell"),
    ).repartition("Cell").distinct()


def report_umts_cell(
    kpis: DataFrame, site_history: History, more: DataFrame | None = None
) -> DataFrame:
    known = controllers(site_history, "rnc_name")
    labels = {
        "Period start time": F.col("Date"),
        "PLMN name": F.lit("PLMN"),
        "RNC name": F.col("controller"),
        "WBTS name": text_before("Cell", "_"),
        "WBTS ID": F.col("id_2"),
        "WCEL name": F.col("Cell"),
    }
    blanked = _merged(kpis, more).join(known, on="Cell").drop(UMTS_BLANK_KPI)
    return _report(blanked, labels, UMTS_CELL_KPIS)


def report_umts_site(
    kpis: DataFrame, probe_frame: DataFrame, site_history: History
) -> DataFrame:
    known = (
        controllers(site_history, "rnc_name")
        .na.drop("any")
        .select("controller", "id_1", "id_2", text_before("Cell", "_").alias("Site"))
        .distinct()
    )
    labels = {
        "Period start time": F.col("Date"),
        "PLMN name": F.lit("PLMN"),
        "RNC name": F.col("controller"),
        "WBTS name": F.col("Site"),
        "WBTS ID": F.col("id_2"),
    }
    joined = kpis.join(probe_frame, on=["Date", "Site"], how="left").join(known, on="Site")
    return _report(joined, labels, [*UMTS_SITE_KPIS, *UMTS_PROBE_KPIS])


def report_gsm_cell(
    kpis: DataFrame, site_history: History, more: DataFrame | None = None
) -> DataFrame:
    known = controllers(site_history, "bsc_name")
    frame = _merged(kpis, more).drop(*GSM_COPIED_KPIS, GSM_BLANK_KPI)
    copies = {
        copy: F.col(source) for copy, source in GSM_COPIED_KPIS.items() if source in frame.columns
    }
    labels = {
        "Period start time": F.col("Date"),
        "BSC name": F.col("controller"),
        "BCF name": text_before("Cell", "_"),
        "BTS name": F.col("Cell"),
    }
    return _report(frame.withColumns(copies).join(known, on="Cell"), labels, GSM_CELL_KPIS)


ReportBuilder = Callable[[ReportRange], DataFrame]


def run_reports(
    builders: Mapping[str, ReportBuilder],
    start: str | date,
    end: str | date,
    unit: str,
    deliver: Callable[[str, DataFrame], object] | None = None,
    max_hourly_days: int | None = None,
    max_days: int | None = None,
) -> tuple[dict[str, DataFrame], dict[str, str], ReportRange]:
    """Make the reports of one run; returns ``(reports, failures, range)``.

    The range is the whole one unless limits are given; then it is clamped, and ``cut_days`` and
    ``unit`` of the returned range tell what became of it.  ``deliver(name, report)`` writes a report,
    e.g. with ``write_report`` and ``SORT_KEYS[name]``.  A report that fails, also while it is being
    written, does not stop the others.
    """
    period = clamp_range(start, end, unit, max_hourly_days, max_days)
    known = [n for n in REPORT_ORDER if n in builders]
    made: dict[str, DataFrame] = {}
    failures: dict[str, str] = {}
    for name in [*known, *[n for n in builders if n not in REPORT_ORDER]]:
        try:
            report = builders[name](period)
            if deliver is not None:
                deliver(name, report)
            made[name] = report
        except Exception as error:  # keep going, as each report stands alone
            failures[name] = f"{type(error).__name__}: {error}"
    return made, failures, period
