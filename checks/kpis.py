"""Catalog-driven KPIs, reports, selection and the streaming roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as s
from checks.basics import DIRECTORY_SQL, directory, stamp
from checks.registry import check
from netquarry import plans as P
from netquarry.functions.dates import ReportRange
from netquarry.plans.reports import (
    GSM_CELL_KPIS,
    LTE_CELL_KPIS,
    LTE_PROBE_KPIS,
    LTE_SITE_KPIS,
    SORT_KEYS,
    UMTS_CELL_KPIS,
    UMTS_PROBE_KPIS,
    UMTS_SITE_KPIS,
    kpis_to_request,
    sites_by_parent,
)
from netquarry.plans.views import VIEW_COLUMNS
from netquarry.session import work_folder
from netquarry.sources import kpi_catalog, write_report
from netquarry.streaming import stream_rollup

TZ = "America/Bogota"
START, END = "1998-01-01", "1998-12-31"

# Formulas of a few KPIs per report; the columns the catalog does not know stay NULL.
_FORMULAS = {
    "LTE_5239a": ("LTE", "sector_name", "sum(a.qty)"),
    "LTE_1072a": ("LTE", "sector_name", "count(*)"),
    "LTE_5218g": ("LTE", "sector_name", "max(a.price)"),
    "LTE_250b": ("LTE", "sector_name", "100-100*sum(a.lost)/sum(a.qty)"),
    "LTE_5240a": ("LTE", "sector_name", "min(a.price)"),
    "M8014C6": ("LTE", "site_name", "sum(a.qty)"),
    "LTE_5058b": ("LTE", "site_name", "avg(a.qty)"),
    "RNC_183c": ("UMTS", "sector_name", "sum(a.qty)"),
    "RNC_2697a": ("UMTS", "sector_name", "sum(a.qty)"),
    "RNC_1879e": ("UMTS", "sector_name", "max(a.price)"),
    "RNC_1254a": ("UMTS", "sector_name", "count(*)"),
    "blck_5a": ("GSM", "sector_name", "sum(a.lost)"),
    "trf_1d": ("GSM", "sector_name", "max(a.price)"),
    "c001033": ("GSM", "sector_name", "count(*)"),
}


# A KPI over two counter tables, with the condition that links them.
_TWO_TABLES = ("LTE_linked", "linked", "LTE", "sector_name", "100*sum(b.M8015C9)/sum(a.qty)", "objects a, handovers b")
_LINKED = "a.distName = b.distName AND a.measTime = b.measTime AND a.measInterval = b.measInterval AND b.M8015C8 > 0 AND"


def catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (
            kpi,
            f"name of {kpi}" if kpi != "LTE_1072a" else None,
            technology,
            level,
            formula,
            "objects a" if level == "sector_name" else "sites a",
            "",
        )
        for kpi, (technology, level, formula) in _FORMULAS.items()
    ]
    rows.append((*_TWO_TABLES, _LINKED))
    schema = (
        "KPI_Id string, Name string, Technology string, Level string, Formula string, "
        "`Tables` string, `Join` string"
    )
    return kpi_catalog(spark.createDataFrame(rows, schema))


def _counters(spark: SparkSession, d: str, technology: str) -> dict[str, DataFrame]:
    found = {"objects": s.counters(spark, d, technology)}
    if technology == "LTE":
        found["sites"] = s.counters(spark, d, technology, site_level=True)
        found["handovers"] = found["objects"]
    return found


def _sum(kpi: str) -> str:
    return _FORMULAS[kpi][2].replace("a.", "")


def _wide_sql(name: str, technology: str, label: str, column: str, unit: str, kpis: list[str]) -> str:
    """CTE of a wide KPI frame on cell-level counters."""
    t = technology.lower()
    values = ", ".join(f'cast({_sum(k)} AS DOUBLE) AS "{k}"' for k in kpis)
    return f"""{name} AS (SELECT strftime(date_trunc('{unit}', "measTime" - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS "Date",
  {column} AS "{label}", {values} FROM pm JOIN cur_{t} ON "distName" = "moDistName"
  WHERE "measTime" >= TIMESTAMP '{START} 05:00:00' AND "measTime" < TIMESTAMP '1999-01-01 05:00:00' GROUP BY 1, 2)"""


def _base_sql(technology: str) -> str:
    return f"{s.OBSERVATIONS_SQL}, {s.history_sql(technology)}, {s.counters_sql(technology)}"


# The site view keeps the newest records of a site, so it has its own CTE.
_SITE_VIEW_SQL = """site_view AS (SELECT DISTINCT split_part(h."moDistName", '/LNCEL', 1) AS dn, h.site_name, h.level_2, h.band
  FROM hist_lte h JOIN (SELECT site_name, max(export_date) AS newest FROM hist_lte GROUP BY 1) m
  ON h.site_name = m.site_name AND h.export_date = m.newest)"""


# The column that names the controller of a cell.
_CONTROLLER = {"LTE": [], "UMTS": ["rnc_name"], "GSM": ["bsc_name"]}


def _views(spark: SparkSession, d: str, technology: str) -> P.SiteViews:
    """The history of a run, resolved once, with the columns that reports need."""
    return P.SiteViews(s.site_history(spark, d, technology), [*VIEW_COLUMNS, *_CONTROLLER[technology]])


def _frame(
    spark: SparkSession,
    d: str,
    technology: str,
    kpis: list[str],
    groupby: str,
    unit: str = "month",
    views: P.SiteViews | None = None,
) -> DataFrame:
    return P.kpi_frame(
        _counters(spark, d, technology),
        catalog(spark),
        technology,
        kpis,
        START,
        END,
        views or s.site_history(spark, d, technology),
        groupby=groupby,
        unit=unit,
        tz=TZ,
    )


def _empty(columns: list[str], known: dict[str, str]) -> str:
    return ", ".join(f'{known.get(c, "cast(NULL AS DOUBLE)")} AS "{c}"' for c in columns)


@check(
    "C23_kpi_frame",
    f"""WITH {_base_sql("LTE")}, {s.counters_sql("LTE", True, "pms")}, {_SITE_VIEW_SQL},
{_wide_sql("cellwise", "LTE", "Site", "site_name", "month", ["LTE_5239a", "LTE_250b"])},
sitewise AS (SELECT strftime(date_trunc('month', "measTime" - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS "Date", site_name AS "Site",
  cast(sum(qty) AS DOUBLE) AS "M8014C6" FROM pms JOIN site_view ON "distName" = dn
  WHERE "measTime" >= TIMESTAMP '{START} 05:00:00' AND "measTime" < TIMESTAMP '1999-01-01 05:00:00' GROUP BY 1, 2)
SELECT coalesce(a."Date", b."Date") AS "Date", coalesce(a."Site", b."Site") AS "Site", "LTE_5239a", "LTE_250b", "M8014C6"
FROM cellwise a FULL JOIN sitewise b ON a."Date" = b."Date" AND a."Site" = b."Site" """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d, "LTE", ["LTE_5239a", "LTE_250b", "M8014C6", "unknown_kpi"], "site_name")


_LTE_KNOWN = ["LTE_5239a", "LTE_1072a", "LTE_5240a", "LTE_5218g", "LTE_250b"]


@check(
    "C15_report_lte_cell",
    f"""WITH {_base_sql("LTE")}, {_wide_sql("w", "LTE", "Cell", "sector_name", "month", _LTE_KNOWN)}
SELECT "Date" AS "Period start time", concat('MRBTS-', split_part("Cell", '_', 1)) AS "MRBTS/SBTS name", split_part("Cell", '_', 1) AS "LNBTS name",
"Cell" AS "LNCEL name", {_empty(LTE_CELL_KPIS, {k: f'"{k}"' for k in _LTE_KNOWN})} FROM w""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    kpis = kpis_to_request("lte_cell")
    half = len(kpis) // 2
    views = _views(spark, d, "LTE")
    return P.report_lte_cell(
        _frame(spark, d, "LTE", kpis[:half], "sector_name", views=views),
        _frame(spark, d, "LTE", kpis[half:], "sector_name", views=views),
    )


def _probe_sql(technology: str, marker: str, names: list[str]) -> str:
    """CTE ``probe``: totals per month and site; copies of a probe row are dropped first."""
    ratio, mean_rtt, max_rtt = names
    rest = '"avgRTT_15Min", "maxRTT_15Min", "minRTT_15Min", "lostTwampMessages", "txTwampMessages"'
    return f"""{s.probes_sql(technology)},
once AS (SELECT *, row_number() OVER (PARTITION BY "measTime", "measInterval", "distName", "extendedDistName" ORDER BY {rest}) AS n FROM probes
  WHERE "measTime" >= TIMESTAMP '1998-01-01 05:00:00' AND "measTime" < TIMESTAMP '1999-01-01 05:00:00'),
per_site AS (SELECT date_trunc('month', "measTime" - INTERVAL 5 HOUR) AS t, regexp_replace("distName", '/FTM-.*$', '') AS dn,
  sum("avgRTT_15Min") AS a, sum("maxRTT_15Min") AS m, sum("lostTwampMessages") AS lost, sum("txTwampMessages") AS tx FROM once WHERE n = 1 GROUP BY 1, 2),
names AS (SELECT DISTINCT regexp_replace("moDistName", '{marker}.*$', '') AS dn, site_name FROM cur_{technology.lower()}),
probe AS (SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS "Date", site_name AS "Site", 100.0::DOUBLE * (tx - lost) / tx AS "{ratio}",
  a::BIGINT AS "{mean_rtt}", m::BIGINT AS "{max_rtt}" FROM per_site JOIN names ON per_site.dn = names.dn)"""


def _probes(
    spark: SparkSession, d: str, technology: str, marker: str, names: list[str], unit: str, views: P.SiteViews
) -> DataFrame:
    sites = sites_by_parent(views, marker)
    return P.probe_kpis(s.probes(spark, d, technology), sites, unit, START, END, TZ, names)


@check(
    "C16_report_lte_site",
    f"""WITH {_base_sql("LTE")}, {s.counters_sql("LTE", True, "pms")}, {_SITE_VIEW_SQL}, {_probe_sql("LTE", "/LNCEL", LTE_PROBE_KPIS)},
cellwise AS (SELECT strftime(date_trunc('month', "measTime" - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS "Date", site_name AS "Site", min(price) AS "LTE_5240a"
  FROM pm JOIN cur_lte ON "distName" = "moDistName" WHERE "measTime" >= TIMESTAMP '{START} 05:00:00' AND "measTime" < TIMESTAMP '1999-01-01 05:00:00' GROUP BY 1, 2),
sitewise AS (SELECT strftime(date_trunc('month', "measTime" - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS "Date", site_name AS "Site",
  cast(sum(qty) AS DOUBLE) AS "M8014C6", avg(qty) AS "LTE_5058b" FROM pms JOIN site_view ON "distName" = dn
  WHERE "measTime" >= TIMESTAMP '{START} 05:00:00' AND "measTime" < TIMESTAMP '1999-01-01 05:00:00' GROUP BY 1, 2),
k AS (SELECT coalesce(a."Date", b."Date") AS "Date", coalesce(a."Site", b."Site") AS "Site", "LTE_5240a", "M8014C6", "LTE_5058b"
  FROM cellwise a FULL JOIN sitewise b ON a."Date" = b."Date" AND a."Site" = b."Site")
SELECT k."Date" AS "Period start time", concat('MRBTS-', k."Site") AS "MRBTS name", k."Site" AS "LNBTS name",
{_empty([*LTE_SITE_KPIS, *LTE_PROBE_KPIS], {c: f'"{c}"' for c in ["LTE_5240a", "M8014C6", "LTE_5058b", *LTE_PROBE_KPIS]})}
FROM k LEFT JOIN probe p ON k."Date" = p."Date" AND k."Site" = p."Site" """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    views = _views(spark, d, "LTE")
    kpis = _frame(spark, d, "LTE", LTE_SITE_KPIS, "site_name", views=views)
    return P.report_lte_site(kpis, _probes(spark, d, "LTE", "/LNCEL", LTE_PROBE_KPIS, "month", views))


@check(
    "C17_report_umts_cell",
    f"""WITH {_base_sql("UMTS")}, {_wide_sql("w", "UMTS", "Cell", "sector_name", "month", ["RNC_183c", "RNC_1879e", "RNC_1254a"])},
ids AS (SELECT DISTINCT rnc_name, regexp_extract("moDistName", 'WBTS-([0-9]+)', 1) AS wbts, "moDistName", sector_name FROM cur_umts)
SELECT "Date" AS "Period start time", 'PLMN' AS "PLMN name", rnc_name AS "RNC name", split_part("Cell", '_', 1) AS "WBTS name", wbts AS "WBTS ID", "Cell" AS "WCEL name",
{_empty(UMTS_CELL_KPIS, {k: f'"{k}"' for k in ["RNC_183c", "RNC_1879e", "RNC_1254a"]})} FROM w JOIN ids ON "Cell" = sector_name""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    # The blanked KPI is in the frame on purpose.
    views = _views(spark, d, "UMTS")
    frame = _frame(spark, d, "UMTS", UMTS_CELL_KPIS, "sector_name", views=views)
    return P.report_umts_cell(frame, views)


@check(
    "C18_report_umts_site",
    f"""WITH {_base_sql("UMTS")}, {_wide_sql("w", "UMTS", "Site", "site_name", "month", ["RNC_1254a"])}, {_probe_sql("UMTS", "/WCEL", UMTS_PROBE_KPIS)},
ids AS (SELECT DISTINCT rnc_name, regexp_extract("moDistName", 'RNC-([0-9]+)', 1) AS rnc, regexp_extract("moDistName", 'WBTS-([0-9]+)', 1) AS wbts, site_name FROM cur_umts)
SELECT w."Date" AS "Period start time", 'PLMN' AS "PLMN name", rnc_name AS "RNC name", w."Site" AS "WBTS name", wbts AS "WBTS ID",
{_empty([*UMTS_SITE_KPIS, *UMTS_PROBE_KPIS], {c: f'"{c}"' for c in ["RNC_1254a", *UMTS_PROBE_KPIS]})}
FROM w LEFT JOIN probe p ON w."Date" = p."Date" AND w."Site" = p."Site" JOIN ids ON w."Site" = ids.site_name""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    views = _views(spark, d, "UMTS")
    kpis = _frame(spark, d, "UMTS", UMTS_SITE_KPIS, "site_name", views=views)
    probe_frame = _probes(spark, d, "UMTS", "/WCEL", UMTS_PROBE_KPIS, "month", views)
    return P.report_umts_site(kpis, probe_frame, views)


@check(
    "C19_report_gsm_cell",
    f"""WITH {_base_sql("GSM")}, {_wide_sql("w", "GSM", "Cell", "sector_name", "month", ["blck_5a", "trf_1d", "c001033"])},
ids AS (SELECT DISTINCT bsc_name, "moDistName", sector_name FROM cur_gsm)
SELECT "Date" AS "Period start time", bsc_name AS "BSC name", split_part("Cell", '_', 1) AS "BCF name", "Cell" AS "BTS name",
{_empty(GSM_CELL_KPIS, {"blck_5a": '"blck_5a"', "trf_1d": '"trf_1d"', "c001033": '"c001033"', "blck_5a_bh": '"blck_5a"', "trf_119": '"trf_1d"'})} FROM w JOIN ids ON "Cell" = sector_name""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    views = _views(spark, d, "GSM")
    frame = _frame(spark, d, "GSM", kpis_to_request("gsm_cell"), "sector_name", views=views)
    return P.report_gsm_cell(frame, views)


def _run_branch(technology: str, report: str, column: str) -> str:
    return f"""SELECT '{report}' AS report, 'hour' AS unit, strftime(date_trunc('hour', l_shipdate - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS period, {column} AS element
FROM obs JOIN cur_{technology.lower()} ON {s._DN[technology]} = "moDistName"
WHERE l_shipdate >= TIMESTAMP '1998-01-01 05:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 05:00:00' GROUP BY 1, 2, 3, 4"""


@check(
    "C20_run_reports",
    f"""WITH {s.OBSERVATIONS_SQL}, {", ".join(s.history_sql(t) for t in ("LTE", "UMTS", "GSM"))}
{_run_branch("GSM", "gsm_cell", "sector_name")} UNION ALL {_run_branch("UMTS", "umts_site", "site_name")}
UNION ALL {_run_branch("UMTS", "umts_cell", "sector_name")} UNION ALL {_run_branch("LTE", "lte_cell", "sector_name")}""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    # One run reads each history once.
    views = {t: _views(spark, d, t) for t in ("LTE", "UMTS", "GSM")}

    def frame(technology: str, kpis: list[str], groupby: str, period: ReportRange) -> DataFrame:
        return P.kpi_frame(
            _counters(spark, d, technology),
            catalog(spark),
            technology,
            kpis,
            period.start,
            period.end,
            views[technology],
            groupby=groupby,
            unit=period.unit,
            tz=TZ,
        )

    def umts_site(period: ReportRange) -> DataFrame:
        sites = sites_by_parent(views["UMTS"], "/WCEL")
        probe_frame = P.probe_kpis(
            s.probes(spark, d, "UMTS"), sites, period.unit, period.start, period.end, TZ, UMTS_PROBE_KPIS
        )
        kpis = frame("UMTS", UMTS_SITE_KPIS, "site_name", period)
        return P.report_umts_site(kpis, probe_frame, views["UMTS"])

    def broken(period: ReportRange) -> DataFrame:
        """Fails in a task, while it is being written."""
        report = P.report_lte_cell(frame("LTE", ["LTE_5239a"], "sector_name", period))
        return report.withColumn("LNCEL name", F.raise_error(F.concat(F.lit("lost "), "LNCEL name")))

    folder = work_folder(spark, "reports")

    def deliver(name: str, report: DataFrame) -> None:
        write_report(report, f"{folder}/{name}", [c for c in SORT_KEYS[name] if c in report.columns])

    builders = {
        "lte_cell": lambda p: P.report_lte_cell(frame("LTE", ["LTE_5239a"], "sector_name", p)),
        "lte_site": broken,
        "umts_cell": lambda p: P.report_umts_cell(
            frame("UMTS", ["RNC_183c"], "sector_name", p), views["UMTS"]
        ),
        "umts_site": umts_site,
        "gsm_cell": lambda p: P.report_gsm_cell(
            frame("GSM", ["blck_5a"], "sector_name", p), views["GSM"]
        ),
    }
    made, failures, period = P.run_reports(builders, "1998-01-01", "1998-12-31", "Hour", deliver)
    assert list(failures) == ["lte_site"]
    names = {
        "lte_cell": "LNCEL name",
        "umts_cell": "WCEL name",
        "umts_site": "WBTS name",
        "gsm_cell": "BTS name",
    }
    parts = [
        spark.read.schema(report.schema).parquet(f"{folder}/{name}").select(
            F.lit(name).alias("report"),
            F.lit(period.unit).alias("unit"),
            F.col("Period start time").alias("period"),
            F.col(names[name]).alias("element"),
        )
        for name, report in made.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_QUERY_KPIS = ["LTE_5239a", "LTE_1072a", "LTE_250b", "M8014C6"]


def _long_branch(kpi: str, name: str, counters: str, view: str, dn: str) -> str:
    return f"""SELECT strftime(date_trunc('week', "measTime" - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS "measTime", level_2 AS "Element",
cast({_sum(kpi)} AS DOUBLE) AS "Value", '{kpi}' AS "KPI", '{kpi} - {name}' AS "KPI_Name" FROM {counters} JOIN {view} ON "distName" = {dn}
WHERE "measTime" >= TIMESTAMP '{START} 05:00:00' AND "measTime" < TIMESTAMP '1999-01-01 05:00:00' GROUP BY 1, 2"""


_NAMES = {k: "" if k == "LTE_1072a" else f"name of {k}" for k in _FORMULAS}
_SET_SQL = "wanted AS (SELECT concat('S', o_custkey, '_', o_orderkey) AS cell FROM orders WHERE o_orderpriority <> '5-LOW')"
_LONG_SQL = f"""WITH {_base_sql("LTE")}, {s.counters_sql("LTE", True, "pms")}, {_SITE_VIEW_SQL}, {_SET_SQL},
vc AS (SELECT * FROM cur_lte WHERE sector_name IN (SELECT cell FROM wanted)),
vs AS (SELECT * FROM site_view WHERE site_name IN (SELECT split_part(cell, '_', 1) FROM wanted)),
long AS ({" UNION ALL ".join(
    _long_branch(k, _NAMES[k], "pm", "vc", '"moDistName"') if _FORMULAS[k][1] == "sector_name"
    else _long_branch(k, _NAMES[k], "pms", "vs", "dn") for k in _QUERY_KPIS)})"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders").where(F.col("o_orderpriority") != "5-LOW")
    wanted = orders.select(F.expr("concat('S', o_custkey, '_', o_orderkey)").alias("item"))
    long = P.kpi_query(
        catalog(spark),
        _QUERY_KPIS,
        _counters(spark, d, "LTE"),
        {"LTE": s.site_history(spark, d, "LTE")},
        "cluster",
        "week",
        START,
        END,
        TZ,
        cells=wanted,
    )
    return long.withColumn("measTime", stamp("measTime"))


@check("C21_kpi_query", f"{_LONG_SQL} SELECT * FROM long")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d)


@check(
    "C21_kpi_two_tables",
    f"""WITH {_base_sql("LTE")} SELECT strftime(date_trunc('month', a."measTime" - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS "measTime", c.site_name AS "Element",
100.0::DOUBLE * sum(b."M8015C9") / sum(a.qty) AS "Value", 'LTE_linked' AS "KPI", 'LTE_linked - linked' AS "KPI_Name"
FROM pm a JOIN pm b ON a."distName" = b."distName" AND a."measTime" = b."measTime" AND a."measInterval" = b."measInterval" AND b."M8015C8" > 0
JOIN cur_lte c ON a."distName" = c."moDistName"
WHERE a."measTime" >= TIMESTAMP '{START} 05:00:00' AND a."measTime" < TIMESTAMP '1999-01-01 05:00:00' GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    histories = {"LTE": s.site_history(spark, d, "LTE")}
    linked = P.kpi_query(
        catalog(spark), ["LTE_linked"], _counters(spark, d, "LTE"), histories, "site", "month", START, END, TZ
    )
    return linked.withColumn("measTime", stamp("measTime"))


_LEVELS = {"set": "'WS'", "cluster": "level_2", "band": "band"}


@check(
    "A13_kpi_query_levels",
    f"WITH {_base_sql('LTE')} "
    + " UNION ALL ".join(
        f"""SELECT strftime(date_trunc('quarter', "measTime" - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS "measTime", '{level}' AS "Level", {column} AS "Element",
cast({_sum(kpi)} AS DOUBLE) AS "Value", '{kpi}' AS "KPI", '{kpi} - {"" if kpi == "LTE_1072a" else f"name of {kpi}"}' AS "KPI_Name" FROM pm JOIN cur_lte ON "distName" = "moDistName"
WHERE "measTime" >= TIMESTAMP '{START} 05:00:00' AND "measTime" < TIMESTAMP '1999-01-01 05:00:00' GROUP BY 1, 3"""
        for level, column in _LEVELS.items()
        for kpi in ("LTE_5239a", "LTE_1072a")
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    histories = {"LTE": s.site_history(spark, d, "LTE")}
    long = P.kpi_query(
        catalog(spark), ["LTE_5239a", "LTE_1072a"], _counters(spark, d, "LTE"), histories, list(_LEVELS), "quarter", START, END, TZ
    )
    return long.withColumn("measTime", stamp("measTime"))


# The exact best split of the KPI magnitudes: every cut of their order is tried.
_SPLIT_SQL = f"""{_LONG_SQL},
peaks AS (SELECT "KPI", log10(abs(CASE WHEN max("Value") = 0 THEN 0.1 ELSE max("Value") END)) AS m FROM long GROUP BY 1),
cuts AS (SELECT c.m AS cut, sum((p.m - side.mean) ** 2) AS cost FROM (SELECT DISTINCT m FROM peaks) c, peaks p,
  LATERAL (SELECT avg(q.m) AS mean FROM peaks q WHERE (q.m >= c.m) = (p.m >= c.m)) side GROUP BY 1),
best AS (SELECT arg_min(cut, cost) AS cut FROM cuts),
labels AS (SELECT "KPI", CASE WHEN m >= cut THEN 1 ELSE 0 END AS "Cluster" FROM peaks, best)"""


@check(
    "A17_split_kpis_by_scale",
    f"""{_SPLIT_SQL} SELECT l."KPI", "Cluster", count(*) AS n FROM long l JOIN labels b ON l."KPI" = b."KPI" GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.split_kpis_by_scale(_long(spark, d)).groupBy("KPI", "Cluster").agg(F.count("*").alias("n"))


@check(
    "C22_kpi_axes",
    f"""{_SPLIT_SQL} SELECT l.*, "Cluster" FROM long l JOIN labels b ON l."KPI" = b."KPI" """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.split_kpis_by_scale(_long(spark, d))


@check(
    "C26_kpi_pivot",
    f"""{_LONG_SQL} SELECT "measTime", "Element", {", ".join(
    f'''max("Value") FILTER ("KPI" = '{k}') AS "{k} - {_NAMES[k]}" ''' for k in _QUERY_KPIS)} FROM long GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.kpi_pivot(_long(spark, d))


@check("C25_site_directory", f"{DIRECTORY_SQL} SELECT * FROM dir")
def _(spark: SparkSession, d: str) -> DataFrame:
    return directory(spark, d)


@check(
    "C24_select_cells",
    f"""{DIRECTORY_SQL}, {_SET_SQL}
SELECT DISTINCT 'region' AS how, sector_name FROM dir WHERE "Technology" = 'LTE' AND region = 'ASIA'
UNION ALL SELECT DISTINCT 'site', sector_name FROM dir WHERE "Technology" = 'UMTS' AND region = 'ASIA' AND site_name IN ('S1', 'S12', 'S30', 'S77')
UNION ALL SELECT DISTINCT 'intersection', sector_name FROM dir WHERE "Technology" = 'LTE' AND region = 'EUROPE' AND sector_name IN (SELECT cell FROM wanted)
UNION ALL SELECT DISTINCT 'set', cell FROM wanted""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    known = directory(spark, d)
    orders = s.table(spark, d, "orders").where(F.col("o_orderpriority") != "5-LOW")
    wanted = orders.select(F.expr("concat('S', o_custkey, '_', o_orderkey)").alias("item"))
    chosen = {
        "region": P.select_cells(known, "LTE", region="ASIA"),
        "site": P.select_cells(known, "UMTS", region="ASIA", site_names=["S1", "S12", "S30", "S77"]),
        "intersection": P.select_cells(
            known, "LTE", region="EUROPE", working_set=wanted, mode="intersection"
        ),
        "set": P.select_cells(known, "LTE", working_set=wanted, mode="set"),
    }
    parts = [f.select(F.lit(how).alias("how"), "sector_name") for how, f in chosen.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# A window is emitted once the watermark has passed its end, so the last ones stay open.
@check(
    "T01_stream_rollup",
    """WITH once AS (SELECT DISTINCT ts, user_id, event_type FROM events),
w AS (SELECT date_trunc('hour', ts - INTERVAL 5 HOUR) AS t, event_type, count(*) AS n FROM once GROUP BY 1, 2)
SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS ts, event_type, n FROM w
WHERE t + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 5 HOUR - INTERVAL 2 HOUR FROM events)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    schema = s.table(spark, d, "events").schema
    # Read the table twice over, so that every row arrives as a copy too.
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    stream = reader.parquet(d).union(reader.parquet(d))
    rolled = stream_rollup(
        stream,
        "hour",
        ["event_type"],
        {"n": F.count("*")},
        ["ts", "user_id", "event_type"],
        ts="ts",
        tz=TZ,
        delay="2 hours",
    )
    out = work_folder(spark, "stream")
    query = (
        rolled.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("ts", stamp("ts"))
