from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from netquarry import plans as P
from netquarry.plans import reports as Rep
from netquarry.operators.filters import probable_members
from netquarry.plans.kpi import check_formula, counter_source, selected_kpis
from netquarry.plans.selection import choices, within_cascade
from netquarry.sources.readers import CATALOG_SCHEMA, CM_SCHEMA

D1, D2 = date(2024, 1, 1), date(2024, 1, 2)
SITE = "PLMN-PLMN/MRBTS-{0}/LNBTS-{0}"


def cm_rows(spark, *entries):
    """Entries are (day, class, dn, ids, parameters, p_lists, item_lists, file, version)."""
    full = []
    for entry in entries:
        day, cls, dn, ids, parameters, *rest = entry
        p_lists, items, file, version = [*rest, *[None, None, "x_rc1_y", "1"][len(rest):]]
        full.append((day, cls, dn, version, file, ids, parameters, p_lists, items))
    return spark.createDataFrame(full, CM_SCHEMA)


def site_history(spark, *entries):
    schema = (
        "export_date timestamp, moDistName string, sector_name string, site_name string, latitud double, "
        "longitud double, azimuth double, electrical_tilt double, site_type string, level_1 string, "
        "level_2 string, band string, rnc_name string, bsc_name string"
    )
    full = [
        (
            e.get("date", "2024-01-01"), e["dn"], e["sector"], e["site"], e.get("lat", 1.0), e.get("lon", 2.0),
            e.get("az"), e.get("tilt"), e.get("type", "Outdoor"), e.get("region", "R"), e.get("cluster", "C"),
            e.get("band", "B"), "RNC", "BSC",
        )
        for e in entries
    ]
    text = schema.replace("export_date timestamp", "export_date string")
    return spark.createDataFrame(full, text).withColumn("export_date", F.col("export_date").cast("timestamp"))


def test_parameter_audit(spark, rows):
    cm = cm_rows(
        spark,
        (D2, "A", SITE.format(1) + "/A-1", {}, {"p": "1", "q": None}),
        (D2, "A", SITE.format(10) + "/A-1", {}, {"p": "2", "q": "5"}),
        (D1, "A", SITE.format(1) + "/A-1", {}, {"p": "9"}),
        (D1, "B", SITE.format(1) + "/B-1", {}, {"r": "ok"}),
    )
    template = spark.createDataFrame(
        [("A", "p", "1"), ("A", "q", "5"), ("B", "r", "ok"), ("Z", "r", "ok")],
        "Object string, Parameter string, Value string",
    )
    sites = spark.createDataFrame([(SITE.format(1), 0)], "item string, pos int")
    summary, detail = P.audit_parameters(cm, template, sites)
    assert rows(detail, "Parameter", "Cur_Value", "site_id") == [("q", None, SITE.format(1))]
    # Class B deviates nowhere and so has no line.
    assert rows(summary) == [(SITE.format(1), "A", 2, 1, 50.0)]
    everything, _ = P.audit_parameters(cm, template, sites, exclude_zero=False)
    assert rows(everything, "Object", "mo_distname_dev") == [("A", 1), ("B", 0)]


def test_parameter_audit_with_literal_sites(spark, rows):
    dn = "PLMN-PLMN/M-1/L-10/A-1"
    cm = cm_rows(spark, (D1, "A", dn, {}, {"p": "2"}))
    template = spark.createDataFrame([("A", "p", "1")], "Object string, Parameter string, Value string")
    sites = spark.createDataFrame([("PLMN-PLMN/M-1/L-1", 0)], "item string, pos int")
    assert rows(P.audit_parameters(cm, template, sites)[1]) == []
    _, detail = P.audit_parameters(cm, template, sites, literal_sites=True)
    assert rows(detail, "mo_distname", "site_id") == [(dn, "PLMN-PLMN/M-1/L-1")]


def test_site_list_and_version(spark, rows):
    cm = cm_rows(
        spark,
        (D1, "LNBTS", "dn1", {}, {"name": "n1"}, None, None, "f", "V1"),
        (D1, "LNBTS", "dn2", {}, {}, None, None, "f", None),
    )
    assert rows(P.site_list(cm)) == [("n1", "dn1")]
    audited = P.audit_sw_version(cm, ["dn1", "dn2"], "V1")
    assert rows(audited, "mo_distname", "Version_OK") == [("dn1", "OK"), ("dn2", "NO-OK")]


def cells_and_handovers(spark):
    def cell(n, site, pci, root, carrier="f1"):
        dn = SITE.format(site) + f"/LNCEL-{n}"
        ids = {"LNCEL": str(n), "LNBTS": str(site), "MRBTS": str(site)}
        return [
            (D1, "LNCEL", dn, ids, {"name": f"c{n}", "phyCellId": pci, "eutraCelId": str(100 + n)}),
            (D1, "LNCEL_FDD", dn + "/F-0", ids, {"earfcnDL": carrier, "rootSeqIndex": root}),
        ]

    cm = cm_rows(
        spark,
        *cell(1, 1, "7", "1"),
        *cell(2, 2, "7", "2"),
        *cell(3, 2, "7", "1", "f2"),
        *cell(4, 3, "7", "1"),
        (D1, "LNADJ", SITE.format(1) + "/LNADJ-1", {"LNBTS": "1"}, {"adjEnbId": "2"}),
    )
    sites = site_history(
        spark,
        *[
            {"dn": SITE.format(s) + f"/LNCEL-{n}", "sector": f"c{n}", "site": f"S{s}"}
            for n, s in ((1, 1), (2, 2), (3, 2), (4, 3))
        ],
    )
    source = SITE.format(1) + "/LNCEL-1"
    handovers = spark.createDataFrame(
        [
            ("2024-01-09 10:00:00", source, "x/ECI-102/PLMN-1", 30, 1),
            ("2024-01-09 11:00:00", source, "x/ECI-102/PLMN-1", 30, 1),
            ("2024-01-09 10:00:00", source, "x/ECI-103/PLMN-1", 20, 1),
            ("2024-01-09 10:00:00", source, "x/ECI-104/PLMN-1", 10, 1),
            ("2024-01-09 10:00:00", source, "no target", 10, 1),
            ("2024-01-09 10:00:00", source, "x/ECI-104/PLMN-1", 0, 0),
            ("2024-01-01 10:00:00", source, "x/ECI-104/PLMN-1", 500, 0),
        ],
        "t string, distName string, extendedDistName string, M8015C8 bigint, M8015C9 bigint",
    ).withColumn("measTime", F.col("t").cast("timestamp"))
    return cm, sites, handovers


def test_handover_share_and_conflicts(spark, rows):
    cm, sites, handovers = cells_and_handovers(spark)
    cells = P.lte_cells(cm)
    share = P.handover_share(handovers, sites, cells, "2024-01-10")
    # The pair without a target counts in the total of 100.
    assert rows(share, "LNCEL_Name", "LNCEL_Name_tgt", "Total_ATT", "Share") == [
        ("c1", "c2", 100, 60), ("c1", "c3", 100, 20), ("c1", "c4", 100, 10)
    ]
    adjacency = P.site_adjacency(cm, [SITE.format(1)])
    by_code = P.audit_code_conflicts(cells, sites, adjacency, share, "phyCellId", 15)
    assert rows(by_code, "site_name_Orig", "LNCEL_Name_Orig", "LNCEL_Name_Dest", "phyCellId", "Share", "distance_m") == [
        ("S1", "c1", "c2", "7", 60, 0.0)
    ]
    assert rows(P.audit_code_conflicts(cells, sites, adjacency, share, "rootSeqIndex", 15)) == []


def test_tied_records_and_like_cells_count_each(spark, rows):
    """Two records of a cell that tie are two rows, and so are two cells alike in all but their object."""
    cm, sites, handovers = cells_and_handovers(spark)
    tied = sites.unionByName(sites.where("sector_name = 'c1'"))
    cells = P.lte_cells(cm)
    wanted = spark.createDataFrame([(SITE.format(1),), (None,)], "item string")
    listed = P.handover_share(handovers, tied, cells, "2024-01-10", sites=[SITE.format(1)])
    share = P.handover_share(handovers, tied, cells, "2024-01-10", sites=wanted)
    assert rows(share) == rows(listed) and rows(share, "LNCEL_Name_tgt", "INTER_HO_ATT_NB", "Total_ATT", "Share") == [
        ("c2", 120, 200, 60), ("c3", 40, 200, 20), ("c4", 20, 200, 10)
    ]
    none = spark.createDataFrame([(SITE.format(99),)], "item string")
    assert rows(P.handover_share(handovers, tied, cells, "2024-01-10", sites=none)) == []
    adjacency = P.site_adjacency(cm, wanted)
    shown = ("site_name_Orig", "LNCEL_Name_Orig", "LNCEL_Name_Dest", "phyCellId", "Share", "distance_m")
    once = P.audit_code_conflicts(cells, tied, adjacency, share, "phyCellId", 15)
    assert rows(once, *shown) == [("S1", "c1", "c2", "7", 60, 0.0)] * 2
    twice = P.audit_code_conflicts(cells.unionByName(cells.where("LNCEL_Name = 'c2'")), tied, adjacency, share, "phyCellId", 15)
    assert rows(twice, *shown) == [("S1", "c1", "c2", "7", 60, 0.0)] * 4


def test_missing_relations(spark, rows):
    src, tgt = SITE.format(1) + "/LNCEL-1", "PLMN-PLMN/RNC-1/WBTS-1/WCEL-{}"
    lte = site_history(spark, {"dn": src, "sector": "l1", "site": "S1", "az": 350.0})
    umts = site_history(
        spark,
        *[
            {"dn": tgt.format(n), "sector": f"u{n}", "site": "S1", "az": az}
            for n, az in ((1, 10.0), (2, 10.5), (3, 340.0), (4, None))
        ],
    )
    cm = cm_rows(spark, (D1, "LNRELW", src + "/LNRELW-1", {}, {"targetCellDn": tgt.format(3)}))
    summary, detail = P.audit_missing_relations(lte, umts, cm, [SITE.format(1)])
    assert rows(detail, "sector_name_tgt", "dif_az") == [("u1", 20.0)]
    assert rows(summary) == [("S1", 1)]


def test_area_codes(spark, rows):
    def both(n, site, tac, lac):
        lte = {"dn": SITE.format(site) + f"/LNCEL-{n}", "sector": f"l{n}", "site": f"S{site}"}
        umts = {"dn": f"PLMN-PLMN/RNC-1/WBTS-{site}/WCEL-{n}", "sector": f"u{n}", "site": f"S{site}"}
        return lte, umts, [
            (D1, "LNCEL", lte["dn"], {}, {"name": f"l{n}", "tac": tac}),
            (D1, "WCEL", umts["dn"], {}, {"name": f"u{n}", "LAC": lac}),
        ]

    made = [both(1, 1, "t1", "a1"), both(2, 1, "t2", "a1"), both(3, 2, "t1", "a1"), both(4, 3, None, "a3"), both(5, 4, None, "a3")]
    lte = site_history(spark, *[m[0] for m in made])
    umts = site_history(spark, *[m[1] for m in made])
    cm = cm_rows(spark, *[row for m in made for row in m[2]])
    evaluated = [SITE.format(1), SITE.format(3)]
    assert rows(P.audit_multi_tac(lte, cm, evaluated)) == [("S1", 2, 2)]
    assert rows(P.audit_tac_lac(lte, umts, cm, evaluated)) == [
        ("S1", "t1", "a1", "OK"), ("S1", "t2", "a1", "NO-OK"), ("S3", "NO-OK", "a3", "OK")
    ]


def test_power_audits(spark, rows):
    sites = site_history(
        spark,
        {"dn": "d1", "sector": "c1", "site": "S1", "type": "Indoor"},
        {"dn": "d2", "sector": "c2", "site": "S1"},
    )
    kpis = spark.createDataFrame(
        [("2024", "c1", -50.0, -90.0), ("2024", "c1", -50.0, -85.0), ("2024", "c2", None, -90.0), ("2024", None, 1.0, 1.0)],
        "Date string, Cell string, LTE_5441b double, LTE_5444b double",
    )
    loud = P.audit_rssi(kpis, sites, threshold_indoor=-95.0, threshold_outdoor=-80.0)
    assert rows(loud) == [("c1", -50.0, -90.0, "Indoor", -95.0)]
    power = spark.createDataFrame(
        [("d1", -1000.0, 0.0, None, -900.0), ("d2", 0.0, 0.0, 0.0, 0.0)],
        "distName string, M8005C306 double, M8005C307 double, M8005C308 double, M8005C309 double",
    ).withColumn("measTime", F.lit("2024-01-10 01:00:00").cast("timestamp"))
    unequal, level = P.audit_rtwp(power, sites, 30, -103.4, "2024-01-10")
    assert rows(unequal, "sector_name", "AVG_RTWP_RX_ANT_3", "Max_RTWP_Diff") == [("c1", -120.0, 30.0)]
    # A cell whose ports are all zero has no reading and passes both tests.
    assert rows(level, "sector_name") == [("c1",)]


def test_tilts(spark, rows):
    dn = SITE.format(1) + "/LNCEL-1"
    ids = {"MRBTS": "1"}
    cm = cm_rows(
        spark,
        (D1, "LNCEL", dn, ids, {"name": "c1", "lcrId": "5"}),
        (D1, "CHANNEL", "ch1", {"MRBTS": "1", "LCELL": "5"}, {"antlDN": "A1"}),
        (D1, "CHANNEL", "ch2", {"MRBTS": "1", "LCELL": "5"}, {"antlDN": "A2"}),
        (D1, "CHANNEL", "ch3", ids, {"antlDN": "A3"}),
        (D1, "ALD", "ald", ids, {}),
        (D1, "RETU", "r1", ids, {"angle": "40"}, {"antlDNList": ["A1", "A3"]}),
        (D1, "RETU", "r2", ids, {"angle": "60"}, {"antlDNList": ["A2"]}),
        (D2, "RETU", "r3", ids, {"angle": "99"}, {"antlDNList": ["A1"]}),
        (D1, "RETU", "r4", ids, {"angle": "98"}, {"antlDNList": []}),
    )
    sites = site_history(spark, {"dn": dn, "sector": "c1", "site": "S1", "tilt": 4.0})
    tilts = P.antenna_tilts(cm)
    assert rows(tilts, "antlDN", "RET_electrical_tilt") == [("A1", 4.0), ("A2", 6.0)]
    assert rows(P.audit_tilt_same_sector(tilts, sites)) == [("c1", [4.0, 6.0], [1, 1], 4.0)]
    assert rows(P.audit_tilt_vs_baseline(tilts, sites)) == [("S1", "c1", dn, 6.0, 4.0)]


def test_kpi_history_window(spark):
    data = [(f"2024-01-{d:02d} 00:00:00", float(d)) for d in (1, 2, 21, 22)]
    kpis = spark.createDataFrame(data, "Date string, LTE_5218g double")
    sheet = P.kpi_history(kpis, ["LTE_5218g"], ["LTE_5218g", "RAB_Traffic All RAB"], "2024-01-22")
    assert sheet.columns == ["item_position", "item", "2024-01-02", "2024-01-21"]
    got = {r["item"]: r["2024-01-21"] for r in sheet.collect()}
    assert got == {
        "Week": "03", "Date": "2024-01-21", "Day": "SUNDAY", "Dummy": "", "LTE_5218g": "21.0", "RAB_Traffic All RAB": "0.0"
    }


def kpi_setup(spark):
    catalog = spark.createDataFrame(
        [
            ("K1", "one", "LTE", "sector_name", "sum(a.n)", "ho a", ""),
            ("K2", "two", "LTE", "sector_name", "sum(a.n)/sum(b.m)", "ho a, pw b", "a.distName=b.distName AND a.measTime=b.measTime AND "),
            ("K3", "three", "LTE", "cluster_name", "sum(a.n)", "ho a", ""),
            ("K4", "four", "LTE", "sector_name", "a.n + 1", "ho a", ""),
            ("K5", "five", "LTE", "sector_name", "sum(nothing)", "ho a", ""),
            ("K6", "six", "LTE", "sector_name", "sum(a.n)", "ho a, pw b", ""),
        ],
        CATALOG_SCHEMA,
    )
    def counter(name):
        return spark.createDataFrame(
            [("2024-01-01 04:30:00", "d1", 6), ("2024-01-01 05:30:00", "d1", 8), ("2024-01-01 05:30:00", "d2", 3)],
            f"t string, distName string, {name} int",
        ).withColumn("measTime", F.col("t").cast("timestamp"))
    sites = site_history(
        spark, {"dn": "d1", "sector": "c1", "site": "S1"}, {"dn": "d2", "sector": "c2", "site": "S1"}
    )
    return catalog, {"ho": counter("n"), "pw": counter("m")}, {"LTE": sites}


def run_kpis(spark, kpis, **options):
    catalog, counters, sites = kpi_setup(spark)
    settings = {"element": "site", "unit": "day", "start": "2023-12-31", "end": "2024-01-01", "tz": "America/Bogota"}
    return P.kpi_query(catalog, kpis, counters, sites, **{**settings, **options})


def test_kpi_query(spark, rows):
    day = F.date_format("measTime", "dd").alias("day")
    assert rows(run_kpis(spark, ["K1"]), day, "Element", "Value", "KPI_Name") == [
        ("01", "S1", 11.0, "K1 - one"), ("31", "S1", 6.0, "K1 - one")
    ]
    assert rows(run_kpis(spark, ["K2"], cells=["c1"]), day, "Value") == [("01", 1.0), ("31", 1.0)]
    assert rows(run_kpis(spark, ["K1"], element="set", start="2024-01-01"), "Element", "Value") == [("WS", 11.0)]


@pytest.mark.parametrize("kpi", ["K3", "K4", "K5", "K6"])
def test_kpi_query_rejects(spark, kpi):
    with pytest.raises(ValueError):
        run_kpis(spark, [kpi])


def test_kpi_query_rejects_unknown(spark):
    with pytest.raises(ValueError):
        run_kpis(spark, ["none"])
    with pytest.raises(ValueError):
        run_kpis(spark, ["K1"], element="continent")


def test_kpis_of_one_table_share_a_pass(spark):
    catalog, counters, _ = kpi_setup(spark)
    twice = catalog.where("KPI_Id = 'K1'").union(catalog.where("KPI_Id = 'K1'").withColumn("KPI_Id", F.lit("K1b")))
    groups = selected_kpis(twice, ["K1", "K1b"])
    assert [len(g.kpis) for g in groups] == [2]
    check_formula(counters["ho"], "K", "100-100*sum(n)/count(*)")
    with pytest.raises(ValueError):
        check_formula(counters["ho"], "K", "sum(n")


@pytest.mark.parametrize("formula", ["1", "'x'", "n + sum(n)", "n", "sum(n) over ()", "explode(collect_list(n))"])
def test_only_aggregates_are_formulas(spark, formula):
    _, counters, _ = kpi_setup(spark)
    with pytest.raises(ValueError):
        check_formula(counters["ho"], "K", formula)


@pytest.mark.parametrize("formula", ["round(100 * sum(n) / nullif(count(*), 0), 2)", "max(n) - min(n) + 1", "100-100*sum(n)/sum(n)"])
def test_nested_aggregates_are_formulas(spark, formula):
    _, counters, _ = kpi_setup(spark)
    check_formula(counters["ho"], "K", formula)


@pytest.mark.parametrize(
    "condition",
    [
        "", "a.n > 1", "a.distName = b.distName OR a.measTime = b.measTime", "NOT (a.n > 1 AND a.distName = b.distName AND b.m > 1)",
        "a.distName = b.distName AND a.n = 1 OR b.m = 2", "a.distName = a.distName",
    ],
)
def test_tables_must_be_linked(spark, condition):
    _, counters, _ = kpi_setup(spark)
    with pytest.raises(ValueError):
        counter_source(counters, "ho a, pw b", condition)


def test_three_tables_join_by_their_equalities(spark):
    _, counters, _ = kpi_setup(spark)
    condition = "a.distName = c.distName AND (b.m > 0 OR a.n > 0) AND c.measTime = a.measTime AND b.distName = c.distName AND b.measTime=c.measTime and"
    source, first = counter_source({**counters, "more": counters["ho"]}, "ho a, pw b, more c", condition)
    plan = source._jdf.queryExecution().executedPlan().toString()
    assert first == "a" and "CartesianProduct" not in plan and "NestedLoop" not in plan and source.count() == 3
    # A range on the first table's time holds for all whose time must be equal.
    bounded, _ = counter_source(counters, "ho a, pw b", "a.distName=b.distName AND a.measTime=b.measTime", {"measTime": lambda t: t < "2024-01-01 05:00:00"})
    assert bounded.count() == 1
    assert bounded._jdf.queryExecution().analyzed().toString().count("2024-01-01 05:00:00") >= 2


def test_levels_share_a_scan(spark, rows):
    day = F.date_format("measTime", "dd").alias("day")
    got = rows(run_kpis(spark, ["K1"], element=["set", "cell"]), day, "Level", "Element", "Value")
    assert got == [("01", "cell", "c1", 8.0), ("01", "cell", "c2", 3.0), ("01", "set", "WS", 11.0), ("31", "cell", "c1", 6.0), ("31", "set", "WS", 6.0)]


def test_objects_without_a_label_share_a_row(spark):
    catalog, counters, _ = kpi_setup(spark)
    more = catalog.where("KPI_Id = 'K1'").union(
        spark.createDataFrame([("K7", "seven", "LTE", "sector_name", "sum(a.m)", "pw a", "")], CATALOG_SCHEMA)
    )
    sites = site_history(spark, {"dn": "d1", "sector": "c1", "site": None}, {"dn": "d2", "sector": "c2", "site": None})
    frame = P.kpi_frame(counters, more, "LTE", ["K1", "K7"], "2024-01-01", "2024-01-01", sites, groupby="site_name")
    assert [tuple(r) for r in frame.collect()] == [("2024-01-01 00:00:00", None, 17.0, 17.0)]


def test_counters_of_other_objects_are_not_shuffled(spark):
    """Above the broadcast limit counters are shuffled to the view, but those of unwanted objects are not."""
    catalog, _, _ = kpi_setup(spark)
    counters = spark.range(40000).select(
        F.lit("2024-01-01 06:00:00").cast("timestamp").alias("measTime"), F.concat(F.lit("d"), F.col("id") % 4000).alias("distName"), F.lit(1).alias("n")
    )
    sites = site_history(spark, *[{"dn": f"d{k}", "sector": f"c{k}", "site": f"S{k}"} for k in range(100)])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query = P.kpi_query(catalog, ["K1"], {"ho": counters}, {"LTE": sites}, "cell", "day", "2024-01-01", "2024-01-01", "UTC", cells=[f"c{k}" for k in range(40)])
        assert {r["Value"] for r in query.collect()} == {10.0} and query.count() == 40
        plan = query._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold") if limit is None else spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [shiftright" in plan
    kept = probable_members(counters, F.col("distName"), spark.createDataFrame([(f"d{k}",) for k in range(40)], "x string"))
    assert 400 <= kept.count() < 500


def test_shared_views_are_resolved_once(spark):
    history = site_history(spark, {"dn": "d1", "sector": "c1", "site": "S1"})
    views = P.SiteViews(history)
    assert views.newest() is views.newest() and views.at("sector_name") is views.at("sector_name")
    assert views.newest(as_of="1990-01-01").count() == 0 and views.newest().count() == 1
    plan = views.at("sector_name")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_kpi_pivot(spark, rows):
    long = run_kpis(spark, ["K1"], element="cell").withColumn("measTime", F.col("measTime").cast("string"))
    assert P.kpi_pivot(long).columns == ["measTime", "Element", "K1 - one"]


def test_lte_reports(spark, rows):
    kpis = spark.createDataFrame([("2024-01-01 00:00:00", "SITE_1", 5.0)], "Date string, Cell string, LTE_5239a double")
    more = spark.createDataFrame([("2024-01-01 00:00:00", "SITE_1", 6.0)], "Date string, Cell string, LTE_250b double")
    report = P.report_lte_cell(kpis, more)
    assert report.columns == ["Period start time", "MRBTS/SBTS name", "LNBTS name", "LNCEL name", *Rep.LTE_CELL_KPIS]
    assert len(Rep.LTE_CELL_KPIS) == 34 and len(Rep.UMTS_CELL_KPIS) == 47 and len(Rep.GSM_CELL_KPIS) == 32
    row = report.first()
    assert (row["MRBTS/SBTS name"], row["LTE_5239a"], row["LTE_250b"], row["LTE_717b"]) == ("MRBTS-SITE", 5.0, 6.0, None)


def test_site_report_counts_copies_of_probes_once(spark):
    sites = spark.createDataFrame([(SITE.format(1), "S1"), (SITE.format(10), "S10")], "mo_distname string, name string")
    def probe(hour, ftm, site, tx, lost, copies=1):
        return [(f"2024-01-01 {hour}:00:00", 15, SITE.format(site) + f"/FTM-{ftm}", "x", 1, 2, 3, lost, tx)] * copies
    data = probe("05", 1, 1, 90, 9, copies=3) + probe("06", 2, 1, 10, 1) + probe("04", 1, 1, 5, 5) + probe("06", 1, 10, 0, 0)
    probes = spark.createDataFrame(
        data,
        "t string, measInterval int, distName string, extendedDistName string, avgRTT_15Min int, maxRTT_15Min int, "
        "minRTT_15Min int, lostTwampMessages int, txTwampMessages int",
    ).withColumn("measTime", F.col("t").cast("timestamp"))
    frame = P.probe_kpis(probes, sites, "day", "2024-01-01", "2024-01-01", "America/Bogota", Rep.LTE_PROBE_KPIS)
    got = {r["Site"]: tuple(r) for r in frame.collect()}
    assert got == {
        "S1": ("2024-01-01 00:00:00", "S1", 90.0, 2, 4), "S10": ("2024-01-01 00:00:00", "S10", None, 1, 2)
    }
    kpis = spark.createDataFrame([("2024-01-01 00:00:00", "S1"), ("2024-01-02 00:00:00", "S1")], "Date string, Site string")
    report = {r["Period start time"]: r["LTE_1652a"] for r in P.report_lte_site(kpis, frame).collect()}
    assert report == {"2024-01-01 00:00:00": 90.0, "2024-01-02 00:00:00": None}


def test_umts_and_gsm_reports(spark):
    sites = site_history(spark, {"dn": "PLMN-PLMN/RNC-4/WBTS-5/WCEL-6", "sector": "S1_1", "site": "S1"})
    kpis = spark.createDataFrame([("d", "S1_1", 1.0, 2.0, 3.0)], "Date string, Cell string, RNC_2697a double, blck_5a double, ava_68 double")
    umts = P.report_umts_cell(kpis, sites).first()
    assert (umts["RNC name"], umts["WBTS ID"], umts["WBTS name"], umts["RNC_2697a"]) == ("RNC", "5", "S1", None)
    gsm = P.report_gsm_cell(kpis, sites).first()
    assert (gsm["blck_5a_bh"], gsm["trf_119"], gsm["ava_68"], gsm["BCF name"]) == (2.0, None, None, "S1")


def test_run_reports_goes_on_after_a_failure(spark):
    seen = []
    def builder(period):
        seen.append(period)
        return spark.range(1)
    def broken(period):
        raise KeyError("down")
    written = []
    def run(**limits):
        return P.run_reports(
            {"lte_cell": builder, "gsm_cell": broken}, "2024-01-01", "2024-03-01", "Hour",
            deliver=lambda n, r: written.append(n), **limits,
        )
    made, failures, period = run()
    assert (list(made), list(failures), written) == (["lte_cell"], ["gsm_cell"], ["lte_cell"])
    assert seen[0] == period and (period.start, period.unit, period.cut_days) == (date(2024, 1, 1), "hour", 0)
    *_, period = run(max_hourly_days=20, max_days=45)
    assert (period.start, period.unit, period.cut_days) == (date(2024, 1, 16), "day", 15)


def test_selection(spark, rows):
    def entry(n, site, region, cluster):
        return {"dn": f"d{n}", "sector": f"c{n}", "site": site, "region": region, "cluster": cluster}
    lte = site_history(spark, entry(1, "S1", "R1", "C1"), entry(2, "S2", "R1", "C1"), entry(3, "S3", "R1", "0"), entry(4, None, "R1", "C1"))
    umts = site_history(spark, entry(5, "S1", "R1", "C1"))
    directory = P.site_directory({"LTE": lte, "UMTS": umts})
    assert rows(directory, "sector_name", "Technology") == [("c1", "LTE"), ("c2", "LTE"), ("c5", "UMTS")]
    def cells(**options):
        return [r[0] for r in P.select_cells(directory, "LTE", **options).orderBy("sector_name").collect()]
    assert cells(region="R1", cluster="C1") == ["c1", "c2"]
    assert cells(region="R1", cluster="C1", site_names=["S2"]) == ["c2"]
    assert cells(cells=["c1"]) == ["c1"]
    assert cells(working_set=["c2", "zz"], mode="intersection") == ["c2"]
    assert cells(working_set=["c2", "zz"], mode="set") == ["c2", "zz"]
    with pytest.raises(ValueError):
        cells(mode="set")
    assert rows(choices(within_cascade(directory, "LTE", "R1"), "site_name")) == [("S1",), ("S2",)]


def test_flatten_parameters(spark):
    cm = cm_rows(
        spark,
        (D1, "Cls", "a", {"PLMN": "PLMN", "X": "1"}, {"Mode": "up", "mode": "7", "gap": "1", "n": "5"}),
        (D1, "Cls", "b", {"PLMN": "PLMN", "X": "2"}, {"Mode": "up", "mode": "8", "n": "x"}, None, None, "none", None),
        (D2, "Cls", "c", {}, {"late": "1"}),
        (D1, "Void", "d", {}, None),
    )
    tables = P.flatten_parameters(cm, D1)
    assert list(tables) == ["CLS"]
    table = tables["CLS"]
    assert dict(table.dtypes) == {
        "PLMN_id": "string", "X_id": "bigint", "moVersion": "string", "gap": "string", "mode": "bigint", "n": "string"
    }
    assert sorted(tuple(r) for r in table.select("PLMN_id", "X_id", "gap", "mode").collect()) == [
        ("", 2, None, 8), ("RC1", 1, "1", 7)
    ]


def test_flatten_lists(spark):
    cm = cm_rows(
        spark,
        (D1, "C", "a", {"X": "1", "Y": "1"}, None, {"l": ["1", None, "3"], "t": ["w"]}),
        (D1, "C", "b", {"X": "2", "Y": "u"}, None, {"l": [], "t": None}),
        (D1, "C", "c", {"X": "3"}, None, {"l": ["z"]}),
        (D1, "D", "d", {}, None, {"l": ["5"]}),
    )
    tables = P.flatten_lists(cm, D1)
    assert sorted(tables) == ["C_L", "C_T", "D_L"]
    assert dict(tables["C_L"].dtypes)["Value"] == "bigint" and dict(tables["C_T"].dtypes)["Value"] == "string"
    got = sorted(tuple(r) for r in tables["C_L"].select("X_id", "Y_id", "optionId", "Value").collect())
    assert got == [(1, 1, 0, 1), (1, 1, 2, 3)]
    assert [tuple(r) for r in tables["D_L"].select("optionId", "Value").collect()] == [(0, 5)]


def test_flatten_items(spark):
    cm = cm_rows(
        spark,
        (D1, "C", "a", {"X": "1"}, None, None, {"l": [{"f": "1"}, {"f": "x", "z": "1"}]}),
        (D1, "C", "b", {"X": "2"}, None, None, {"l": [{"f": "2", "g": "t"}]}),
        (D1, "C", "c", {}, None, None, {"l": []}),
        (D1, "C", "d", {"X": "4"}, None, None, {"m": [{"h": "1"}]}),
    )
    tables = P.flatten_items(cm, D1)
    assert sorted(tables) == ["C_L", "C_M"]
    assert dict(tables["C_L"].dtypes) == {"X_id": "bigint", "f": "bigint", "g": "string", "PLMN_id": "string"}
    assert sorted(tuple(r) for r in tables["C_L"].select("X_id", "f", "g").collect()) == [
        (0, 0, "0"), (1, 1, "0"), (2, 2, "t"), (4, 0, "0")
    ]


def test_publish_daily(spark):
    cm = cm_rows(
        spark,
        (D1, "LNCEL", "a", {"X": "1"}, {"p": "1"}, {"l": ["1"]}),
        (D2, "OTHER", "b", {"X": "1"}, {"p": "1"}),
    )
    assert sorted(P.publish_daily(cm)) == ["LNCEL", "LNCEL_L"]
    assert P.publish_daily(cm.where("mo_class = 'OTHER'")) == {}
    assert P.flatten_items(cm, D1) == {}


def test_names_that_clash_lose_nothing(spark):
    """Classes equal but for case, a class called like another one's list, parameters called like ids."""
    cm = cm_rows(
        spark,
        (D1, "LNCEL", "a", {"A": "1", "PLMN": "x"}, {"p": "1", "A_id": "7", "moversion": "z", "PLMN_id": "q"}, {"X": ["1"]}, {"X": [{"f": "1"}]}),
        (D1, "Lncel", "b", {"A": "2"}, {"q": "t"}, {"x": ["2", "v"]}),
        (D1, "LNCEL_X", "c", {"A": "3"}, {"r": "5"}),
        (D1, "A_B", "d", {}, None, {"C": ["1"]}),
        (D1, "A", "e", {}, None, {"B_C": ["2"]}),
    )
    tables = P.publish_daily(cm)
    assert sorted(tables) == ["A_B_C", "A_B__C", "LNCEL", "LNCEL_X", "LNCEL__X", "LNCEL__X__LIST"]
    cells = tables["LNCEL"]
    assert cells.columns == ["A_id", "PLMN_id", "moVersion", "A_id_parameter", "PLMN_id_parameter", "moversion_parameter", "p", "q"]
    got = sorted(tuple(r) for r in cells.select("A_id", "A_id_parameter", "moversion_parameter", "p", "q").collect())
    assert got == [(1, "7", "z", "1", None), (2, None, None, None, "t")]
    assert [tuple(r) for r in tables["LNCEL_X"].select("A_id", "r").collect()] == [(3, 5)]
    assert [tuple(r) for r in tables["LNCEL__X"].select("f", "A_id").collect()] == [(1, 1)]
    assert sorted(tuple(r) for r in tables["LNCEL__X__LIST"].select("A_id", "optionId", "Value").collect()) == [(1, 0, "1"), (2, 0, "2"), (2, 1, "v")]
    assert [r["Value"] for r in tables["A_B_C"].collect() + tables["A_B__C"].collect()] == [2, 1]
    assert len(tables) == 6


def test_all_items(spark):
    cm = cm_rows(
        spark,
        (D1, "C", "a", {"X": "1"}, None, None, {"l": [{"f": "1"}, {"f": "x", "z": "1"}, {"g": "3"}]}),
        (D1, "C", "b", {"X": "2"}, None, None, {"l": []}),
        (D1, "C", "c", {}, None, None, {"m": [{"h": "1"}]}),
    )
    table = P.flatten_items(cm, D1, all_items=True)["C_L"]
    assert dict(table.dtypes) == {"X_id": "bigint", "itemId": "int", "f": "string", "g": "bigint", "z": "bigint", "PLMN_id": "string"}
    got = sorted((tuple(r) for r in table.select("X_id", "itemId", "f", "g", "z").collect()), key=repr)
    assert got == [(0, None, "0", 0, 0), (1, 0, "1", 0, 0), (1, 1, "x", 0, 1), (1, 2, "0", 3, 0), (2, None, "0", 0, 0)]


def test_flattening_discovers_in_one_job_without_joins(spark):
    cm = cm_rows(spark, (D1, "LNCEL", "a", {"X": "1"}, {"p": "1"}, {"l": ["1"]}, {"m": [{"f": "1"}]}))
    for table in P.publish_daily(cm).values():
        assert "Join" not in table._jdf.queryExecution().executedPlan().toString()


def test_probe_sites_are_filtered_before_copies_are_dropped(spark):
    sites = spark.createDataFrame([(SITE.format(1), "S1"), (SITE.format(2), "S2")], "mo_distname string, name string")
    data = [("2024-01-01 05:00:00", 15, SITE.format(n) + "/FTM-1", "x", 1, 2, 3, 1, 10) for n in (1, 2)]
    probes = spark.createDataFrame(
        data,
        "t string, measInterval int, distName string, extendedDistName string, avgRTT_15Min int, maxRTT_15Min int, "
        "minRTT_15Min int, lostTwampMessages int, txTwampMessages int",
    ).withColumn("measTime", F.col("t").cast("timestamp"))
    frame = P.probe_kpis(probes, sites, "week", "2024-01-01", "2024-01-01", "UTC", Rep.LTE_PROBE_KPIS, ["S2"])
    assert [r["Site"] for r in frame.collect()] == ["S2"]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")
