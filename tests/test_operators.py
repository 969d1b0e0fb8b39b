from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from netquarry.operators import aggregates as A
from netquarry.operators import columns as C
from netquarry.operators import filters as Fl
from netquarry.operators import joins as J
from netquarry.operators import reshape as R
from netquarry.operators import snapshots as S


def test_latest_snapshot_of_class_and_of_other_class(spark, rows):
    cm = spark.createDataFrame(
        [("2024-01-01", "A", 1), ("2024-01-02", "A", 2), ("2024-01-03", "A", 3), ("2024-01-02", "B", 4)],
        "day string, mo_class string, v int",
    ).withColumn("raml_date", F.to_date("day"))
    assert rows(S.latest_snapshot(cm, "A"), "v") == [(3,)]
    assert rows(S.latest_snapshot(cm, "A", dated_by="B"), "v") == [(2,)]
    assert rows(S.latest_snapshot(cm, "none"), "v") == []


def test_latest_snapshot_prunes_partitions(spark, tmp_path):
    cm = spark.range(10).select(
        F.expr("date_add(date'2024-01-01', cast(id as int))").alias("raml_date"),
        F.lit("A").alias("mo_class"),
        "id",
    )
    path = str(tmp_path / "cm")
    cm.write.partitionBy("raml_date", "mo_class").parquet(path)
    newest = S.latest_snapshot(spark.read.parquet(path), "A")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "= Subquery" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert [r["id"] for r in newest.collect()] == [9]


def test_latest_per_key_keeps_ties_and_drops_null_keys(spark, rows):
    history = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 11), ("a", 2, 12), ("b", 1, 13), (None, 9, 14)], "k string, t int, v int"
    )
    assert rows(S.latest_per_key(history, ["k"], "t"), "v") == [(11,), (12,), (13,)]
    assert rows(S.latest_per_key(history, ["k"], "t", as_of=1), "v") == [(10,), (13,)]


def test_one_per_key_has_a_total_order(spark, rows):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q")], "k string, o int, v string"
    )
    assert rows(S.one_per_key(df, ["k"], ["o"]), "k", "v") == [("a", "y"), ("b", "q")]
    plan = S.one_per_key(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_membership_and_nulls(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    ws = spark.createDataFrame([("a",)], "item string")
    assert rows(Fl.members(df, "k", ws)) == rows(Fl.members(df, "k", ["a"])) == [("a",)]
    assert rows(Fl.not_members(df, "k", ws)) == rows(Fl.not_members(df, "k", ["a"])) == [("b",), (None,)]


def test_lists_are_literals_and_frames_a_join(spark, rows):
    df = spark.createDataFrame([("n5",), ("x",), (None,)], "k string")
    names = [f"n{i}" for i in range(10_001)]
    frame = spark.createDataFrame([(n,) for n in names], "item string")
    for wanted, joins in ((names, False), (frame, True)):
        found = Fl.members(df, "k", wanted)
        assert rows(found) == [("n5",)]
        assert rows(Fl.not_members(df, "k", wanted)) == [("x",), (None,)]
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == joins


def test_site_matching_whole_parts_or_prefix(spark, rows):
    df = spark.createDataFrame([("P/M-1/L-1/C-1",), ("P/M-1/L-10/C-1",), ("P/M-1/L-2/C-1",), (None,)], "dn string")
    sites = spark.createDataFrame([("P/M-1/L-1",), ("P/M-1/L-2",), (None,)], "item string")
    assert rows(Fl.in_sites(df, "dn", sites)) == [("P/M-1/L-1/C-1",), ("P/M-1/L-2/C-1",)]
    assert rows(Fl.by_prefix(df, "dn", sites)) == [("P/M-1/L-1/C-1",), ("P/M-1/L-10/C-1",), ("P/M-1/L-2/C-1",)]


def test_prefix_match_keeps_copies_once_per_row(spark, rows):
    df = spark.createDataFrame([("A-10", 1), ("A-10", 2)], "dn string, v int")
    prefixes = spark.createDataFrame([("A-1",), ("A-10",), ("A",)], "item string")
    assert rows(Fl.by_prefix(df, "dn", prefixes), "v") == [(1,), (2,)]


def test_differs(spark, rows):
    data = [("a", "a"), ("a", "b"), (None, "a"), ("a", None), (None, None)]
    df = spark.createDataFrame(data, "x string, y string")
    assert rows(df.where(Fl.differs("x", "y"))) == sorted(data[1:], key=repr)


def test_thresholds_and_windows(spark, rows):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (None, 1.0)], "v double, th double")
    assert rows(Fl.at_least(df, "v", 2)) == [(2.0, 2.0), (3.0, 2.0)]
    assert rows(Fl.above(df, "v", "th")) == [(3.0, 2.0)]
    times = spark.createDataFrame([("2024-01-07 00:00:00",), ("2024-01-07 00:00:01",)], "s string").withColumn(
        "t", F.col("s").cast("timestamp")
    )
    assert rows(Fl.trailing_days(times, "t", 3, "2024-01-10"), "s") == [("2024-01-07 00:00:01",)]


def test_equi_join_null_rules(spark, rows):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 3), (None, 4)], "k string, w int")
    assert rows(J.equi_join(left, right, ["k"])) == [("a", 1, 3)]
    assert rows(J.equi_join(left, right, ["k"], null_safe=True)) == [("a", 1, 3), (None, 2, 4)]
    assert rows(J.equi_join(left, right.withColumnRenamed("k", "j"), [("k", "j")])) == [("a", 1, "a", 3)]
    assert rows(J.missing_relations(left, right, ["k"])) == [(None, 2)]


@pytest.mark.parametrize("tolerance", [0, 5, 20, 90, 100, 170, 180])
def test_ring_join_is_the_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    angles = [0.0, 10.0, 20.0, 340.0, 350.0, 360.0, -10.0] + [rng.uniform(0, 360) for _ in range(60)]
    data = [(rng.choice("ab"), a, i) for i, a in enumerate(angles)] + [("a", None, 99)]
    left = spark.createDataFrame(data, "g string, x double, i int")
    right = spark.createDataFrame(data, "g string, y double, j int")
    got = J.join_within_angle(left, right, "g", "x", "y", tolerance)

    def gap(x, y):
        return abs((x - y + 180) % 360 - 180)

    expected = sorted(
        (i, j) for g, x, i in data for h, y, j in data
        if g == h and x is not None and y is not None and gap(x, y) <= tolerance
    )
    assert sorted((r["i"], r["j"]) for r in got.collect()) == expected


def test_neighbour_pairs(spark, rows):
    cells = spark.createDataFrame(
        [
            ("s1", "c1", "f1", "7"), ("s2", "c2", "f1", "7"), ("s2", "c3", "f2", "7"), ("s3", "c4", "f1", "7"),
            ("s1", "c5", "f1", None), ("s2", "c6", "f1", None),
        ],
        "LNBTS_id string, LNCEL_Name string, earfcnDL string, pci string",
    )
    links = spark.createDataFrame([("s1", "s2")], "LNBTS_id string, adjEnbId string")
    names = [f"c{i}" for i in range(1, 7)]
    pairs = spark.createDataFrame(
        [(a, b) for a in names for b in names], "LNCEL_Name_Orig string, LNCEL_Name_Dest string"
    )
    shown = ("LNCEL_Name_Orig", "LNCEL_Name_Dest")
    assert rows(J.neighbour_pairs(pairs, cells, links, "pci"), *shown) == [("c1", "c2")]
    loose = J.neighbour_pairs(pairs, cells, links, "pci", null_safe=True)
    assert rows(loose, *shown) == [("c1", "c2"), ("c5", "c6")]
    assert rows(J.neighbour_pairs(pairs.where("LNCEL_Name_Dest = 'c3'"), cells, links, "pci")) == []


def test_assign_site(spark, rows):
    df = spark.createDataFrame([("P/M-1/L-10/C-1",), ("P/M-9/L-9/C-1",), (None,)], "dn string")
    sites = spark.createDataFrame([("P/M-1/L-1", 2), ("P/M-1/L-10", 1), ("", 5)], "item string, pos int")
    assert rows(J.assign_site(df, "dn", sites)) == [
        ("P/M-1/L-10/C-1", "P/M-1/L-10"), ("P/M-9/L-9/C-1", ""), (None, "")
    ]
    literal = dict(rows(J.assign_site(df, "dn", sites, literal=True)))
    assert literal["P/M-1/L-10/C-1"] == "P/M-1/L-1"


def test_share_is_truncated(spark, rows):
    df = spark.createDataFrame([("a", "x", 23), ("a", "y", 76), ("z", "x", 0)], "g string, k string, n bigint")
    assert rows(A.share_of_total(df, ["g"], "n"), "k", "total", "share") == [("x", 0, None), ("x", 99, 23), ("y", 99, 76)]


def test_grouped_sums_and_minimums(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), (None, 5)], "k string, v int")
    assert rows(A.grouped_sums(df, ["k"], ["v"])) == [("a", 1), ("b", 0)]
    assert rows(A.column_minimums(df, "k", ["v"])) == [("a", 1), ("b", None)]


def test_multi_valued_and_disagreeing(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", None)], "k string, v double")
    assert rows(A.multi_valued(df, "k", "v")) == [("a", 3, 2)]
    assert rows(A.disagreeing_values(df, "k", "v")) == [("a", [1.0, 2.0], [1, 2])]


def test_deviation_summary(spark, rows):
    totals = spark.createDataFrame([("a", 3), ("b", 4)], "k string, total bigint")
    deviated = spark.createDataFrame([("a", 1)], "k string, deviated bigint")
    assert rows(A.deviation_summary(totals, deviated, ["k"])) == [("a", 3, 1, 33.33)]
    kept = A.deviation_summary(totals, deviated, ["k"], exclude_zero=False)
    assert rows(kept) == [("a", 3, 1, 33.33), ("b", 4, 0, 0.0)]


def test_split_by_scale_is_the_best_cut(spark):
    peaks = {"a": 1.0, "b": 3.0, "c": 0.0, "d": 9000.0, "e": 40000.0}
    long = spark.createDataFrame([(k, v) for k, v in peaks.items()] + [("f", None)], "KPI string, Value double")
    got = {r["KPI"]: r["Cluster"] for r in A.split_kpis_by_scale(long).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 0}
    rng = random.Random(3)
    for _ in range(4):
        made = {f"k{i}": 10 ** rng.uniform(-2, 6) for i in range(rng.randint(2, 9))}
        logs = {k: math.log10(v) for k, v in made.items()}

        def spread_around_mean(side):
            return sum((x - sum(side) / len(side)) ** 2 for x in side) if side else 0.0

        def cost(cut):
            sides = [[x for x in logs.values() if x <= cut], [x for x in logs.values() if x > cut]]
            return sum(map(spread_around_mean, sides))

        cut = min(logs.values(), key=cost)
        frame = spark.createDataFrame(list(made.items()), "KPI string, Value double")
        got = {r["KPI"]: r["Cluster"] for r in A.split_kpis_by_scale(frame).collect()}
        assert got == {k: int(x > cut) for k, x in logs.items()}
    one = long.where("KPI = 'd'")
    assert [r["Cluster"] for r in A.split_kpis_by_scale(one).collect()] == [0]
    equal = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "KPI string, Value double")
    assert {r["Cluster"] for r in A.split_kpis_by_scale(equal).collect()} == {0}


def test_pivot_refuses_copies(spark, rows):
    long = spark.createDataFrame([("t", "x", 1.0), ("t", "y", 2.0)], "k string, n string, v double")
    assert rows(R.pivot_values(long, ["k"], "n", "v", ["x", "y", "z"])) == [("t", 1.0, 2.0, None)]
    with pytest.raises(Exception, match="more than one row"):
        R.pivot_values(long.union(long), ["k"], "n", "v", ["x", "y"]).collect()


def test_melt_and_transpose(spark, rows):
    df = spark.createDataFrame([("d1", 1.0, None), ("d2", 2.0, 3.0)], "d string, a double, b double")
    assert rows(R.melt(df, ["d"], ["a", "b"])) == [("d1", "a", 1.0), ("d1", "b", None), ("d2", "a", 2.0), ("d2", "b", 3.0)]
    assert rows(R.transpose(df, "d", ["b", "a"], ["d1", "d2"], fill="-9999")) == [(0, "b", "-9999", "3.0"), (1, "a", "1.0", "2.0")]


def test_lists(spark, rows):
    df = spark.createDataFrame(
        [(1, {"l": ["x", None, "y"], "e": []}), (2, {"l": None}), (3, None)], "i int, p_lists map<string,array<string>>"
    )
    assert rows(R.explode_lists(df)) == [(1, "l", 0, "x"), (1, "l", 2, "y")]
    items = spark.createDataFrame(
        [(1, {"l": [{"f": "1"}, {"f": "2"}]}), (2, {"l": []}), (3, {})], "i int, m map<string,array<map<string,string>>>"
    )
    assert rows(R.first_items(items, "m", "l", ["f", "g"], keep=["i"])) == [(1, "1", None), (2, None, None), (3, None, None)]


def test_report_schema_and_columns(spark, rows):
    df = spark.createDataFrame([(1.0, "x")], "a double, `b c` string")
    full = C.with_report_schema(df, ["b c", "z", "a"])
    assert full.columns == ["b c", "z", "a"] and rows(full) == [("x", None, 1.0)]
    assert C.last_of_equal_names(["Mode", "x", "mode"]) == ["x", "mode"]
    doubled = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("K", "b", "k")
    assert C.dedupe_columns(doubled).columns == ["b", "k"]


def test_narrow_integers(spark):
    df = spark.createDataFrame([("1", "1", "1", "2"), ("-2", "x", None, "2.5")], "a string, b string, c string, d string")
    assert dict(C.narrow_integers(df).dtypes) == {"a": "bigint", "b": "string", "c": "string", "d": "string"}
    assert dict(C.narrow_integers(df, ["a", "d"], otherwise_double=True).dtypes) == {
        "a": "bigint", "b": "string", "c": "string", "d": "double"
    }
