"""What plans shuffle, sort and read: each of these was once done twice, or with more than was needed."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from checks import all_queries
from checks import audits
from netquarry import plans as P
from netquarry.operators.filters import maybe_member
from netquarry.operators.snapshots import latest_per_key
from netquarry.plans.reports import controllers

DAY = datetime.datetime(2024, 1, 1)


def text_of(frame, kind="executedPlan"):
    return getattr(frame._jdf.queryExecution(), kind)().toString()


@pytest.fixture
def plain_joins(spark):
    """No broadcasts, as with large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_newest_records_are_cut_before_one_shuffle(spark, rows):
    history = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 2.0), ("b", None, 3.0), (None, 3, 4.0), ("c", 1, None)],
        "k string, t int, v double",
    )
    newest = latest_per_key(history, ["k"], "t")
    plan = text_of(newest)
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2 and "Join" not in plan
    assert rows(newest) == [("a", 2, 2.0), ("a", 2, 2.0), ("c", 1, None)]
    assert newest.columns == ["k", "t", "v"]
    # A floating key that is not a number is a key.
    numbers = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2)], "k double, t int")
    assert [r["t"] for r in latest_per_key(numbers, ["k"], "t").collect()] == [2]


def test_views_keep_only_the_columns_of_the_run(spark):
    history = spark.createDataFrame(
        [("PLMN-PLMN/MRBTS-1/LNBTS-1/LNCEL-1", "A_1", "A", "c", "b", "other", DAY)],
        "moDistName string, sector_name string, site_name string, level_2 string, band string, more string, export_date timestamp",
    )
    views = P.SiteViews(history, ["moDistName", "sector_name", "site_name", "level_2", "band"])
    view = views.at("sector_name")
    assert "more" not in views.newest().columns
    # The view of cells is read from the file of the newest records, not written once more.
    assert view.inputFiles() == views.newest().inputFiles()
    assert [tuple(r) for r in view.collect()] == [("PLMN-PLMN/MRBTS-1/LNBTS-1/LNCEL-1", "A_1", "A", "c", "b")]


def test_controllers_are_dealt_by_cell_once(spark, plain_joins):
    history = spark.createDataFrame(
        [("PLMN-PLMN/RNC-1/WBTS-2/WCEL-3", "A_1", "RNC1", DAY)],
        "moDistName string, sector_name string, rnc_name string, export_date timestamp",
    )
    cells = spark.range(3).select(F.concat(F.lit("A_"), "id").alias("Cell"), "id")
    views = P.SiteViews(history)
    plan = text_of(cells.join(controllers(views, "rnc_name"), "Cell"))
    assert plan.count("Exchange hashpartitioning") == 2


def test_dump_is_written_without_a_sort(spark):
    """Days and classes of a dump are written side by side; a task does not hold its rows to sort them."""
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 6


def test_template_needs_no_sort(spark, monkeypatch):
    frames = []
    plain = DataFrameWriter.__init__

    def recording(self, df):
        frames.append(df)
        plain(self, df)

    monkeypatch.setattr(DataFrameWriter, "__init__", recording)
    template = audits._template(spark, "/root/testdata/sf0.001")
    assert "SortAggregate(key=[Object" not in text_of(frames[0])
    assert template.count() == 7


def test_tilts_are_dealt_by_what_they_join(spark, plain_joins):
    """Channels, cells, units and tilts are shuffled once each, and the mixed tilts need no further shuffle."""
    frames = all_queries()["C12_audit_tilt_same_sector"](spark, "/root/testdata/sf0.001")
    plan = text_of(frames)
    assert plan.count("Exchange hashpartitioning(name") == 1
    assert plan.count("Exchange hashpartitioning(MRBTS_id") == 4


def test_neighbours_are_dealt_once_by_name(spark, plain_joins):
    """Handovers are made distinct where they lie, and the adjacent sites come from a file."""
    plan = text_of(all_queries()["J09_neighbour_pairs"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning(LNCEL_Name_Orig") == 2
    assert "hashpartitioning(o_custkey" not in plan and "mo_distname" not in plan


@pytest.fixture
def written(monkeypatch):
    """Frames in the order in which they are written."""
    frames = []
    plain = DataFrameWriter.__init__

    def recording(self, df):
        frames.append(df)
        plain(self, df)

    monkeypatch.setattr(DataFrameWriter, "__init__", recording)
    return frames


@pytest.mark.parametrize("name", ["C05_audit_code_conflicts", "C06_audit_root_conflicts"])
def test_conflicts_are_found_before_cells_are_placed(spark, plain_joins, written, name):
    all_queries()[name](spark, "/root/testdata/sf0.001")
    # Pairs of like cells carry no place, and are dealt by each end once; only then are cells placed.
    like = next(text_of(df) for df in written if "LNCEL_Name_Orig" in df.columns)
    assert "latitud" not in like and "site_name" not in like
    assert like.count("Exchange hashpartitioning(LNCEL_Name_Dest") == 1 and "Exchange hashpartitioning(LNCEL_Name_Orig" not in like
    placed = next(text_of(df) for df in written if "latitud" in df.columns)
    assert placed.count("Subquery") >= 2 and "xxhash64(mo_distname" in placed
    # Relations that no pair asks for are left out before they are made distinct, let alone joined with the sites.
    relations = next(text_of(df) for df in written if df.columns == ["LNBTS_id_Orig", "LNBTS_id_Dest"])
    joined = [line for line in relations.splitlines() if "SortMergeJoin [l_partkey" in line]
    assert any("xxhash64" in line for line in joined)
    # Counters are dealt once by name, not by site, pair and name.
    sums = next(text_of(df) for df in written if df.columns[0] == "sector_name")
    assert sums.count("Exchange hashpartitioning(distName") == 2 and "M8015C9" not in sums


def test_bitmap_as_a_condition_loses_no_member(spark, rows):
    numbers = spark.range(20000).select(F.concat(F.lit("d"), "id").alias("name"), (F.col("id") % 7).alias("k"))
    wanted = numbers.where("k = 3").select("name")
    passed = numbers.where(maybe_member(F.col("name"), wanted))
    assert passed.join(wanted, "name", "left_semi").count() == wanted.count() <= passed.count() < 1.02 * wanted.count()
    assert numbers.where(maybe_member(F.col("name"), wanted.limit(0))).count() == 0
    # Several columns are a struct, and the condition goes below a distinct.
    pairs = spark.createDataFrame([("d1", 1)], "x string, y bigint").select(F.struct("x", "y"))
    found = numbers.distinct().where(maybe_member(F.struct("name", "k"), pairs))
    plan = text_of(found, "optimizedPlan")
    assert plan.index("Aggregate [name") < plan.index("Filter")
    assert rows(found) == [("d1", 1)]
