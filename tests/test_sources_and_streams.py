from __future__ import annotations

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netquarry import sources as IO
from netquarry.operators.aggregates import time_rollup
from netquarry.operators.snapshots import latest_snapshot
from netquarry import session
from netquarry.session import prepare, resolved, work_folder
from netquarry.streaming import stream_rollup


def test_readers(spark, tmp_path, rows):
    (tmp_path / "set.csv").write_text("BOG.One\nBOG.Two 23\n")
    assert rows(IO.read_working_set(spark, str(tmp_path / "set.csv"))) == [("BOG.One",), ("BOG.Two 23",)]
    (tmp_path / "t.csv").write_text("Object;Parameter;Value\nLNCEL;p;007\n")
    assert rows(IO.read_template(spark, str(tmp_path / "t.csv"))) == [("LNCEL", "p", "007")]
    (tmp_path / "k.json").write_text('[{"Date": "d", "Cell": "c", "K": 1.5}, {"Date": "e", "Cell": "c"}]\n')
    frame = IO.read_kpi_frame(spark, str(tmp_path / "k.json"), ["K", "J"])
    assert rows(frame) == [("d", "c", 1.5, None), ("e", "c", None, None)]


def test_catalog_fills_and_labels(spark, rows):
    raw = spark.createDataFrame([("K1", None)], "KPI_Id string, Name string")
    assert rows(IO.kpi_catalog(raw)) == [("K1", "", "K1 - ")]


def test_tables_are_replaced(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS dumps")
    for value in (1, 2):
        IO.write_class_tables({"A": spark.range(value, value + 1), "B": spark.range(0)}, "dumps", as_tables=True)
    assert rows(spark.table("dumps.A")) == [(2,)]
    assert rows(IO.read_sites(spark, "dumps.{technology}", "A")) == [(2,)]


def test_report_files_are_in_order(spark, tmp_path):
    # One element holds a third of all rows; its periods must still spread over files.
    report = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("cell name"), F.col("id").alias("t")
    )
    path = str(tmp_path / "report")
    IO.write_report(report, path, ["cell name", "t"], partitions=8)
    files = sorted(glob.glob(f"{path}/part-*.parquet"))
    read = [tuple(r) for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
    assert read == sorted(read) and len(read) == 3000
    assert sum(any(r[0] == 7 for r in spark.read.parquet(f).collect()) for f in files) > 1


def test_bundle(spark, tmp_path, rows):
    def broken():
        raise RuntimeError("no source")
    bundle, skipped = IO.bundle_audits({"a": spark.range(1), "b": lambda: spark.createDataFrame([(None,)], "x string"), "c": broken})
    assert rows(bundle) == [("a", '{"id":0}'), ("b", '{"x":null}')] and list(skipped) == ["c"]
    IO.write_bundle(bundle, str(tmp_path / "bundle"))
    assert rows(spark.read.parquet(str(tmp_path / "bundle")).where("audit = 'a'"), "row") == [('{"id":0}',)]
    assert IO.bundle_audits({"c": broken})[0] is None


def test_audit_files(spark, tmp_path):
    paths = IO.write_audit({"summary": spark.range(2)}, str(tmp_path), file_format="csv")
    assert spark.read.csv(paths["summary"], header=True).count() == 2


@pytest.mark.parametrize("as_table", [False, True])
def test_dump_reads_the_files_of_one_day(spark, tmp_path, as_table):
    """The newest day is looked up in the listing, per class, and only its files are read."""
    days = spark.range(40).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("raml_date"), "id")
    cm = days.select(
        "raml_date", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("mo_class"), F.concat(F.lit("dn"), "id").alias("mo_distname")
    ).where("mo_class = 'A' or id < 30")
    location = "dump_table" if as_table else str(tmp_path / "cm")
    writer = cm.write.partitionBy("raml_date", "mo_class")
    writer.mode("overwrite").saveAsTable(location) if as_table else writer.parquet(location)
    dump = IO.Dump(spark, location)
    assert str(dump.newest()) == "2024-02-09" and str(dump.newest("B")) == "2024-01-30" and dump.newest("C") is None
    for dated_by, expected in ((None, "dn39"), ("B", "dn29")):
        newest = latest_snapshot(dump, "A", dated_by)
        assert [r["mo_distname"] for r in newest.collect()] == [expected]
        if not as_table:
            assert len({f.split("raml_date=")[1][:10] for f in newest.inputFiles()}) == 1
        plan = newest._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Subquery" not in plan
    assert latest_snapshot(dump, "C").count() == 0
    if as_table:
        spark.sql("DROP TABLE dump_table")


def test_a_deliverable_that_fails_in_a_task_leaves_the_others(spark, tmp_path):
    good = spark.range(3).withColumn("x", F.lit(None).cast("string"))
    bad = spark.range(3).select(F.raise_error(F.concat(F.lit("row "), "id")).alias("x"))

    def missing():
        raise RuntimeError("no counters")

    done, failed = IO.deliver_audits({"good": good, "bad": bad, "late": missing, "more": lambda: good}, str(tmp_path / "bundle"))
    assert done == ["good", "more"] and sorted(failed) == ["bad", "late"] and "row" in failed["bad"]
    got = spark.read.parquet(str(tmp_path / "bundle"))
    assert sorted((r["audit"], r["row"]) for r in got.collect())[0] == ("good", '{"id":0,"x":null}') and got.count() == 6


def test_prepare_keeps_what_its_owner_set(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert prepare(spark).conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        spark.conf.unset("spark.sql.adaptive.forceOptimizeSkewedJoin")
        assert prepare(spark).conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_work_folders_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(session, "_HANDED_OUT", {})
    kept, other = resolved(spark.range(3), "a"), resolved(spark.range(4), "b")
    assert kept.count() + other.count() == 7 and session.clear_work(spark) == 2
    assert not glob.glob(kept.inputFiles()[0].removeprefix("file://")) and session.clear_work(spark) == 0


def test_work_folder_uses_the_shared_setting(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = work_folder(spark, "x"), work_folder(spark, "x")
    assert first.startswith(shared) and first != second


def test_stream_equals_batch_on_closed_windows(spark, tmp_path, rows):
    start = datetime(2024, 1, 1)
    data = [
        (start + timedelta(minutes=15 * i), f"cell{i % 3}", i) for i in range(200) for _ in range(1 + i % 2)
    ]
    folder = str(tmp_path / "in")
    spark.createDataFrame(data, "measTime timestamp, cell string, n int").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("measTime timestamp, cell string, n int").parquet(folder)
    rolled = stream_rollup(stream, "hour", ["cell"], {"total": F.sum("n")}, ["measTime", "cell"], delay="30 minutes")
    query = (
        rolled.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    batch = time_rollup(
        spark.read.parquet(folder).distinct(), "hour", "UTC", {"cell": F.col("cell")}, {"total": F.sum("n")}
    )
    end = max(d[0] for d in data) - timedelta(minutes=30)
    closed = batch.where(F.col("measTime") + F.expr("interval 1 hour") <= F.lit(end))
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert got == rows(closed) and len(got) > 100


@pytest.mark.parametrize("delay", ["10 minutes", "1 hour"])
def test_stream_keeps_the_hour_that_clocks_repeat(spark, tmp_path, rows, delay):
    data = [("2024-11-03 05:30:00", "a"), ("2024-11-03 06:30:00", "a"), ("2024-11-03 06:30:00", "a"), ("2024-11-09 00:00:00", "z")]
    for i, row in enumerate(data):
        frame = spark.createDataFrame([row], "t string, cell string")
        frame.select(F.col("t").cast("timestamp").alias("measTime"), "cell").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("measTime timestamp, cell string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rolled = stream_rollup(
        stream, "day", ["cell"], {"n": F.count("*")}, ["measTime", "cell"], tz="America/New_York", delay=delay
    )
    query = (
        rolled.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "cell", "n") == [("a", 2)]


@pytest.mark.parametrize(
    "unit, closing, open_still",
    [
        # Clocks go forward on 10 March 2024, back on 3 November; local midnight is 05:00 or 04:00 UTC.
        ("day", "2024-03-11 04:10:00", "2024-03-11 04:09:59"),
        ("day", "2024-11-04 05:10:00", "2024-11-04 05:09:59"),
        ("week", "2024-03-11 04:10:00", "2024-03-11 04:09:59"),
        ("hour", "2024-03-10 07:10:00", "2024-03-10 07:09:59"),
    ],
)
def test_a_window_closes_by_the_utc_instant(spark, tmp_path, unit, closing, open_still):
    """The watermark trails by the delay exactly, also where the zone's offset changes."""
    inside = {"day": 3, "week": 3, "hour": 0.5}[unit]
    for name, last, expected in (("closed", closing, 1), ("open", open_still, 0)):
        first = datetime.fromisoformat(closing) - timedelta(minutes=10) - timedelta(hours=inside)
        for i, t in enumerate([first.isoformat(sep=" "), last, last]):
            frame = spark.createDataFrame([(t, f"c{min(i, 1)}")], "t string, cell string")
            frame.select(F.col("t").cast("timestamp").alias("measTime"), "cell").coalesce(1).write.mode("append").parquet(
                str(tmp_path / name / "in")
            )
        stream = spark.readStream.schema("measTime timestamp, cell string").option("maxFilesPerTrigger", 1).parquet(
            str(tmp_path / name / "in")
        )
        rolled = stream_rollup(
            stream, unit, ["cell"], {"n": F.count("*")}, ["measTime", "cell"], tz="America/New_York", delay="10 minutes"
        )
        query = (
            rolled.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True)
            .start(str(tmp_path / name / "out"))
        )
        query.awaitTermination()
        got = spark.read.schema("measTime timestamp, cell string, n long").parquet(str(tmp_path / name / "out"))
        assert [(r["cell"], r["n"]) for r in got.collect()] == [("c0", 1)] * expected


@pytest.mark.parametrize("bounds, expected", [({"start": "2024-01-02"}, [1, 2]), ({"end": "2024-01-02"}, [0, 1])])
def test_each_time_bound_holds_by_itself(spark, tmp_path, bounds, expected):
    path = str(tmp_path / "pm")
    days = spark.range(3).select(F.expr("timestamp'2024-01-01 12:00:00' + make_dt_interval(id)").alias("measTime"), "id")
    days.write.parquet(path)
    assert sorted(r["id"] for r in IO.read_counters(spark, path, **bounds).collect()) == expected


def test_stream_units(spark):
    with pytest.raises(ValueError):
        stream_rollup(spark.range(1), "month", [], {}, [])


def test_time_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "pm")
    spark.range(3).select(F.current_timestamp().alias("measTime"), "id").write.parquet(path)
    chosen = IO.read_counters(spark, path, "2024-01-01", "2024-01-02", "America/Bogota").select("id")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(measTime,2024-01-01 05:00:00.0)" in plan
    assert "LessThan(measTime,2024-01-03 05:00:00.0)" in plan
