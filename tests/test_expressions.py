from __future__ import annotations

import math
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquarry.functions import dates as D
from netquarry.functions import maps as M
from netquarry.functions import numeric as N
from netquarry.functions import text as X


def values(spark, data, schema, expression):
    df = spark.createDataFrame(data, schema).withColumn("out", expression)
    return [r["out"] for r in df.collect()]


SLICES = ["PLMN/LNBTS-1/LNCEL-3", "LNCEL-1", "", "A", "AB", "no token", "xLNCEL", "/LNCEL"]


@pytest.mark.parametrize("back", [0, 1])
def test_text_before_is_the_python_slice(spark, back):
    got = values(spark, [(t,) for t in SLICES], "t string", X.text_before("t", "LNCEL", back))
    assert got == [t[: t.find("LNCEL") - back] for t in SLICES]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="AB_/-", max_size=8), min_size=1, max_size=20))
def test_text_before_property(spark, texts):
    got = values(spark, [(t,) for t in texts], "t string", X.text_before("t", "_", 1))
    assert got == [t[: t.find("_") - 1] for t in texts]


def test_text_before_null(spark):
    assert values(spark, [(None,)], "t string", X.text_before("t", "_")) == [None]


def test_target_cell_id(spark):
    names = [("P/ECGI/ECI-778/PLMN-PLMN/M-1",), ("P/ECI-5/PLMN-1",), ("P/X-5/PLMN",), ("P/ECI-5",)]
    assert values(spark, names, "t string", X.target_cell_id("t")) == ["778", "5", None, None]


def test_dn_parts(spark):
    dn = [("PLMN-PLMN/RNC-7/WBTS-12/WCEL-3",), ("none",)]
    assert values(spark, dn, "t string", X.nth_integer("t", 2)) == ["12", None]
    assert values(spark, dn, "t string", X.parent_dn("t", "/WCEL")) == ["PLMN-PLMN/RNC-7/WBTS-12", ""]


def test_names_and_codes(spark):
    files = [("dump_rc12_rc3.xml",), ("nothing",)]
    assert values(spark, files, "t string", X.controller_code("t")) == ["RC12", ""]
    sites = [("PLMN-PLMN/MRBTS-1/LNBTS-1",), ("PLMN-PLMN/MRBTS-1/LNBTS-1/LNCEL-2",)]
    assert values(spark, sites, "t string", X.is_site_dn("t")) == [True, False]
    cells = [("x ABC.y_1",), ("AB_1",)]
    assert values(spark, cells, "t string", X.looks_like_cell_name("t")) == [True, False]
    assert values(spark, [("a,b",)], "t string", X.split_list("t")) == [["a", "b"]]
    assert values(spark, [("K1 - name",)], "t string", X.first_token("t")) == ["K1"]
    assert values(spark, [("2024-05-06 01:00:00",)], "t string", X.compact_day("t")) == ["20240506"]


def test_week_of_year_over_eleven_years(spark):
    days = [date(2015, 1, 1) + timedelta(days=i) for i in range(4000)]
    got = values(spark, [(d,) for d in days], "d date", D.week_of_year("d"))
    assert got == [int(d.strftime("%W")) for d in days]


def test_weekday_name(spark):
    assert values(spark, [(date(2024, 1, 7),)], "d date", D.weekday_name("d")) == ["SUNDAY"]


def test_local_bucket_west_of_utc(spark):
    # 23:30 on the 4th in Bogota is 04:30 on the 5th in UTC.
    expression = F.date_format(
        D.local_bucket(F.col("t").cast("timestamp"), "day", "America/Bogota"), "yyyy-MM-dd"
    )
    assert values(spark, [("2024-01-05 04:30:00",)], "t string", expression) == ["2024-01-04"]
    with pytest.raises(ValueError):
        D.local_bucket("t", "fortnight", "UTC")


@pytest.mark.parametrize("inclusive, expected", [(False, [False, True, True, False]), (True, [False, True, True, True])])
def test_local_day_bounds(spark, inclusive, expected):
    data = [(t,) for t in ("2024-01-05 04:59:59", "2024-01-05 05:00:00", "2024-01-07 04:59:59", "2024-01-07 05:00:00")]
    inside = D.within_local_days(
        F.col("t").cast("timestamp"), "2024-01-05", "2024-01-06", "America/Bogota", inclusive
    )
    assert values(spark, data, "t string", inside) == expected


@pytest.mark.parametrize(
    "days, unit, start_shift, expected",
    [(20, "Hour", 20, "hour"), (21, "Hour", 21, "day"), (45, "Day", 45, "day"), (46, "Week", 45, "week")],
)
def test_clamp_range(days, unit, start_shift, expected):
    end = date(2024, 6, 30)
    asked = end - timedelta(days=days)
    got = D.clamp_range(asked, str(end), unit, D.MAX_HOURLY_DAYS, D.MAX_RANGE_DAYS)
    assert (got.start, got.end, got.unit) == (end - timedelta(days=start_shift), end, expected)
    assert got.cut_days == days - start_shift
    assert D.clamp_range(asked, end, unit) == D.ReportRange(asked, end, unit.lower(), 0)


def test_ports(spark):
    data = [(-100.0, 0.0, -90.0, None), (0.0, 0.0, 0.0, 0.0), (-5.0, 0.0, 0.0, 0.0)]
    ports = ["a", "b", "c", "d"]
    schema = "a double, b double, c double, d double"
    assert values(spark, data, schema, N.port_spread(ports)) == [10.0, None, 0.0]
    assert values(spark, data[1:], schema, N.port_mean(ports)) == [None, -5.0]


def test_angle_gap(spark):
    data = [(350.0, 10.0), (10.0, 350.0), (0.0, 180.0), (90.0, 90.0)]
    assert values(spark, data, "a double, b double", N.angle_gap("a", "b")) == [20, 20, 180, 0]


def test_distance_on_the_ellipsoid(spark):
    # Lengths on the WGS84 ellipsoid: one degree of longitude and of latitude at the equator.
    data = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (4.6, -74.1, 4.6, -74.1)]
    schema = "a double, b double, c double, d double"
    got = values(spark, data, schema, N.distance_m("a", "b", "c", "d"))
    for mine, exact in zip(got, [111319.491, 110574.389, 0.0], strict=True):
        assert math.isclose(mine, exact, abs_tol=1.0)


def test_ratios(spark):
    data = [(10, 2), (0, 0), (None, 1)]
    assert values(spark, data, "tx int, lost int", N.delivery_ratio("tx", "lost")) == [80.0, None, None]
    assert values(spark, [(1, 3)], "a int, b int", N.percent("a", "b")) == [33.33]
    assert values(spark, [(None, 2.0)], "a double, b double", N.row_max("a", "b")) == [2.0]
    assert values(spark, [(0.0,), (-100.0,)], "a double", N.log_magnitude("a")) == [-1.0, 2.0]


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": None}, ["x", "x"])], "m map<string,string>, l array<string>")
    row = df.select(
        *M.map_columns("m", {"a": "one", "z": "none"}),
        M.first_item("l").alias("head"),
        M.distinct_size("l").alias("n"),
        M.first_item(F.array().cast("array<string>")).alias("empty"),
    ).first()
    assert tuple(row) == ("1", None, "x", 1, None)


def test_decode_records(spark):
    df = spark.createDataFrame([('[{"k": 1}, {"j": 2}]',)], "t string")
    got = df.select(F.inline(M.decode_records("t", "k int"))).collect()
    assert [r["k"] for r in got] == [1, None]


def test_the_hour_that_clocks_repeat_is_one_bucket(spark):
    times = spark.createDataFrame([("2024-11-03 05:30:00",), ("2024-11-03 06:30:00",), ("2024-11-03 07:30:00",)], "t string")
    bucket = D.local_bucket(F.col("t").cast("timestamp"), "hour", "America/New_York")
    got = [r["b"] for r in times.select(F.date_format(bucket, "HH:mm").alias("b")).orderBy("t").collect()]
    assert got == ["01:00", "01:00", "02:00"]
