"""Sources and sinks: what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as s
from checks.basics import stamp
from checks.registry import check
from netquarry import plans as P
from netquarry import sources as IO
from netquarry.operators.filters import at_least
from netquarry.session import work_folder


@check(
    "S01_read_cm",
    f"""WITH {s.cm_sql("LNCEL")} SELECT '2024-03-02' AS day, 'LNCEL' AS mo_class, mo_distname, tac FROM cm_lncel""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "cm")
    dump = s.cm(spark, d, ["LNBTS", "LNCEL", "WCEL"])
    dump.write.partitionBy("raml_date", "mo_class").parquet(folder)
    cm = IO.read_cm(spark, folder, mo_class="LNCEL", day="2024-03-02")
    return cm.select(
        F.col("raml_date").cast("string").alias("day"),
        "mo_class",
        "mo_distname",
        F.element_at("parameters", F.lit("tac")).alias("tac"),
    )


@check(
    "S02_read_sites",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.history_sql("LTE")}, {s.history_sql("UMTS")}
SELECT 'LTE' AS tech, sector_name, azimuth FROM hist_lte UNION ALL SELECT 'UMTS', sector_name, azimuth FROM hist_umts""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "sites")
    parts = []
    for technology in ("LTE", "UMTS"):
        s.site_history(spark, d, technology).write.parquet(f"{folder}/{technology}")
        sites = IO.read_sites(spark, folder + "/{technology}", technology)
        parts.append(sites.select(F.lit(technology).alias("tech"), "sector_name", "azimuth"))
    return parts[0].unionByName(parts[1])


@check(
    "S03_read_counters",
    """SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS t FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01 05:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 05:00:00'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    counters = IO.read_counters(
        spark, f"{d}/lineitem.parquet", "1997-01-01", "1997-12-31", "America/Bogota", ts="l_shipdate"
    )
    return counters.select("l_orderkey", "l_linenumber", "l_partkey", stamp("l_shipdate").alias("t"))


@check(
    "S04_read_kpi_catalog",
    """SELECT concat('P', p_partkey) AS "KPI_Id", coalesce(nullif(p_brand, 'Brand#1'), '') AS "Name",
concat('P', p_partkey, ' - ', coalesce(nullif(p_brand, 'Brand#1'), '')) AS "ID" FROM part""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "catalog")
    s.table(spark, d, "part").select(
        F.expr("concat('P', p_partkey)").alias("KPI_Id"),
        F.nullif("p_brand", F.lit("Brand#1")).alias("Name"),
    ).write.parquet(folder)
    return IO.read_kpi_catalog(spark, folder)


@check("S05_read_working_set", "SELECT c_name AS item FROM customer WHERE c_acctbal > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "set")
    customer = s.table(spark, d, "customer").where(F.col("c_acctbal") > 0)
    customer.select("c_name").write.csv(folder)
    return IO.read_working_set(spark, folder)


@check(
    "S06_read_template",
    """SELECT p_brand AS "Object", p_type AS "Parameter", cast(p_size AS VARCHAR) AS "Value" FROM part""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "template")
    s.table(spark, d, "part").select(
        F.col("p_brand").alias("Object"), F.col("p_type").alias("Parameter"), F.col("p_size").alias("Value")
    ).write.option("header", True).option("sep", ";").csv(folder)
    return IO.read_template(spark, folder)


@check(
    "S07_read_kpi_frame",
    """SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "Date", cast(l_suppkey AS VARCHAR) AS "Cell", sum(l_quantity) AS qty, cast(NULL AS DOUBLE) AS absent
FROM lineitem GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "records")
    s.table(spark, d, "lineitem").groupBy(
        stamp("l_shipdate").alias("Date"), F.col("l_suppkey").cast("string").alias("Cell")
    ).agg(F.sum("l_quantity").alias("qty")).write.json(folder)
    return IO.read_kpi_frame(spark, folder, ["qty", "absent"])


@check(
    "S08_write_audit",
    """SELECT 'detail' AS part, l_suppkey, l_quantity AS v FROM lineitem WHERE l_quantity >= 49
UNION ALL SELECT 'summary', l_suppkey, count(*) FROM lineitem WHERE l_quantity >= 49 GROUP BY l_suppkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    detail = at_least(s.table(spark, d, "lineitem"), "l_quantity", 49).select(
        "l_suppkey", F.col("l_quantity").alias("v")
    )
    summary = detail.groupBy("l_suppkey").agg(F.count("*").alias("v"))
    paths = IO.write_audit(
        {"detail": detail, "summary": summary}, work_folder(spark, "audit"), file_format="csv"
    )
    parts = [
        spark.read.schema("l_suppkey bigint, v double")
        .csv(path, header=True)
        .select(F.lit(name).alias("part"), "l_suppkey", "v")
        for name, path in paths.items()
    ]
    return parts[0].unionByName(parts[1])


@check(
    "S09_write_report",
    """SELECT l_suppkey AS "LNCEL name", strftime(l_shipdate, '%Y-%m-%d') AS "Period start time", sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "report")
    report = s.table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("LNCEL name"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Period start time"),
    ).agg(F.sum("l_quantity").alias("qty"))
    IO.write_report(report, folder, ["LNCEL name", "Period start time"])
    return spark.read.parquet(folder)


@check(
    "S10_write_class_tables",
    f"""WITH {s.EVENTS_SQL} SELECT upper(mo_class) AS table_name, user_id AS "USER_id", k::BIGINT AS k, cast(value AS VARCHAR) AS amount FROM ev""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "classes")
    tables = P.flatten_parameters(s.events_cm(spark, d), "2024-01-01")
    parts = [
        spark.read.parquet(f"{folder}/{name}").select(
            F.lit(name).alias("table_name"), "USER_id", "k", "amount"
        )
        for name in IO.write_class_tables(tables, folder)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@check(
    "U03_merge_shards",
    """SELECT event_type, event_id, user_id FROM events""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    # One partitioned write takes the place of shards that are merged afterwards.
    folder = work_folder(spark, "merged")
    events = s.table(spark, d, "events").select("event_type", "event_id", "user_id")
    events.write.partitionBy("event_type").parquet(folder)
    return spark.read.parquet(folder)


@check(
    "S11_export_pivot",
    """WITH t AS (SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS "measTime", l_suppkey AS "Element", l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)
SELECT "measTime", "Element", max(q) FILTER (f = 'A') AS "A", max(q) FILTER (f = 'N') AS "N", max(q) FILTER (f = 'R') AS "R" FROM t GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "export")
    long = s.table(spark, d, "lineitem").groupBy(
        F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd").alias("measTime"),
        F.col("l_suppkey").alias("Element"),
        F.col("l_returnflag").alias("KPI_Name"),
    ).agg(F.sum("l_quantity").alias("Value"))
    IO.write_csv_export(P.kpi_pivot(long), folder)
    schema = "measTime string, Element bigint, A double, N double, R double"
    return spark.read.schema(schema).csv(folder, header=True)


@check(
    "S12_export_sites",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.history_sql("GSM")} SELECT "moDistName", sector_name, azimuth, bsc_name FROM hist_gsm""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "site-export")
    wanted = ["moDistName", "sector_name", "azimuth", "bsc_name"]
    IO.write_csv_export(s.site_history(spark, d, "GSM").select(*wanted), folder)
    schema = "moDistName string, sector_name string, azimuth double, bsc_name string"
    return spark.read.schema(schema).csv(folder, header=True)


@check(
    "S13_bundle_audits",
    f"""WITH {s.cm_sql("LNBTS")}, {s.site_set_sql()}
SELECT 'sites' AS audit, mo_distname AS dn, NULL AS verdict FROM cm_lnbts WHERE name IS NOT NULL
UNION ALL SELECT 'version', mo_distname, CASE WHEN mo_version = 'V2' THEN 'OK' ELSE 'NO-OK' END FROM cm_lnbts WHERE mo_distname IN (SELECT item FROM site_set)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cm = s.cm(spark, d, ["LNBTS"])

    def unavailable() -> DataFrame:
        raise RuntimeError("counters are missing")

    def failing() -> DataFrame:
        return P.site_list(cm).withColumn("mo_distname", F.raise_error(F.concat(F.lit("no "), "mo_distname")))

    folder = work_folder(spark, "bundle")
    done, skipped = IO.deliver_audits(
        {
            "sites": P.site_list(cm),
            "version": lambda: P.audit_sw_version(cm, s.site_set(spark, d).select("item"), "V2"),
            "rtwp": unavailable,  # while its plan is built
            "rssi": failing,  # in a task
        },
        folder,
    )
    assert sorted(done) == ["sites", "version"] and sorted(skipped) == ["rssi", "rtwp"]
    return spark.read.parquet(folder).select(
        "audit",
        F.get_json_object("row", "$.mo_distname").alias("dn"),
        F.get_json_object("row", "$.Version_OK").alias("verdict"),
    )
