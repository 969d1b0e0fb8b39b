"""Reshaping: wide to long and back, maps and lists to columns and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from netquarry.functions.dates import local_bucket
from netquarry.functions.maps import map_columns
from netquarry.operators import reshape as R
from netquarry.operators.aggregates import offered_to_levels

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check(
    "R01_melt",
    " UNION ALL ".join(
        f"""SELECT l_orderkey, l_linenumber, l_partkey, '{m}' AS "Parameter", nullif({m}, 0) AS "Cur_Value" FROM lineitem"""
        for m in _MEASURES
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = s.table(spark, d, "lineitem").select(
        *keys, *[F.nullif(m, F.lit(0.0)).alias(m) for m in _MEASURES]
    )
    return R.melt(lines, keys, _MEASURES)


@check(
    "R02_pivot",
    """SELECT l_suppkey, max(q) FILTER (l_returnflag = 'A') AS "A", max(q) FILTER (l_returnflag = 'N') AS "N",
max(q) FILTER (l_returnflag = 'R') AS "R" FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    long = s.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.sum("l_quantity").alias("q")
    )
    return R.pivot_values(long, ["l_suppkey"], "l_returnflag", "q", ["A", "N", "R"])


_YEARS = [str(y) for y in range(1995, 2003)]


@check(
    "R03_transpose",
    "WITH y AS (SELECT strftime(l_shipdate, '%Y') AS y, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1) "
    + " UNION ALL ".join(
        f"SELECT {i} AS item_position, '{item}' AS item, "
        + ", ".join(
            f"""coalesce(max(cast({item} AS VARCHAR)) FILTER (y = '{y}'), '-9999') AS "{y}" """ for y in _YEARS
        )
        + " FROM y"
        for i, item in enumerate(["n", "q"])
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    yearly = s.table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy").alias("y")).agg(
        F.count("*").alias("n"), F.max("l_quantity").alias("q")
    )
    return R.transpose(yearly, "y", ["n", "q"], _YEARS, fill="-9999")


@check(
    "R04_widen_map",
    f"""WITH {s.cm_sql("LNCEL")}
SELECT mo_distname, "name" AS name_v, "phyCellId" AS "phyCellId_v", "pMax" AS "pMax_v" FROM cm_lncel
UNION ALL SELECT mo_distname, "name", "phyCellId", "pMax" FROM cm_lncel""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = s.cm(spark, d, ["LNCEL"])
    return R.widen_map(
        cells, "parameters", ["name", "phyCellId", "pMax"], suffix="_v", keep=["mo_distname"]
    )


@check(
    "R05_explode_lists",
    f"""WITH {s.EVENTS_SQL}, t AS (SELECT event_id, 'tags' AS list, unnest([0, 1, 2]) AS "optionId",
unnest([k, CASE WHEN value > 30 THEN '7' END, cast(event_id % 10 AS VARCHAR)]) AS "Value" FROM ev WHERE event_type <> 'signup' AND value >= 5
UNION ALL SELECT event_id, 'notes', 0, cast(value AS VARCHAR) FROM ev WHERE event_type <> 'signup')
SELECT * FROM t WHERE "Value" IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = s.events_cm(spark, d).select(
        F.substring_index("mo_distname", "-", -1).cast("bigint").alias("event_id"), "p_lists"
    )
    return R.explode_lists(rows)


@check(
    "W01_list_position",
    """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS "Value", generate_subscripts(string_split(p_name, ' '), 1) - 1 AS "optionId" FROM part)
SELECT p_partkey, 'words' AS list, "optionId"::INTEGER AS "optionId", "Value" FROM w""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    words = s.table(spark, d, "part").select(
        "p_partkey", F.create_map(F.lit("words"), F.split("p_name", " ")).alias("p_lists")
    )
    return R.explode_lists(words)


@check(
    "R06_first_items",
    f"""WITH {s.EVENTS_SQL} SELECT event_id, CASE WHEN value >= 5 THEN k END AS f1, CASE WHEN value > 50 THEN cast(event_id AS VARCHAR) END AS f2
FROM ev WHERE event_type = 'purchase'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = (
        s.events_cm(spark, d)
        .where(F.col("item_lists").isNotNull())
        .withColumn("event_id", F.substring_index("mo_distname", "-", -1).cast("bigint"))
    )
    return R.first_items(rows, "item_lists", "items", ["f1", "f2"], keep=["event_id"])


@check(
    "R07_ids_to_columns",
    f"""WITH {s.cm_sql("WCEL")} SELECT mo_distname, "id_RNC" AS "RNC_id", "id_WBTS" AS "WBTS_id", "id_WCEL" AS "WCEL_id" FROM cm_wcel
UNION ALL SELECT mo_distname, "id_RNC", "id_WBTS", "id_WCEL" FROM cm_wcel""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = {k: f"{k}_id" for k in ("RNC", "WBTS", "WCEL")}
    return s.cm(spark, d, ["WCEL"]).select("mo_distname", *map_columns("ids", ids))


@check(
    "A13_element_choices",
    " UNION ALL ".join(
        f"""SELECT '{label}' AS level, strftime(date_trunc('quarter', l_shipdate), '%Y-%m-%d') AS bucket, {column} AS element,
sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""
        for label, column in {
            "set": "'WS'",
            "cluster": "n_name",
            "cell": "s_name",
            "site": "cast(s_nationkey AS VARCHAR)",
            "band": "r_name",
        }.items()
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = (
        s.table(spark, d, "lineitem")
        .join(s.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(s.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(s.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    elements = {
        "set": F.lit("WS"),
        "cluster": F.col("n_name"),
        "cell": F.col("s_name"),
        "site": F.col("s_nationkey").cast("string"),
        "band": F.col("r_name"),
    }
    offered = offered_to_levels(
        lines.select(
            F.date_format(local_bucket("l_shipdate", "quarter", "UTC"), "yyyy-MM-dd").alias("bucket"),
            "l_quantity",
            *[c.alias(label) for label, c in elements.items()],
        ),
        {label: F.col(label) for label in elements},
    )
    return offered.groupBy("level", "bucket", "element").agg(F.sum("l_quantity").alias("qty"))
