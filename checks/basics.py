"""Snapshots, filters, joins, aggregates, ordering, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from netquarry.functions import dates as D
from netquarry.functions import maps as Mp
from netquarry.functions import numeric as N
from netquarry.functions import text as X
from netquarry.operators import aggregates as A
from netquarry.operators import columns as C
from netquarry.operators import filters as Fl
from netquarry.operators import joins as J
from netquarry.operators import snapshots as Sn
from netquarry.plans.selection import choices, site_directory
from netquarry.session import work_folder
from netquarry.sources import Dump

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(column: str | Column) -> Column:
    return F.date_format(column, STAMP)


def money(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


# ---- snapshots and current records -------------------------------------------------------------


@check(
    "J01_latest_snapshot",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.cm_sql("WCEL", "RETU")}
SELECT 'WCEL' AS mo_class, '2024-03-02' AS day, mo_distname, mo_version FROM cm_wcel
UNION ALL SELECT 'RETU', '2024-03-02', mo_distname, mo_version FROM cm_retu
UNION ALL SELECT 'RETU', '2024-03-03', mo_distname, mo_version FROM cm_retu""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cm = s.cm(spark, d, ["WCEL", "RETU", "ALD"])
    own = Sn.latest_snapshot(cm, "WCEL").unionByName(Sn.latest_snapshot(cm, "RETU"))
    by_other = Sn.latest_snapshot(cm, "RETU", dated_by="ALD")
    return own.unionByName(by_other).select(
        "mo_class", F.col("raml_date").cast("string").alias("day"), "mo_distname", "mo_version"
    )


@check(
    "J01_newest_day_listing",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.cm_sql("WCEL", "RETU")}
SELECT 'WCEL' AS mo_class, '2024-03-02' AS day, mo_distname, "LAC" AS code FROM cm_wcel
UNION ALL SELECT 'RETU', '2024-03-02', mo_distname, NULL FROM cm_retu""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    # The days are looked up in the names of the folders, and one day's files are read.
    folder = work_folder(spark, "dump")
    s.cm(spark, d, ["WCEL", "RETU", "ALD"]).write.partitionBy("raml_date", "mo_class").parquet(folder)
    dump = Dump(spark, folder)
    newest = Sn.latest_snapshot(dump, "WCEL").unionByName(Sn.latest_snapshot(dump, "RETU", dated_by="ALD"))
    return newest.select(
        "mo_class",
        F.col("raml_date").cast("string").alias("day"),
        "mo_distname",
        F.element_at("parameters", F.lit("LAC")).alias("code"),
    )


@check(
    "J02_latest_per_key",
    """SELECT o.o_custkey, o.o_orderkey, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS day, o.o_orderstatus
FROM orders o JOIN (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey) m
ON o.o_custkey = m.o_custkey AND o.o_orderdate = m.newest""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    newest = Sn.latest_per_key(s.table(spark, d, "orders"), ["o_custkey"], "o_orderdate")
    return newest.select(
        "o_custkey", "o_orderkey", stamp("o_orderdate").alias("day"), "o_orderstatus"
    )


@check(
    "J03_latest_as_of",
    """WITH past AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01')
SELECT o.o_custkey, o.o_orderkey, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS day
FROM past o JOIN (SELECT o_custkey, max(o_orderdate) AS newest FROM past GROUP BY o_custkey) m
ON o.o_custkey = m.o_custkey AND o.o_orderdate = m.newest""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders")
    newest = Sn.latest_per_key(orders, ["o_custkey"], "o_orderdate", as_of="1998-01-01")
    return newest.select("o_custkey", "o_orderkey", stamp("o_orderdate").alias("day"))


_ONE_LINE_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n
FROM lineitem) WHERE n = 1"""


@check("A09_one_per_key", _ONE_LINE_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = Sn.one_per_key(s.table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber"])
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@check(
    "W02_newest_ranked",
    """SELECT user_id, event_type, event_id FROM (SELECT *, rank() OVER (
PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events) WHERE n = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    events = s.table(spark, d, "events")
    return Sn.latest_per_key(events, ["user_id", "event_type"], "ts").select(
        "user_id", "event_type", "event_id"
    )


@check(
    "W03_first_row_per_key",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (
PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    events = s.table(spark, d, "events")
    return Sn.one_per_key(events, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type"
    )


# ---- filters -----------------------------------------------------------------------------------


@check(
    "F01_project_rename",
    "SELECT s_suppkey AS cell, s_name AS label, s_nationkey AS cluster FROM supplier",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = {"s_suppkey": "cell", "s_name": "label", "s_nationkey": "cluster"}
    return s.table(spark, d, "supplier").select(*names).withColumnsRenamed(names)


@check(
    "F02_map_lookup",
    f"""WITH {s.cm_sql("LNCEL")}
SELECT mo_distname, "name" AS label, "tac", "pMax", cast(NULL AS varchar) AS nothing FROM cm_lncel""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = Sn.latest_snapshot(s.cm(spark, d, ["LNCEL"]), "LNCEL")
    wanted = {"name": "label", "tac": "tac", "pMax": "pMax", "absent": "nothing"}
    return cells.select("mo_distname", *Mp.map_columns("parameters", wanted))


@check(
    "F03_class_and_day",
    """SELECT mo_class, day, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'LNCEL'
ELSE event_type END AS mo_class, strftime(date_trunc('week', ts), '%Y-%m-%d') AS day FROM events)
WHERE mo_class = 'error' AND day = '2024-01-08' GROUP BY mo_class, day""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cm = s.events_cm(spark, d, weekly=True)
    chosen = cm.where(
        (F.col("mo_class") == "error") & (F.col("raml_date") == F.lit("2024-01-08").cast("date"))
    )
    return chosen.groupBy("mo_class", F.col("raml_date").cast("string").alias("day")).agg(
        F.count("*").alias("n")
    )


_UMTS_SITE = "concat('PLMN-PLMN/RNC-', c_nationkey, '/WBTS-', c_custkey)"


@check(
    "F04_prefix_match",
    f"""WITH c AS (SELECT *, {_UMTS_SITE} AS dn FROM customer),
p AS (SELECT dn AS item FROM c WHERE c_acctbal < 0)
SELECT c_custkey, dn FROM c WHERE EXISTS (SELECT 1 FROM p WHERE starts_with(c.dn, p.item))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    sites = s.table(spark, d, "customer").withColumn("dn", F.expr(_UMTS_SITE))
    prefixes = sites.where(F.col("c_acctbal") < 0).select(F.col("dn").alias("item"))
    return Fl.by_prefix(sites, "dn", prefixes).select("c_custkey", "dn")


@check(
    "F04_site_match",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.counters_sql()}, {s.site_set_sql()}
SELECT "distName", sum(qty)::BIGINT AS qty FROM pm WHERE array_to_string(string_split("distName", '/')[1:3], '/')
IN (SELECT item FROM site_set) GROUP BY "distName" """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    chosen = Fl.in_sites(s.counters(spark, d), "distName", s.site_set(spark, d).select("item"))
    return chosen.groupBy("distName").agg(F.sum("qty").alias("qty"))


@check(
    "F05_equality_list",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders")
    return Fl.members(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select(
        "o_orderkey", "o_orderpriority"
    )


@check(
    "F06_in_working_set",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    urgent = s.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    customer = s.table(spark, d, "customer")
    return Fl.members(customer, "c_custkey", urgent.select("o_custkey")).select("c_custkey", "c_name")


@check(
    "F07_not_in",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS k FROM orders),
u AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey, k FROM o WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM u WHERE c_custkey = k)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k")
    )
    in_credit = s.table(spark, d, "customer").where(F.col("c_acctbal") > 0).select("c_custkey")
    return Fl.not_members(orders, "k", in_credit)


@check(
    "F08_null_filters",
    """WITH t AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS disc, nullif(l_tax, 0) AS tax FROM lineitem)
SELECT 'complete' AS kind, count(*) AS n FROM t WHERE disc IS NOT NULL AND tax IS NOT NULL
UNION ALL SELECT 'no tax', count(*) FROM t WHERE tax IS NULL
UNION ALL SELECT 'taxed', count(*) FROM t WHERE tax IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").select(
        "l_orderkey",
        F.nullif("l_discount", F.lit(0.0)).alias("disc"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
    )
    kinds = {
        "complete": Fl.drop_incomplete(lines),
        "no tax": lines.where(F.col("tax").isNull()),
        "taxed": lines.where(F.col("tax").isNotNull()),
    }
    counts = [f.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, f in kinds.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@check(
    "F09_threshold",
    """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag = 'R' THEN 45.0 ELSE 48.0 END::DOUBLE AS bound
FROM lineitem WHERE l_quantity >= 40 AND l_quantity > CASE WHEN l_returnflag = 'R' THEN 45.0 ELSE 48.0 END""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    bound = F.when(F.col("l_returnflag") == "R", 45.0).otherwise(48.0)
    lines = Fl.at_least(s.table(spark, d, "lineitem"), "l_quantity", 40)
    return Fl.above(lines.withColumn("bound", bound), "l_quantity", "bound").select(
        "l_orderkey", "l_linenumber", "l_quantity", "bound"
    )


@check(
    "F10_differs",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS actual,
CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority < '3' THEN 'O' ELSE 'F' END AS expected FROM orders)
SELECT * FROM t WHERE actual IS NULL OR expected IS NULL OR actual <> expected""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("actual"),
        F.expr(
            "case when o_orderpriority = '5-LOW' then null when o_orderpriority < '3' then 'O' else 'F' end"
        ).alias("expected"),
    )
    return orders.where(Fl.differs("actual", "expected"))


@check(
    "F11_conditional",
    "SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN 'OK' ELSE 'NO-OK' END AS status FROM supplier",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("s_nationkey") == 7, "OK").otherwise("NO-OK")
    return s.table(spark, d, "supplier").select("s_suppkey", status.alias("status"))


@check(
    "F12_literal_copy_blank",
    """SELECT s_suppkey, 'PLMN' AS plmn, s_acctbal AS copied, cast(NULL AS DOUBLE) AS blanked FROM supplier""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "supplier").select(
        "s_suppkey",
        F.lit("PLMN").alias("plmn"),
        F.col("s_acctbal").alias("copied"),
        F.lit(None).cast("double").alias("blanked"),
    )


@check(
    "F13_report_schema",
    """SELECT l_suppkey, sum(l_quantity) AS sent, cast(NULL AS DOUBLE) AS lost, cast(NULL AS DOUBLE) AS ratio FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT l_suppkey, sum(l_quantity), 0, 0 FROM lineitem GROUP BY l_suppkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    sent = s.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("sent"))
    wanted = ["l_suppkey", "sent", "lost", "ratio"]
    return C.with_report_schema(sent, wanted).unionByName(
        C.with_report_schema(sent, wanted, fill=0.0)
    )


@check(
    "F14_fill_defaults",
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_tax, 0), -120) AS tax,
coalesce(nullif(l_returnflag, 'N'), 'NO-OK') AS flag FROM lineitem""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
    )
    return C.fill_defaults(lines, {"tax": -120.0, "flag": "NO-OK"})


@check("F15_dedupe_columns", "SELECT p_partkey, upper(p_name) AS name FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = s.table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("NAME"), F.upper("p_name").alias("name"), "p_size"
    )
    return C.dedupe_columns(part).drop("p_size")


@check(
    "F16_map_keys",
    """WITH e AS (SELECT CASE WHEN event_type = 'click' THEN 'LNCEL' ELSE event_type END AS mo_class, * FROM events)
SELECT mo_class, 'k' AS key FROM e GROUP BY 1 UNION SELECT mo_class, 'amount' FROM e
UNION SELECT mo_class, 'opt' FROM e WHERE value > 50
UNION SELECT mo_class, unnest(['Mode', 'mode']) FROM e WHERE event_type = 'view'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.map_keys_of(s.events_cm(spark, d), "parameters", by=["mo_class"])


@check(
    "F17_narrow_integers",
    """SELECT event_id, 'bigint' AS user_type, 'string' AS amount_type, 'string' AS gap_type,
user_id AS user_value, cast(value AS VARCHAR) AS amount, CASE WHEN value > 1 THEN cast(event_id AS VARCHAR) END AS gap FROM events""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    events = s.table(spark, d, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_value"),
        F.col("value").cast("string").alias("amount"),
        F.when(F.col("value") > 1, F.col("event_id").cast("string")).alias("gap"),
    )
    narrowed = C.narrow_integers(events)
    return narrowed.select(
        "event_id",
        "user_value",
        "amount",
        "gap",
        F.typeof("user_value").alias("user_type"),
        F.typeof("amount").alias("amount_type"),
        F.typeof("gap").alias("gap_type"),
    )


@check(
    "F18_time_windows",
    """SELECT 'trailing' AS kind, count(*) AS n FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-10-01'
UNION ALL SELECT 'range', count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-04-01'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem")
    recent = Fl.trailing_days(lines, "l_shipdate", 40, "2001-11-10")
    ranged = Fl.between_days(lines, "l_shipdate", "1998-01-01", "1998-03-31")
    return recent.agg(F.lit("trailing").alias("kind"), F.count("*").alias("n")).unionByName(
        ranged.agg(F.lit("range").alias("kind"), F.count("*").alias("n"))
    )


@check(
    "F19_literal_predicates",
    "SELECT p_partkey, p_name FROM part WHERE p_brand <> 'Brand#1' AND p_size > 0 AND length(p_name) > 2",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    part = s.table(spark, d, "part")
    return part.where(
        (F.col("p_brand") != "Brand#1") & (F.col("p_size") > 0) & (F.length("p_name") > 2)
    ).select("p_partkey", "p_name")


# ---- joins -------------------------------------------------------------------------------------


@check(
    "J04_counters_with_sites",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.history_sql("LTE")}, {s.counters_sql()}
SELECT sector_name, site_name, sum(qty)::BIGINT AS qty FROM pm JOIN cur_lte ON pm."distName" = cur_lte."moDistName" GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    current = Sn.latest_per_key(s.site_history(spark, d, "LTE"), ["sector_name"], "export_date")
    pm = s.counters(spark, d)
    joined = pm.join(current, pm["distName"] == current["moDistName"])
    return joined.groupBy("sector_name", "site_name").agg(F.sum("qty").alias("qty"))


@check(
    "J05_multi_key_join",
    """WITH a AS (SELECT l_suppkey AS cell, strftime(l_shipdate, '%Y-%m') AS day, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
b AS (SELECT l_suppkey AS cell, strftime(l_shipdate, '%Y-%m') AS day, count(*) AS lines FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT a.cell, a.day, qty, lines FROM a JOIN b ON a.cell = b.cell AND a.day = b.day""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cell"),
        F.date_format("l_shipdate", "yyyy-MM").alias("day"),
        "l_returnflag",
        "l_quantity",
    )
    keys = ["cell", "day"]
    returned = lines.where("l_returnflag = 'R'").groupBy(*keys).agg(F.sum("l_quantity").alias("qty"))
    normal = lines.where("l_returnflag = 'N'").groupBy(*keys).agg(F.count("*").alias("lines"))
    return J.equi_join(returned, normal, keys)


@check(
    "J05_null_safe_join",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS k FROM orders),
c AS (SELECT k, count(*) AS n FROM o GROUP BY k)
SELECT o_orderkey, o.k, n FROM o JOIN c ON o.k IS NOT DISTINCT FROM c.k""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("k")
    )
    counts = orders.groupBy("k").agg(F.count("*").alias("n"))
    return J.equi_join(orders, counts, ["k"], null_safe=True)


@check(
    "J06_three_way_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, s_name, n_name FROM lineitem, supplier, nation
WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    with_supplier = J.equi_join(
        s.table(spark, d, "lineitem"), s.table(spark, d, "supplier"), [("l_suppkey", "s_suppkey")]
    )
    named = J.equi_join(with_supplier, s.table(spark, d, "nation"), [("s_nationkey", "n_nationkey")])
    return named.select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name")


@check(
    "J07_left_join",
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    pending = s.table(spark, d, "orders").where(F.col("o_orderstatus") == "P")
    return J.equi_join(
        s.table(spark, d, "customer"), pending, [("c_custkey", "o_custkey")], how="left"
    ).select("c_custkey", "o_orderkey")


@check(
    "J08_missing_relations",
    """SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey WHERE o_custkey IS NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    urgent = s.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return J.missing_relations(
        s.table(spark, d, "customer"), urgent, [("c_custkey", "o_custkey")]
    ).select("c_custkey", "c_name")


@check(
    "J09_neighbour_pairs",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.cm_sql("LNCEL", "LNCEL_FDD", "LNADJ")},
c AS (SELECT a."id_LNBTS" AS site, a."id_LNCEL" AS cell, a.name, a."phyCellId" AS code, f."earfcnDL" AS carrier FROM cm_lncel a
  JOIN cm_lncel_fdd f ON a."id_LNCEL" = f."id_LNCEL" AND a."id_LNBTS" = f."id_LNBTS"),
p AS (SELECT DISTINCT concat('S', o_custkey, '_', o_orderkey) AS origin, cast(l_partkey AS VARCHAR) AS tgt FROM obs),
j AS (SELECT DISTINCT "id_LNBTS" AS site, "adjEnbId" AS adj FROM cm_lnadj)
SELECT p.origin, t.name AS target, o.code, o.carrier FROM p JOIN c t ON t.cell = p.tgt JOIN c o ON o.name = p.origin
AND o.code = t.code AND o.carrier = t.carrier JOIN j ON j.site = o.site AND j.adj = t.site""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from netquarry.plans import lte_cells, site_adjacency

    cm = s.cm(spark, d, ["LNCEL", "LNCEL_FDD", "LNADJ"])
    cells = lte_cells(cm, ["LNBTS_id", "LNCEL_Name", "phyCellId", "eutraCelId", "earfcnDL"])
    names = cells.select(
        F.col("eutraCelId").alias("target"), F.col("LNCEL_Name").alias("LNCEL_Name_Dest")
    )
    # Observations are dealt by order: there they are made distinct, and names are formed after the next shuffle.
    measured = (
        s.observations(spark, d, customer=False)
        .select("o_custkey", "o_orderkey", "l_partkey")
        .distinct()
        .join(names, F.col("l_partkey").cast("string") == F.col("target"))
        .withColumn("LNCEL_Name_Orig", F.expr("concat('S', o_custkey, '_', o_orderkey)"))
    )
    found = J.neighbour_pairs(
        measured.select("LNCEL_Name_Orig", "LNCEL_Name_Dest"),
        cells.select("LNBTS_id", "LNCEL_Name", "phyCellId", "earfcnDL"),
        site_adjacency(cm),
        "phyCellId",
    )
    return found.select(
        F.col("LNCEL_Name_Orig").alias("origin"),
        F.col("LNCEL_Name_Dest").alias("target"),
        F.col("phyCellId_Orig").alias("code"),
        F.col("earfcnDL_Orig").alias("carrier"),
    )


@check(
    "J10_within_angle",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.history_sql("LTE")}, {s.history_sql("UMTS")},
a AS (SELECT site_name, azimuth AS az_src, count(*) AS n_src FROM cur_lte GROUP BY 1, 2),
b AS (SELECT site_name, azimuth AS az_tgt, count(*) AS n_tgt FROM cur_umts GROUP BY 1, 2),
p AS (SELECT a.*, az_tgt, n_tgt, ((az_src - az_tgt + 180) % 360 + 360) % 360 AS turned FROM a JOIN b ON a.site_name = b.site_name)
SELECT site_name, az_src, az_tgt, n_src, n_tgt, abs(turned - 180) AS dif_az FROM p WHERE abs(turned - 180) <= 20""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    def bearings(technology: str, side: str) -> DataFrame:
        view = Sn.latest_per_key(s.site_history(spark, d, technology), ["sector_name"], "export_date")
        return view.groupBy("site_name", F.col("azimuth").alias(f"az_{side}")).agg(
            F.count("*").alias(f"n_{side}")
        )

    return J.join_within_angle(
        bearings("LTE", "src"), bearings("UMTS", "tgt"), "site_name", "az_src", "az_tgt", 20
    )


@check(
    "J11_unnest_join",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.cm_sql("CHANNEL", "RETU")},
u AS (SELECT "id_MRBTS" AS site, angle, unnest([line, next_line]) AS ant FROM (SELECT o_custkey::VARCHAR AS "id_MRBTS",
  cast(cast(l_quantity as int) % 12 * 10 as varchar) AS angle, concat('ANT-', o_orderkey, '-', l_linenumber) AS line,
  concat('ANT-', o_orderkey, '-', l_linenumber + 1) AS next_line FROM obs))
SELECT c."antlDN" AS ant, u.angle, count(*)::BIGINT AS n FROM cm_channel c JOIN u ON c."id_MRBTS" = u.site AND c."antlDN" = u.ant GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cm = s.cm(spark, d, ["CHANNEL", "RETU", "ALD"])
    site = Mp.map_columns("ids", {"MRBTS": "site"})
    # Copies are counted on each side first, so a line with very many of them does not multiply.
    channels = (
        Sn.latest_snapshot(cm, "CHANNEL")
        .select(*site, *Mp.map_columns("parameters", {"antlDN": "ant"}))
        .groupBy("site", "ant")
        .agg(F.count("*").alias("channels"))
    )
    units = (
        Sn.latest_snapshot(cm, "RETU", dated_by="ALD")
        .select(
            *site,
            *Mp.map_columns("parameters", ["angle"]),
            F.explode(Mp.map_value("p_lists", "antlDNList")).alias("ant"),
        )
        .groupBy("site", "ant", "angle")
        .agg(F.count("*").alias("units"))
    )
    return channels.join(units, on=["site", "ant"]).groupBy("ant", "angle").agg(
        F.sum(F.col("channels") * F.col("units")).alias("n")
    )


@check(
    "J12_scalar_day",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders,
(SELECT max(l_shipdate) - INTERVAL 365 DAY AS edge FROM lineitem) WHERE o_orderdate > edge""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    edge = s.table(spark, d, "lineitem").agg(F.expr("max(l_shipdate) - interval 365 days").alias("edge"))
    orders = s.table(spark, d, "orders").where(F.col("o_orderdate") > edge.scalar())
    return orders.select("o_orderkey", stamp("o_orderdate").alias("day"))


@check(
    "J13_lookup_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    part = s.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return J.equi_join(s.table(spark, d, "lineitem"), part, [("l_partkey", "p_partkey")]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_size"
    )


_UMTS_CELLS = "SELECT concat('PLMN-PLMN/RNC-', c_nationkey, '/WBTS-', o_custkey, '/WCEL-', o_orderkey) AS dn FROM orders JOIN customer ON o_custkey = c_custkey"


@check(
    "J14_assign_site_literal",
    f"""WITH n AS ({_UMTS_CELLS}), w AS (SELECT {_UMTS_SITE} AS item, c_custkey AS pos FROM customer WHERE c_acctbal < 0),
m AS (SELECT dn, arg_max(item, pos) AS site_id FROM n JOIN w ON contains(n.dn, w.item) GROUP BY dn)
SELECT n.dn, coalesce(site_id, '') AS site_id FROM n LEFT JOIN m ON n.dn = m.dn""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = s.cells(spark, d).select(
        F.expr("concat('PLMN-PLMN/RNC-', c_nationkey, '/WBTS-', o_custkey, '/WCEL-', o_orderkey)").alias("dn")
    )
    sites = s.table(spark, d, "customer").where(F.col("c_acctbal") < 0).select(
        F.expr(_UMTS_SITE).alias("item"), F.col("c_custkey").alias("pos")
    )
    return J.assign_site(names, "dn", sites, literal=True)


@check(
    "J14_assign_site",
    f"""WITH n AS ({_UMTS_CELLS}), w AS (SELECT {_UMTS_SITE} AS item, c_custkey AS pos FROM customer WHERE c_acctbal < 0)
SELECT n.dn, coalesce(item, '') AS site_id FROM n LEFT JOIN w ON array_to_string(string_split(n.dn, '/')[1:3], '/') = w.item""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = s.cells(spark, d).select(
        F.expr("concat('PLMN-PLMN/RNC-', c_nationkey, '/WBTS-', o_custkey, '/WCEL-', o_orderkey)").alias("dn")
    )
    sites = s.table(spark, d, "customer").where(F.col("c_acctbal") < 0).select(
        F.expr(_UMTS_SITE).alias("item"), F.col("c_custkey").alias("pos")
    )
    return J.assign_site(names, "dn", sites)


# ---- aggregates --------------------------------------------------------------------------------


@check(
    "A01_grouped_sums",
    """WITH t AS (SELECT nullif(l_returnflag, 'N') AS flag, l_suppkey, l_quantity, nullif(l_tax, 0) AS tax FROM lineitem)
SELECT flag, l_suppkey, coalesce(sum(l_quantity), 0) AS l_quantity, cast(coalesce(sum(cast(tax AS decimal(18,2))), 0) AS DOUBLE) AS tax
FROM t WHERE flag IS NOT NULL GROUP BY flag, l_suppkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        "l_suppkey",
        "l_quantity",
        F.nullif("l_tax", F.lit(0.0)).cast("decimal(18,2)").alias("tax"),
    )
    return A.grouped_sums(lines, ["flag", "l_suppkey"], ["l_quantity", "tax"]).withColumn(
        "tax", F.col("tax").cast("double")
    )


@check(
    "A02_scaled_means",
    "SELECT l_suppkey, round(avg(l_quantity) / 10, 2) AS mean_qty, round(avg(l_linenumber) / 10, 2) AS mean_line FROM lineitem GROUP BY l_suppkey",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = {"l_quantity": "mean_qty", "l_linenumber": "mean_line"}
    return A.scaled_means(s.table(spark, d, "lineitem"), ["l_suppkey"], names)


@check(
    "A03_non_null_count",
    "SELECT l_suppkey, count(nullif(l_tax, 0)) AS taxed, count(*) AS lines FROM lineitem GROUP BY l_suppkey",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.nullif("l_tax", F.lit(0.0))).alias("taxed"), F.count("*").alias("lines")
    )


@check(
    "A04_column_minimums",
    "SELECT l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(nullif(l_tax, 0)) AS tax FROM lineitem GROUP BY l_suppkey",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    return A.column_minimums(lines, "l_suppkey", ["l_quantity", "l_discount", "tax"])


@check(
    "A05_max",
    """SELECT cast(l_suppkey AS VARCHAR) AS grp, max(l_extendedprice) AS top FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 'all', max(l_extendedprice) FROM lineitem""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem")
    top = F.max("l_extendedprice").alias("top")
    grouped = lines.groupBy(F.col("l_suppkey").cast("string").alias("grp")).agg(top)
    return grouped.unionByName(lines.agg(F.lit("all").alias("grp"), top))


@check(
    "A06_multi_valued",
    """WITH t AS (SELECT l_orderkey, nullif(l_returnflag, 'N') AS flag FROM lineitem)
SELECT l_orderkey, count(flag) AS count, count(DISTINCT flag) AS nunique FROM t GROUP BY l_orderkey HAVING count(DISTINCT flag) > 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").select(
        "l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("flag")
    )
    return A.multi_valued(lines, "l_orderkey", "flag")


@check(
    "A07_disagreeing_values",
    """WITH t AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS found,
string_agg(n::VARCHAR, '|' ORDER BY o_orderpriority) AS counts FROM t GROUP BY o_custkey HAVING count(*) > 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    mixed = A.disagreeing_values(s.table(spark, d, "orders"), "o_custkey", "o_orderpriority")
    return mixed.select(
        "o_custkey",
        F.array_join("values", "|").alias("found"),
        F.array_join(F.col("counts").cast("array<string>"), "|").alias("counts"),
    )


@check(
    "A08_distinct",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


_BOGOTA = "(l_shipdate - INTERVAL 5 HOUR)"


@check(
    "A10_time_rollup",
    f"""SELECT strftime(date_trunc('month', {_BOGOTA}), '%Y-%m-%d %H:%M:%S') AS bucket, l_suppkey AS cell,
sum(l_quantity) AS qty, count(*) AS lines, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rolled = A.time_rollup(
        s.table(spark, d, "lineitem"),
        "month",
        "America/Bogota",
        {"cell": F.col("l_suppkey")},
        {"qty": F.sum("l_quantity"), "lines": "count(*)", "price": money("l_extendedprice")},
        ts="l_shipdate",
        bucket="bucket",
    )
    return rolled.withColumn("bucket", stamp("bucket"))


@check(
    "A11_parent_rollup",
    f"""WITH {s.OBSERVATIONS_SQL}, {s.counters_sql()},
child AS (SELECT "distName", date_trunc('quarter', "measTime") AS q, sum(qty) AS qty FROM pm GROUP BY 1, 2)
SELECT strftime(q, '%Y-%m-%d %H:%M:%S') AS bucket, split_part("distName", '/LNCEL', 1) AS site, sum(qty)::BIGINT AS qty FROM child GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rolled = A.time_rollup(
        s.counters(spark, d),
        "quarter",
        "UTC",
        {"site": X.parent_dn("distName", "/LNCEL")},
        {"qty": F.sum("qty")},
    )
    return rolled.select(stamp("measTime").alias("bucket"), "site", "qty")


_FORMULAS = {
    "attempts": "sum(l_quantity)",
    "return_rate": "100 * sum(case when l_returnflag = 'R' then l_quantity else 0 end) / sum(l_quantity)",
    "lines": "count(*)",
    "peak": "max(l_extendedprice)",
}


@check(
    "A12_catalog_formulas",
    f"""SELECT strftime(date_trunc('week', l_shipdate), '%Y-%m-%d %H:%M:%S') AS bucket, n_name AS element,
{", ".join(f"{text} AS {name}" for name, text in _FORMULAS.items())} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    named = (
        s.table(spark, d, "lineitem")
        .join(s.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(s.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    rolled = A.time_rollup(
        named, "week", "UTC", {"element": F.col("n_name")}, _FORMULAS, ts="l_shipdate", bucket="bucket"
    )
    return rolled.withColumn("bucket", stamp("bucket"))


@check(
    "A14_share_of_total",
    """WITH t AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_suppkey, sum(qty) AS total FROM t GROUP BY 1)
SELECT t.l_suppkey, l_partkey, qty, total::BIGINT AS total, (100 * qty // total)::BIGINT AS share FROM t JOIN m ON t.l_suppkey = m.l_suppkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    per_part = s.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("qty")
    )
    return A.share_of_total(per_part, ["l_suppkey"], "qty")


@check(
    "W04_group_total",
    """SELECT o_orderkey, o_custkey, sum(1) OVER (PARTITION BY o_custkey)::BIGINT AS orders FROM orders""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("one"))
    return A.with_group_total(orders, ["o_custkey"], "one", "orders").drop("one")


@check(
    "A15_deviation",
    """WITH t AS (SELECT l_suppkey, l_linestatus, count(*) AS total FROM lineitem GROUP BY 1, 2),
v AS (SELECT l_suppkey, l_linestatus, count(*) AS deviated FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity > 49 GROUP BY 1, 2)
SELECT t.l_suppkey, t.l_linestatus, total, deviated, round(100.0::DOUBLE * deviated / total, 2) AS deviation FROM t JOIN v
ON t.l_suppkey = v.l_suppkey AND t.l_linestatus = v.l_linestatus""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines, keys = s.table(spark, d, "lineitem"), ["l_suppkey", "l_linestatus"]
    totals = lines.groupBy(*keys).agg(F.count("*").alias("total"))
    odd = lines.where((F.col("l_returnflag") != "N") & (F.col("l_quantity") > 49))
    return A.deviation_summary(totals, odd.groupBy(*keys).agg(F.count("*").alias("deviated")), keys)


@check(
    "A16_delivery_ratio",
    """WITH t AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) AS tx,
sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END)::BIGINT AS lost FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN tx = 0 THEN NULL ELSE 100.0::DOUBLE * (tx - lost) / tx END AS ratio FROM t""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    sent = s.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_quantity"))).alias("tx"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0)).alias("lost"),
    )
    return sent.select("l_orderkey", N.delivery_ratio("tx", "lost").alias("ratio"))


# ---- ordering and set operations ---------------------------------------------------------------


@check(
    "O01_sorted",
    "SELECT s_name, s_suppkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_suppkey",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "supplier").orderBy("s_nationkey", "s_suppkey").select(
        "s_name", "s_suppkey", "s_acctbal"
    )


@check("O02_choices", "SELECT DISTINCT p_name FROM part WHERE length(p_name) > 8 ORDER BY p_name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return choices(s.table(spark, d, "part"), "p_name", min_length=8)


@check(
    "O03_record_structure",
    """SELECT DISTINCT unnest(['PLMN', 'USER']) AS key FROM events UNION SELECT 'NODE' FROM events WHERE event_type = 'error' AND value > 20""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    # The structure over all records: one sampled record may lack keys that others have.
    return C.map_keys_of(s.events_cm(spark, d), "ids")


def _directory_branch(technology: str) -> str:
    return f"""SELECT DISTINCT site_name, sector_name, level_1 AS region, level_2 AS cluster, '{technology}' AS "Technology"
FROM cur_{technology.lower()} WHERE level_2 <> '0'"""


DIRECTORY_SQL = f"""WITH {s.OBSERVATIONS_SQL}, {s.history_sql("LTE")}, {s.history_sql("UMTS")},
dir AS ({_directory_branch("LTE")} UNION ALL {_directory_branch("UMTS")})"""


def directory(spark: SparkSession, d: str) -> DataFrame:
    return site_directory({t: s.site_history(spark, d, t) for t in ("LTE", "UMTS")})


@check(
    "U01_union_with_tag",
    """SELECT DISTINCT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT DISTINCT s_nationkey, 'supplier' FROM supplier""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    def branch(name: str, column: str) -> DataFrame:
        rows = s.table(spark, d, name).select(F.col(column).alias("nation")).distinct()
        return rows.withColumn("kind", F.lit(name))

    return branch("customer", "c_nationkey").unionByName(branch("supplier", "s_nationkey"))


@check(
    "U02_accumulate",
    """SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    # A loop that appends one result per flag is one grouped plan.
    return s.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty")
    )


# ---- scalar functions --------------------------------------------------------------------------


@check(
    "X01_concatenation",
    "SELECT p_partkey, concat(p_brand, ' - ', p_name) AS label FROM part",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "part").select("p_partkey", X.kpi_label("p_brand", "p_name").alias("label"))


@check(
    "X02_text_before",
    """SELECT c_custkey, substring(c_name, 1, 8) AS before_mark, substring(c_name, 1, length(c_name) - 2) AS absent_back_1,
substring(c_mktsegment, 1, CASE WHEN position('I' IN c_mktsegment) > 0 THEN position('I' IN c_mktsegment) - 1 ELSE length(c_mktsegment) - 1 END) AS before_i,
CASE WHEN starts_with(c_mktsegment, 'B') THEN substring(c_mktsegment, 1, length(c_mktsegment) - 1)
  ELSE substring(c_mktsegment, 1, CASE WHEN position('B' IN c_mktsegment) > 0 THEN position('B' IN c_mktsegment) - 2 ELSE length(c_mktsegment) - 2 END) END AS before_b FROM customer""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "customer").select(
        "c_custkey",
        X.text_before("c_name", "#").alias("before_mark"),
        X.text_before("c_name", "LNCEL", back=1).alias("absent_back_1"),
        X.text_before("c_mktsegment", "I").alias("before_i"),
        X.text_before("c_mktsegment", "B", back=1).alias("before_b"),
    )


@check(
    "X03_target_cell",
    f"""WITH {s.OBSERVATIONS_SQL} SELECT cast(l_partkey AS VARCHAR) AS eci, count(*) AS n FROM obs GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    pm = s.counters(spark, d)
    return pm.groupBy(X.target_cell_id("extendedDistName").alias("eci")).agg(F.count("*").alias("n"))


@check(
    "X04_parent_dn",
    """SELECT o_orderkey, concat('PLMN-PLMN/MRBTS-', o_custkey, '/LNBTS-', o_custkey) AS parent, '' AS absent FROM orders""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    dn = F.expr("concat('PLMN-PLMN/MRBTS-', o_custkey, '/LNBTS-', o_custkey, '/LNCEL-', o_orderkey)")
    return s.table(spark, d, "orders").select(
        "o_orderkey", X.parent_dn(dn, "/LNCEL").alias("parent"), X.parent_dn(dn, "/WCEL").alias("absent")
    )


@check(
    "X05_nth_integer",
    """SELECT o_orderkey, cast(o_custkey AS VARCHAR) AS second_id, cast(o_orderkey AS VARCHAR) AS third_id, cast(NULL AS VARCHAR) AS fourth_id FROM orders""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    dn = F.expr("concat('PLMN-PLMN/RNC-', o_custkey % 9, '/WBTS-', o_custkey, '/WCEL-', o_orderkey)")
    return s.table(spark, d, "orders").select(
        "o_orderkey",
        X.nth_integer(dn, 2).alias("second_id"),
        X.nth_integer(dn, 3).alias("third_id"),
        X.nth_integer(dn, 4).alias("fourth_id"),
    )


@check(
    "X06_controller_code",
    """SELECT event_id, concat('RC', user_id % 3 + 1) AS code, upper(regexp_extract(props, 'rc[0-9]+')) AS absent FROM events""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    file_name = F.expr("concat('dump_rc', user_id % 3 + 1, '_day.xml')")
    return s.table(spark, d, "events").select(
        "event_id",
        X.controller_code(file_name).alias("code"),
        X.controller_code("props").alias("absent"),
    )


@check(
    "X07_name_checks",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN concat('PLMN-PLMN/MRBTS-', c_custkey, '/LNBTS-', c_custkey)
ELSE concat(c_mktsegment, '_', c_custkey) END AS v FROM customer)
SELECT c_custkey, regexp_matches(v, '^PLMN-PLMN/MRBTS-[0-9A-Za-z_]*/LNBTS-[0-9A-Za-z_]*$') AS site_ok, regexp_matches(v, '[A-Z][A-Z][A-Z].*_') AS cell_ok FROM t""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr(
        "case when c_acctbal > 0 then concat('PLMN-PLMN/MRBTS-', c_custkey, '/LNBTS-', c_custkey) "
        "else concat(c_mktsegment, '_', c_custkey) end"
    )
    return s.table(spark, d, "customer").select(
        "c_custkey", X.is_site_dn(value).alias("site_ok"), X.looks_like_cell_name(value).alias("cell_ok")
    )


@check(
    "X08_split",
    "SELECT p_partkey, len(string_split(p_name, ' ')) AS words, split_part(p_name, ' ', 1) AS head FROM part",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "part").select(
        "p_partkey",
        F.size(X.split_list("p_name", " ")).alias("words"),
        X.first_token("p_name").alias("head"),
    )


@check(
    "X09_day_text",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y%m%d') AS compact FROM orders",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    text = stamp("o_orderdate")
    return s.table(spark, d, "orders").select(
        "o_orderkey", X.day_text(text).alias("day"), X.compact_day(F.to_date("o_orderdate")).alias("compact")
    )


_UNITS = ("hour", "day", "week", "month", "quarter", "year")


@check(
    "D01_local_buckets",
    "SELECT event_id, "
    + ", ".join(
        f"strftime(date_trunc('{u}', ts - INTERVAL 5 HOUR), '%Y-%m-%d %H:%M:%S') AS by_{u}" for u in _UNITS
    )
    + " FROM events",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "events").select(
        "event_id", *[stamp(D.local_bucket("ts", u, "America/Bogota")).alias(f"by_{u}") for u in _UNITS]
    )


@check("D02_weekday_name", "SELECT o_orderkey, upper(dayname(o_orderdate)) AS day FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "orders").select("o_orderkey", D.weekday_name("o_orderdate").alias("day"))


@check(
    "D03_week_of_year",
    "SELECT o_orderkey, cast(strftime(o_orderdate, '%W') AS INTEGER) AS week FROM orders",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "orders").select("o_orderkey", D.week_of_year("o_orderdate").alias("week"))


@check(
    "D04_day_shift",
    """SELECT o_orderkey, strftime(o_orderdate - INTERVAL 20 DAY, '%Y-%m-%d') AS back, strftime(o_orderdate + INTERVAL 1 DAY, '%d/%m/%Y') AS ahead FROM orders""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "orders").select(
        "o_orderkey",
        D.day_shifted("o_orderdate", -20).alias("back"),
        D.day_shifted("o_orderdate", 1, "dd/MM/yyyy").alias("ahead"),
    )


@check(
    "D05_local_day_bounds",
    """SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05 05:00:00' AND ts < TIMESTAMP '2024-01-20 05:00:00'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    inside = D.within_local_days("ts", "2024-01-05", "2024-01-19", "America/Bogota")
    return s.table(spark, d, "events").where(inside).select("event_id", "event_type")


@check(
    "D06_clamped_range",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, 'day' AS unit, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    period = D.clamp_range("2023-06-01", "2024-01-31", "Hour", D.MAX_HOURLY_DAYS, D.MAX_RANGE_DAYS)
    inside = D.within_local_days("ts", period.start, period.end, "UTC")
    return (
        s.table(spark, d, "events")
        .where(inside)
        .groupBy(F.date_format(D.local_bucket("ts", period.unit, "UTC"), "yyyy-MM-dd").alias("bucket"))
        .agg(F.lit(period.unit).alias("unit"), F.count("*").alias("n"))
    )


@check(
    "M01_port_spread",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([l_discount * 100, l_tax * 100, l_linenumber - 3.0::DOUBLE, 0.0::DOUBLE], lambda x: x <> 0) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(list_max(p) - list_min(p), 6) AS spread, round(list_sum(p) / nullif(len(p), 0), 6) AS mean FROM t""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ports = [F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_linenumber") - 3.0, F.lit(0.0)]
    return s.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(N.port_spread(ports), 6).alias("spread"),
        F.round(N.port_mean(ports), 6).alias("mean"),
    )


@check(
    "M02_angle_gap",
    """SELECT l_orderkey, l_linenumber, l_partkey, abs((((l_partkey % 360) - (l_suppkey * 7 % 360) + 180) % 360 + 360) % 360 - 180)::DOUBLE AS gap FROM lineitem""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    gap = N.angle_gap(F.col("l_partkey") % 360, F.col("l_suppkey") * 7 % 360)
    return s.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", gap.alias("gap"))


@check(
    "M03_distance",
    """WITH r AS (SELECT c_custkey, atan((1 - 1 / 298.257223563) * tan(radians(4.0 + c_custkey % 1000 / 1000.0::DOUBLE))) AS b1,
atan((1 - 1 / 298.257223563) * tan(radians(4.5::DOUBLE))) AS b2, radians(-74.1::DOUBLE - (-74.0::DOUBLE - c_custkey % 777 / 1000.0::DOUBLE)) AS dl FROM customer),
q AS (SELECT *, 2 * asin(sqrt(sin((b2 - b1) / 2) ** 2 + cos(b1) * cos(b2) * sin(dl / 2) ** 2)) AS s, (b1 + b2) / 2 AS m, (b2 - b1) / 2 AS h FROM r)
SELECT c_custkey, round(6378137.0 * (s - 1 / 298.257223563 / 2 * ((s - sin(s)) * (sin(m) * cos(h)) ** 2 / cos(s / 2) ** 2
 + CASE WHEN s = 0 THEN 0 ELSE (s + sin(s)) * (cos(m) * sin(h)) ** 2 / sin(s / 2) ** 2 END)), 2) AS metres FROM q""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    metres = N.distance_m(
        F.expr("4.0e0 + c_custkey % 1000 / 1000.0e0"),
        F.expr("-74.0e0 - c_custkey % 777 / 1000.0e0"),
        F.lit(4.5),
        F.lit(-74.1),
    )
    return s.table(spark, d, "customer").select("c_custkey", F.round(metres, 2).alias("metres"))


@check(
    "M04_composites",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_linenumber * l_suppkey / 10000.0::DOUBLE AS product,
greatest(nullif(l_tax, 0), nullif(l_discount, 0)) AS larger FROM lineitem""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        N.success_product("l_quantity", "l_linenumber", "l_suppkey").alias("product"),
        N.row_max(F.nullif("l_tax", F.lit(0.0)), F.nullif("l_discount", F.lit(0.0))).alias("larger"),
    )


@check(
    "M05_rounding",
    """SELECT c_custkey, round(100.0::DOUBLE * c_nationkey / 7, 2) AS pct, round(abs(c_acctbal), 1) AS size, c_custkey / 10.0::DOUBLE AS tenth,
round(log10(abs(CASE WHEN c_nationkey = 0 THEN 0.1 ELSE c_nationkey END)), 9) AS magnitude FROM customer""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "customer").select(
        "c_custkey",
        N.percent("c_nationkey", F.lit(7)).alias("pct"),
        F.round(F.abs("c_acctbal"), 1).alias("size"),
        (F.col("c_custkey") / F.lit(10.0)).alias("tenth"),
        F.round(N.log_magnitude("c_nationkey"), 9).alias("magnitude"),
    )


@check(
    "N01_maps_and_arrays",
    f"""WITH {s.EVENTS_SQL} SELECT event_id, concat('PLMN-PLMN/USER-', user_id, '/EVENT-', event_id) AS dn,
CASE WHEN event_type = 'view' THEN 'Mode|amount|k|mode' ELSE 'amount|k' END || CASE WHEN value > 50 THEN '|opt' ELSE '' END AS keys,
CASE WHEN event_type <> 'signup' AND value >= 5 THEN k END AS first_tag,
CASE WHEN event_type = 'signup' THEN NULL WHEN value < 5 THEN 0 ELSE len(list_distinct([k, CASE WHEN value > 30 THEN '7' END, cast(event_id % 10 AS VARCHAR)]))
 + CASE WHEN value > 30 THEN 0 ELSE 1 END END AS tags FROM ev""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cm = s.events_cm(spark, d)
    return cm.select(
        X.nth_integer("mo_distname", 2).cast("bigint").alias("event_id"),
        F.col("mo_distname").alias("dn"),
        F.array_join(F.array_sort(F.map_keys("parameters")), "|").alias("keys"),
        Mp.first_item(Mp.map_value("p_lists", "tags")).alias("first_tag"),
        Mp.distinct_size(Mp.map_value("p_lists", "tags")).alias("tags"),
    )


@check(
    "N02_decode_records",
    """SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k, pos FROM events, (SELECT unnest([0, 1]) AS pos)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))
    events = s.table(spark, d, "events").select(
        "event_id", F.posexplode(Mp.decode_records(text, "k bigint")).alias("pos", "record")
    )
    return events.select("event_id", "record.k", "pos")
