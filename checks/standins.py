"""The driver tables in the shape of network data.

A customer is a site, an order a cell of it, an order line an observation of that cell: a site
history record, a counter interval, a handover, an antenna line or a relation.  The SQL texts build
the same tables for the oracle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_DAYS = ("2024-03-01", "2024-03-02")
LATE_DAY = "2024-03-03"

_DN = {
    "LTE": "concat('PLMN-PLMN/MRBTS-', o_custkey, '/LNBTS-', o_custkey, '/LNCEL-', o_orderkey)",
    "UMTS": "concat('PLMN-PLMN/RNC-', c_nationkey, '/WBTS-', o_custkey, '/WCEL-', o_orderkey)",
    "GSM": "concat('PLMN-PLMN/BSC-', c_nationkey, '/BCF-', o_custkey, '/BTS-', o_orderkey)",
}
_SITE_DN = {
    "LTE": "concat('PLMN-PLMN/MRBTS-', o_custkey, '/LNBTS-', o_custkey)",
    "UMTS": "concat('PLMN-PLMN/RNC-', c_nationkey, '/WBTS-', o_custkey)",
}
_SECTOR = {
    "LTE": "concat('S', o_custkey, '_', o_orderkey)",
    "UMTS": "concat('S', o_custkey, '_U', o_orderkey)",
    "GSM": "concat('S', o_custkey, '_G', o_orderkey)",
}
_HISTORY = {
    "export_date": "l_shipdate",
    "site_name": "concat('S', o_custkey)",
    "latitud": "4.0e0 + (o_custkey % 1000) / 1000.0e0",
    "longitud": "-74.0e0 - (o_custkey % 777) / 1000.0e0",
    "azimuth": "cast((o_orderkey * 37 + l_linenumber * 15) % 360 as double)",
    "electrical_tilt": "cast(cast(l_quantity as int) % 12 as double)",
    "site_type": "case when l_returnflag = 'R' then 'Indoor' else 'Outdoor' end",
    "level_1": "r_name",
    "level_2": "case when n_nationkey = 0 then '0' else n_name end",
    "band": "o_orderpriority",
    "rnc_name": "concat('RNC', c_nationkey)",
    "bsc_name": "concat('BSC', c_nationkey)",
}
_COUNTERS = {
    "measTime": "l_shipdate",
    "measInterval": "l_linenumber",
    "qty": "cast(l_quantity as bigint)",
    "lost": "cast(l_quantity as bigint) % 5",
    "price": "l_extendedprice",
    "M8015C8": "cast(l_quantity as bigint) - 3",
    "M8015C9": "cast(l_quantity as bigint) % 7",
    "M8005C306": "cast(l_linenumber * 10 - 1200 as double)",
    "M8005C307": "cast(case when l_linenumber = 3 then null else -1100 end as double)",
    "M8005C308": "cast(case when l_linenumber < 3 then 0 else -1000 end as double)",
    "M8005C309": "cast(-l_quantity * 10 as double)",
}


@lru_cache(maxsize=64)
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; kept, since every read looks into the file for its schema."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@lru_cache(maxsize=64)
def spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table dealt by the key it is joined on, so that one large file does not mean one task."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, folder, name).repartition(parts, key)


def cells(
    spark: SparkSession, folder: str, *, region: bool = False, evenly: bool = False
) -> DataFrame:
    """Orders with the nation of their customer, and its names on request."""
    customer = table(spark, folder, "customer")
    orders = (
        spread(spark, folder, "orders", "o_custkey")
        if evenly
        else table(spark, folder, "orders")
    )
    found = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    if not region:
        return found
    nation, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    return found.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )


def observations(
    spark: SparkSession, folder: str, *, customer: bool = True, region: bool = False
) -> DataFrame:
    """Order lines with their order, and no further tables than asked for."""
    lines = spread(spark, folder, "lineitem", "l_orderkey")
    orders = (
        cells(spark, folder, region=region)
        if customer or region
        else table(spark, folder, "orders")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


OBSERVATIONS_SQL = """obs AS (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _columns(texts: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in texts.items()]


def _sql_columns(texts: dict[str, str]) -> str:
    return ", ".join(f'{text} AS "{name}"' for name, text in texts.items())


def _history_columns(technology: str) -> dict[str, str]:
    return {"moDistName": _DN[technology], "sector_name": _SECTOR[technology], **_HISTORY}


def site_history(spark: SparkSession, folder: str, technology: str) -> DataFrame:
    lines = observations(spark, folder, region=True)
    return lines.select(*_columns(_history_columns(technology)))


def history_sql(technology: str, as_of: str | None = None) -> str:
    """CTEs ``hist_<tech>`` and ``cur_<tech>`` (newest record per sector); needs ``obs``.

    With ``as_of`` also ``asof_<tech>``, the newest records up to that time.
    """
    t = technology.lower()

    def newest(name: str, rows: str) -> str:
        return f"""{name}_{t} AS (SELECT h.* FROM {rows} h JOIN (SELECT sector_name, max(export_date) AS newest
  FROM {rows} GROUP BY sector_name) m ON h.sector_name = m.sector_name AND h.export_date = m.newest)"""

    ctes = [f"hist_{t} AS (SELECT {_sql_columns(_history_columns(technology))} FROM obs)", newest("cur", f"hist_{t}")]
    if as_of is not None:
        ctes.append(f"past_{t} AS (SELECT * FROM hist_{t} WHERE export_date <= TIMESTAMP '{as_of}')")
        ctes.append(newest("asof", f"past_{t}"))
    return ",\n".join(ctes)


def _counter_columns(technology: str, site_level: bool) -> dict[str, str]:
    dn = _SITE_DN[technology] if site_level else _DN[technology]
    target = "concat('PLMN-PLMN/MRBTS-0/LNBTS-0/X-1/ECGI-1/ECI-', l_partkey, '/PLMN-PLMN/MCC-1')"
    return {"distName": dn, "extendedDistName": target, **_COUNTERS}


def counters(
    spark: SparkSession, folder: str, technology: str = "LTE", site_level: bool = False
) -> DataFrame:
    lines = observations(spark, folder, customer=technology != "LTE")
    return lines.select(*_columns(_counter_columns(technology, site_level)))


def counters_sql(technology: str = "LTE", site_level: bool = False, name: str = "pm") -> str:
    return f"{name} AS (SELECT {_sql_columns(_counter_columns(technology, site_level))} FROM obs)"


def _probe_columns(technology: str) -> dict[str, str]:
    dn = f"concat({_SITE_DN[technology]}, '/FTM-', l_linenumber)"
    return {
        "measTime": "l_shipdate",
        "measInterval": "l_linenumber % 2",
        "distName": dn,
        "extendedDistName": f"concat({dn}, '/T-1')",
        "avgRTT_15Min": "cast(l_quantity as bigint)",
        "maxRTT_15Min": "cast(l_quantity as bigint) * 2",
        "minRTT_15Min": "cast(l_quantity as bigint) % 3",
        "lostTwampMessages": "cast(l_quantity as bigint) % 5",
        "txTwampMessages": "cast(l_quantity as bigint)",
    }


def probes(spark: SparkSession, folder: str, technology: str) -> DataFrame:
    lines = observations(spark, folder, customer=technology != "LTE")
    return lines.select(*_columns(_probe_columns(technology)))


def probes_sql(technology: str) -> str:
    return f"probes AS (SELECT {_sql_columns(_probe_columns(technology))} FROM obs)"


def site_set(spark: SparkSession, folder: str, segment: str | None = None) -> DataFrame:
    """Working set of site DNs: customers in credit, or those of a market segment."""
    customer = table(spark, folder, "customer")
    chosen = (
        customer.where(F.col("c_acctbal") > 0)
        if segment is None
        else customer.where(F.col("c_mktsegment") == segment)
    )
    return chosen.select(
        F.expr("concat('PLMN-PLMN/MRBTS-', c_custkey, '/LNBTS-', c_custkey)").alias("item"),
        F.col("c_custkey").alias("pos"),
    )


def site_set_sql(segment: str | None = None) -> str:
    where = "c_acctbal > 0" if segment is None else f"c_mktsegment = '{segment}'"
    return (
        "site_set AS (SELECT concat('PLMN-PLMN/MRBTS-', c_custkey, '/LNBTS-', c_custkey) AS item, "
        f"c_custkey AS pos FROM customer WHERE {where})"
    )


# Class -> (source, DN, ids, parameters); all texts are valid in both dialects.
_CLASSES: dict[str, tuple[str, str, dict[str, str], dict[str, str]]] = {
    "LNBTS": (
        "sites",
        "concat('PLMN-PLMN/MRBTS-', c_custkey, '/LNBTS-', c_custkey)",
        {"PLMN": "'PLMN'", "MRBTS": "c_custkey", "LNBTS": "c_custkey"},
        {
            "name": "case when c_acctbal < 0 then null else concat('S', c_custkey) end",
            "enbName": "c_name",
            "operationalState": "c_mktsegment",
            "timer": "c_nationkey % 4",
        },
    ),
    "LNCEL": (
        "cells",
        _DN["LTE"],
        {"MRBTS": "o_custkey", "LNBTS": "o_custkey", "LNCEL": "o_orderkey"},
        {
            "name": _SECTOR["LTE"],
            "phyCellId": "o_orderkey % 7",
            "eutraCelId": "o_orderkey",
            "tac": "c_nationkey * 10 + case when o_orderpriority = '1-URGENT' then 1 else 0 end",
            "lcrId": "o_orderkey",
            "pMax": "case when o_orderstatus = 'P' then null else o_orderkey % 3 end",
        },
    ),
    "LNCEL_FDD": (
        "cells",
        f"concat({_DN['LTE']}, '/LNCEL_FDD-0')",
        {"LNBTS": "o_custkey", "LNCEL": "o_orderkey"},
        {
            "earfcnDL": "substring(o_orderpriority, 1, 1)",
            "rootSeqIndex": "o_orderkey % 11",
            "prachCS": "o_orderkey % 5",
        },
    ),
    "WCEL": (
        "cells",
        _DN["UMTS"],
        {"RNC": "c_nationkey", "WBTS": "o_custkey", "WCEL": "o_orderkey"},
        {
            "name": _SECTOR["UMTS"],
            "LAC": "c_nationkey * 10 + case when o_orderstatus = 'P' then 1 else 0 end",
        },
    ),
    "LNADJ": (
        "handovers",
        f"concat({_SITE_DN['LTE']}, '/LNADJ-', t_custkey)",
        {"LNBTS": "o_custkey"},
        {"adjEnbId": "t_custkey"},
    ),
    "LNRELW": (
        "customer lines",
        f"concat({_DN['LTE']}, '/LNRELW-', l_linenumber)",
        {"LNBTS": "o_custkey", "LNCEL": "o_orderkey"},
        {"targetCellDn": _DN["UMTS"]},
    ),
    "CHANNEL": (
        "lines",
        f"concat({_SITE_DN['LTE']}, '/CHANNEL-', l_linenumber)",
        {
            "MRBTS": "o_custkey",
            "LCELL": "case when l_returnflag = 'N' then null else o_orderkey end",
        },
        {"antlDN": "concat('ANT-', o_orderkey, '-', l_linenumber)"},
    ),
    "RETU": (
        "lines",
        f"concat({_SITE_DN['LTE']}, '/RETU-', l_linenumber)",
        {"MRBTS": "o_custkey"},
        {"angle": "cast(l_quantity as int) % 12 * 10"},
    ),
    "ALD": (
        "sites",
        "concat('PLMN-PLMN/MRBTS-', c_custkey, '/ALD-1')",
        {"MRBTS": "c_custkey"},
        {"model": "c_mktsegment"},
    ),
}
_LINE_LIST = [
    "concat('ANT-', o_orderkey, '-', l_linenumber)",
    "concat('ANT-', o_orderkey, '-', l_linenumber + 1)",
]


def _dump_columns(kind: str) -> dict[str, str]:
    site = "c_custkey" if kind == "sites" else "o_custkey"
    return {
        "mo_version": f"case when {site} % 25 < 13 then 'V1' else 'V2' end",
        "filename": f"concat('dump_rc', {site} % 3 + 1, '_day.xml')",
    }



def _source(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    if kind == "sites":
        return table(spark, folder, "customer")
    if kind == "cells":
        return cells(spark, folder, evenly=True)
    lines = observations(spark, folder, customer=kind == "customer lines")
    if kind != "handovers":
        return lines
    targets = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("t_orderkey"), F.col("o_custkey").alias("t_custkey")
    )
    handovers = lines.join(targets, F.col("l_partkey") == F.col("t_orderkey"))
    return handovers.select("o_custkey", "t_custkey").distinct()


_SOURCE_SQL = {
    "sites": "customer",
    "cells": "orders JOIN customer ON o_custkey = c_custkey",
    "lines": "obs",
    "customer lines": "obs",
    "handovers": "(SELECT DISTINCT o_custkey, t_custkey FROM obs JOIN (SELECT o_orderkey AS t_orderkey, "
    "o_custkey AS t_custkey FROM orders) ON l_partkey = t_orderkey)",
}


def _text_map(texts: dict[str, str], keep_null: bool) -> Column:
    parts = [p for k, t in texts.items() for p in (F.lit(k), F.expr(t).cast("string"))]
    mapping = F.create_map(*parts)
    if keep_null or not any("null" in text for text in texts.values()):
        return mapping
    return F.map_filter(mapping, lambda _, v: v.isNotNull())


def cm(spark: SparkSession, folder: str, classes: list[str] | None = None) -> DataFrame:
    """Configuration snapshots of all classes; antenna units have one day more than the others."""
    parts = []
    for mo_class in classes or list(_CLASSES):
        kind, dn, ids, parameters = _CLASSES[mo_class]
        days = [*SNAPSHOT_DAYS, LATE_DAY] if mo_class == "RETU" else SNAPSHOT_DAYS
        lists = (
            F.create_map(F.lit("antlDNList"), F.array(*[F.expr(t) for t in _LINE_LIST]))
            if mo_class == "RETU"
            else F.lit(None)
        )
        parts.append(
            _source(spark, folder, kind).select(
                F.explode(F.array(*[F.lit(d).cast("date") for d in days])).alias("raml_date"),
                F.lit(mo_class).alias("mo_class"),
                F.expr(dn).alias("mo_distname"),
                *_columns(_dump_columns(kind)),
                _text_map(ids, keep_null=False).alias("ids"),
                _text_map(parameters, keep_null=True).alias("parameters"),
                lists.cast("map<string,array<string>>").alias("p_lists"),
                F.lit(None).cast("map<string,array<map<string,string>>>").alias("item_lists"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def cm_sql(*classes: str) -> str:
    """CTEs ``cm_<class>``: the rows of one day, ids as ``id_<key>``, parameters by name."""
    ctes = []
    for mo_class in classes:
        kind, dn, ids, parameters = _CLASSES[mo_class]
        texts = {
            "mo_distname": dn,
            **_dump_columns(kind),
            **{f"id_{k}": f"cast({t} as varchar)" for k, t in ids.items()},
            **{k: f"cast({t} as varchar)" for k, t in parameters.items()},
        }
        ctes.append(
            f"cm_{mo_class.lower()} AS (SELECT {_sql_columns(texts)} FROM {_SOURCE_SQL[kind]})"
        )
    return ",\n".join(ctes)


def events_cm(spark: SparkSession, folder: str, weekly: bool = False) -> DataFrame:
    """Event rows as a configuration dump with uneven keys, lists and item lists."""
    events = spread(spark, folder, "events", "event_id")
    return events.withColumn("k", F.expr("get_json_object(props, '$.k')")).select(
        F.expr(
            "to_date(date_trunc('week', ts))" if weekly else "to_date(date_trunc('month', ts))"
        ).alias("raml_date"),
        F.expr("case when event_type = 'click' then 'LNCEL' else event_type end").alias("mo_class"),
        F.expr("concat('PLMN-PLMN/USER-', user_id, '/EVENT-', event_id)").alias("mo_distname"),
        F.expr("cast(event_id % 2 as string)").alias("mo_version"),
        F.expr("concat('dump_rc', user_id % 3 + 1, '_day.xml')").alias("filename"),
        F.expr(
            "map_filter(map('PLMN', 'PLMN', 'USER', cast(user_id as string), 'NODE', "
            "case when event_type = 'error' and value > 20 then cast(event_id as string) end), "
            "(key, v) -> v is not null)"
        ).alias("ids"),
        F.expr(
            "map_filter(map('k', k, 'amount', cast(value as string), "
            "'Mode', case when event_type = 'view' then 'upper' end, "
            "'mode', case when event_type = 'view' then 'lower' end, "
            "'opt', case when value > 50 then '1' end), (key, v) -> v is not null)"
        ).alias("parameters"),
        F.expr(
            "case when event_type <> 'signup' then map('tags', case when value < 5 then "
            "cast(array() as array<string>) else array(k, case when value > 30 then '7' end, "
            "cast(event_id % 10 as string)) end, 'notes', array(cast(value as string))) end"
        ).alias("p_lists"),
        F.expr(
            "case when event_type = 'purchase' then map('items', case when value < 5 then "
            "cast(array() as array<map<string,string>>) else array(map_filter(map('f1', k, 'f2', "
            "case when value > 50 then cast(event_id as string) end), (key, v) -> v is not null), "
            "map('f1', 'second')) end) end"
        ).alias("item_lists"),
    )


EVENTS_SQL = """ev AS (SELECT *, json_extract_string(props, '$.k') AS k,
  CASE WHEN event_type = 'click' THEN 'LNCEL' ELSE event_type END AS mo_class,
  concat('RC', user_id % 3 + 1) AS rc FROM events)"""
