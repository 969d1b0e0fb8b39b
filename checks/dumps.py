"""Flattening of configuration dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from netquarry import plans as P

_DAY = "2024-01-01"
_CLASSES = ("LNCEL", "error", "purchase", "signup", "view")


def _as_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables on top of each other as text, with the names of their integer columns."""
    whole: DataFrame | None = None
    for name, frame in tables.items():
        integers = "|".join(sorted(c for c, t in frame.dtypes if t == "bigint"))
        rows = frame.select(
            F.lit(name).alias("table_name"),
            F.lit(integers).alias("integers"),
            *[F.col(c).cast("string").alias(c) for c in frame.columns],
        )
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    assert whole is not None
    return whole


def _parameter_branch(mo_class: str) -> str:
    """The upper-case duplicate 'Mode' gives way to 'mode'; a column with gaps stays text."""
    mode = "'lower'" if mo_class == "view" else "cast(NULL AS VARCHAR)"
    node = (
        "CASE WHEN value > 20 THEN cast(event_id AS VARCHAR) END"
        if mo_class == "error"
        else "cast(NULL AS VARCHAR)"
    )
    return f"""SELECT '{mo_class.upper()}' AS table_name, 'USER_id|k|moVersion' AS integers, rc AS "PLMN_id", cast(user_id AS VARCHAR) AS "USER_id",
{node} AS "NODE_id", cast(event_id % 2 AS VARCHAR) AS "moVersion", k, cast(value AS VARCHAR) AS amount, {mode} AS mode,
CASE WHEN value > 50 THEN '1' END AS opt FROM ev WHERE mo_class = '{mo_class}' {{where}}"""


def _parameters_sql(where: str = "") -> str:
    return " UNION ALL ".join(_parameter_branch(c) for c in _CLASSES).replace("{where}", where)


# In class error an id is missing from some rows; rows without it are left out.
_LISTS_SQL = """SELECT concat(upper(mo_class), '_', upper(list)) AS table_name,
  CASE WHEN list = 'tags' THEN 'USER_id|Value' ELSE 'USER_id' END || '' AS integers_raw, rc AS "PLMN_id", cast(user_id AS VARCHAR) AS "USER_id",
  CASE WHEN mo_class = 'error' THEN cast(event_id AS VARCHAR) END AS "NODE_id", cast(pos AS VARCHAR) AS "optionId", v AS "Value" FROM (
SELECT *, 'tags' AS list, unnest([0, 1, 2]) AS pos, unnest([k, CASE WHEN value > 30 THEN '7' END, cast(event_id % 10 AS VARCHAR)]) AS v FROM ev WHERE mo_class <> 'signup' AND value >= 5
UNION ALL SELECT *, 'notes', 0, cast(value AS VARCHAR) FROM ev WHERE mo_class <> 'signup')
WHERE v IS NOT NULL AND (mo_class <> 'error' OR value > 20) {where}"""


def _lists_sql(where: str = "") -> str:
    body = _LISTS_SQL.replace("{where}", where)
    return f"""SELECT table_name, CASE WHEN table_name LIKE 'ERROR%' THEN 'NODE_id|' ELSE '' END || integers_raw AS integers,
"PLMN_id", "USER_id", "NODE_id", "optionId", "Value" FROM ({body})"""


def _items_sql(where: str = "") -> str:
    return f"""SELECT 'PURCHASE_ITEMS' AS table_name, 'USER_id|f1|f2' AS integers, rc AS "PLMN_id", cast(user_id AS VARCHAR) AS "USER_id",
CASE WHEN value >= 5 THEN k ELSE '0' END AS f1, CASE WHEN value > 50 THEN cast(event_id AS VARCHAR) ELSE '0' END AS f2
FROM ev WHERE mo_class = 'purchase' {where}"""


@check("C27_flatten_parameters", f"WITH {s.EVENTS_SQL} {_parameters_sql()}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _as_rows(P.flatten_parameters(s.events_cm(spark, d), _DAY))


@check("C28_flatten_lists", f"WITH {s.EVENTS_SQL} {_lists_sql()}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _as_rows(P.flatten_lists(s.events_cm(spark, d), _DAY))


@check("C29_flatten_items", f"WITH {s.EVENTS_SQL} {_items_sql()}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _as_rows(P.flatten_items(s.events_cm(spark, d), _DAY))


# A row per item; objects without any keep one, whose fields are 0.
_ALL_ITEMS_SQL = """SELECT 'PURCHASE_ITEMS' AS table_name, 'USER_id|f2' AS integers, rc AS "PLMN_id", cast(user_id AS VARCHAR) AS "USER_id",
pos AS "itemId", f1, f2 FROM (
SELECT *, CASE WHEN value >= 5 THEN '0' END AS pos, CASE WHEN value >= 5 THEN k ELSE '0' END AS f1,
  CASE WHEN value > 50 THEN cast(event_id AS VARCHAR) ELSE '0' END AS f2 FROM ev WHERE mo_class = 'purchase'
UNION ALL SELECT *, '1', 'second', '0' FROM ev WHERE mo_class = 'purchase' AND value >= 5)"""


@check("C29_flatten_all_items", f"WITH {s.EVENTS_SQL} {_ALL_ITEMS_SQL}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _as_rows(P.flatten_items(s.events_cm(spark, d), _DAY, all_items=True))


_NEWEST = """AND date_trunc('week', ts) = (SELECT max(date_trunc('week', ts)) FROM events WHERE event_type = 'click')"""


@check(
    "C30_publish_daily",
    f"""WITH {s.EVENTS_SQL}, whole AS ({_parameters_sql(_NEWEST)} UNION ALL BY NAME {_lists_sql(_NEWEST)} UNION ALL BY NAME {_items_sql(_NEWEST)})
SELECT * FROM whole""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _as_rows(P.publish_daily(s.events_cm(spark, d, weekly=True)))
