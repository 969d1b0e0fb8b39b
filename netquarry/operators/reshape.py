"""Wide to long, long to wide, and maps and lists to columns and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.maps import first_item, map_value


def melt(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    name: str = "Parameter",
    value: str = "Cur_Value",
) -> DataFrame:
    """One row per id and column; NULL values keep their row."""
    return df.unpivot(list(ids), list(columns), name, value)


def pivot_values(
    long: DataFrame, keys: Sequence[str], name: str, value: str, values: Sequence[str]
) -> DataFrame:
    """One column per entry of ``values``.  Raises at run time if a cell has more than one row."""
    repeated = F.raise_error(F.lit("pivot: more than one row for a key and column"))
    cell = F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.first(value))
    return long.groupBy(*keys).pivot(name, list(values)).agg(cell)


def transpose(
    df: DataFrame, column_key: str, rows: Sequence[str], columns: Sequence[str], fill: str | None = None
) -> DataFrame:
    """Turn the columns ``rows`` into rows and the values of ``column_key`` into columns.

    All values become text, since a row mixes days, labels and numbers.  ``item_position`` keeps
    the order of ``rows``.
    """
    texts = [F.struct(F.lit(i).alias("item_position"), F.lit(r).alias("item"),
                      F.col(f"`{r}`").cast("string").alias("value")) for i, r in enumerate(rows)]
    long = df.select(F.col(column_key).alias("__column"), F.inline(F.array(*texts)))
    wide = pivot_values(long, ["item_position", "item"], "__column", "value", columns)
    return wide.na.fill(fill) if fill is not None else wide


def widen_map(
    df: DataFrame, mapping: str, keys: Sequence[str], suffix: str = "", keep: Sequence[str] = ()
) -> DataFrame:
    return df.select(*keep, *[map_value(mapping, k).alias(k + suffix) for k in keys])


def explode_lists(
    df: DataFrame, lists: str = "p_lists", list_name: str = "list", complete_only: bool = True
) -> DataFrame:
    """One row per list entry, with the list's name, ``optionId`` from 0 and ``Value``.

    Empty and NULL lists give no row; with ``complete_only`` neither do NULL entries.
    """
    others = [c for c in df.columns if c != lists]
    named = df.select(*others, F.explode(lists).alias(list_name, "__items"))
    rows = named.select(*others, list_name, F.posexplode("__items").alias("optionId", "Value"))
    return drop_null_values(rows) if complete_only else rows


def drop_null_values(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("Value").isNotNull())


def first_items(
    df: DataFrame, items: str, list_key: str, fields: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """The first item of one list of a map of lists, a column per field."""
    head = df.select(*keep, first_item(F.element_at(items, F.lit(list_key))).alias("__item"))
    return widen_map(head, "__item", fields, keep=keep)
