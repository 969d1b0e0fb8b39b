"""Look-ups in the map and list columns of configuration rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.functions.text import ColumnLike, as_column


def map_value(mapping: ColumnLike, key: str) -> Column:
    """Value under ``key``; NULL when the map has no such key."""
    return F.element_at(as_column(mapping), F.lit(key))


def map_columns(mapping: str, keys: list[str] | dict[str, str]) -> list[Column]:
    """One named column per key.  A dict renames: ``{key: column name}``."""
    names = keys if isinstance(keys, dict) else {k: k for k in keys}
    return [map_value(mapping, key).alias(name) for key, name in names.items()]


def first_item(items: ColumnLike) -> Column:
    """First element of an array; NULL when it is empty."""
    return F.get(as_column(items), 0)


def distinct_size(items: ColumnLike) -> Column:
    return F.size(F.array_distinct(as_column(items)))


def decode_records(text: ColumnLike, record_schema: T.StructType | str) -> Column:
    """A JSON list of records as an array of structs; explode it with ``inline``."""
    if isinstance(record_schema, T.StructType):
        return F.from_json(as_column(text), T.ArrayType(record_schema))
    return F.from_json(as_column(text), f"array<struct<{record_schema}>>")
