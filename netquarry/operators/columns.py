"""Schema work: fixed report schemas, key discovery, duplicate names, integer narrowing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_report_schema(
    df: DataFrame, columns: Sequence[str], fill: float | None = None, data_type: str = "double"
) -> DataFrame:
    """Exactly ``columns`` in that order; those the frame lacks are NULL or ``fill``."""
    present = set(df.columns)
    return df.select(
        *[
            F.col(f"`{c}`") if c in present else F.lit(fill).cast(data_type).alias(c)
            for c in columns
        ]
    )


def map_keys_of(df: DataFrame, column: str, by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """Distinct keys of a map column, per group if ``by`` is given."""
    return df.select(*by, F.explode(F.map_keys(column)).alias(key)).distinct()


def last_of_equal_names(names: Sequence[str]) -> list[str]:
    """Drop a name when a later one equals it ignoring case."""
    last = {name.upper(): i for i, name in enumerate(names)}
    return [name for i, name in enumerate(names) if last[name.upper()] == i]


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep only the last of columns whose names are equal ignoring case."""
    names = df.columns
    last = {name.upper(): i for i, name in enumerate(names)}
    kept = [i for i, name in enumerate(names) if last[name.upper()] == i]
    if len(kept) == len(names):
        return df
    unique = df.toDF(*[f"__c{i}" for i in range(len(names))])
    return unique.select(*[F.col(f"__c{i}").alias(names[i]) for i in kept])


def narrow_integers(
    df: DataFrame, columns: Sequence[str] | None = None, otherwise_double: bool = False
) -> DataFrame:
    """Cast text columns to bigint when every row of theirs converts, else leave them.

    One aggregation looks at all columns.  A NULL does not convert, so a column with one stays text.
    ``otherwise_double`` casts the rest to double (counters).
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in texts if columns is None or c in columns]
    if not chosen:
        return df
    tests = [
        F.count(F.col(f"`{c}`").try_cast("bigint")).alias(f"n{i}") for i, c in enumerate(chosen)
    ]
    tally = df.agg(F.count("*").alias("rows"), *tests).first()
    casts = {}
    for i, c in enumerate(chosen):
        if tally[f"n{i}"] == tally["rows"]:
            casts[c] = F.col(f"`{c}`").cast("bigint")
        elif otherwise_double:
            casts[c] = F.col(f"`{c}`").try_cast("double")
    return df.withColumns(casts) if casts else df


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(defaults))
