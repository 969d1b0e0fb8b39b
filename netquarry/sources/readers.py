"""Readers for the inputs of the package.  Each returns a lazy DataFrame with a declared schema."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.functions.dates import within_local_days
from netquarry.functions.text import kpi_label

CM_SCHEMA = (
    "raml_date date, mo_class string, mo_distname string, mo_version string, filename string, "
    "ids map<string,string>, parameters map<string,string>, "
    "p_lists map<string,array<string>>, item_lists map<string,array<map<string,string>>>"
)
CATALOG_SCHEMA = (
    "KPI_Id string, Name string, Technology string, Level string, Formula string, "
    "`Tables` string, `Join` string"
)
TEMPLATE_SCHEMA = "Object string, Parameter string, Value string"
WORKING_SET_SCHEMA = "item string"


def _load(spark: SparkSession, location: str, schema: str | None = None) -> DataFrame:
    """A path (anything with a slash) is read as parquet, any other name as a table."""
    if "/" in location:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(location)
    return spark.table(location)


def read_cm(
    spark: SparkSession,
    location: str,
    mo_class: str | None = None,
    day: str | date | None = None,
) -> DataFrame:
    """Configuration snapshots.  Partitioned by ``raml_date, mo_class``, both filters prune files."""
    cm = _load(spark, location, CM_SCHEMA if "/" in location else None)
    if mo_class is not None:
        cm = cm.where(F.col("mo_class") == mo_class)
    if day is not None:
        cm = cm.where(F.col("raml_date") == F.lit(str(day)).cast("date"))
    return cm


def read_sites(spark: SparkSession, location: str, technology: str | None = None) -> DataFrame:
    """Site history of one technology; ``location`` may hold a ``{technology}`` placeholder."""
    return _load(spark, location.format(technology=technology))


def read_counters(
    spark: SparkSession,
    location: str,
    start: str | date | None = None,
    end: str | date | None = None,
    tz: str = "UTC",
    ts: str = "measTime",
) -> DataFrame:
    """Counters from day ``start`` to day ``end`` in ``tz``; each bound holds by itself."""
    counters = _load(spark, location)
    if start is not None or end is not None:
        counters = counters.where(within_local_days(ts, start, end, tz))
    return counters


def kpi_catalog(raw: DataFrame) -> DataFrame:
    """Catalog rows with NULLs as '' and a display column ``ID``."""
    return raw.na.fill("").withColumn("ID", kpi_label("KPI_Id", "Name"))


def read_kpi_catalog(spark: SparkSession, location: str) -> DataFrame:
    return kpi_catalog(_load(spark, location))


def read_working_set(spark: SparkSession, path: str) -> DataFrame:
    """One item per line, no header."""
    return spark.read.schema(WORKING_SET_SCHEMA).csv(path, header=False)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Golden values, ``;`` separated with a header; every value stays text."""
    return spark.read.schema(TEMPLATE_SCHEMA).csv(path, sep=";", header=True)


def read_kpi_frame(
    spark: SparkSession, path: str, kpi_ids: list[str], element: str = "Cell"
) -> DataFrame:
    """KPI result records as JSON, one record or one list of records per line.

    The schema is declared from the wanted KPIs, so no pass is spent on inference and KPIs that a
    file lacks are NULL.
    """
    fields = [T.StructField("Date", T.StringType()), T.StructField(element, T.StringType())]
    fields += [T.StructField(kpi, T.DoubleType()) for kpi in kpi_ids]
    return spark.read.schema(T.StructType(fields)).json(path)
