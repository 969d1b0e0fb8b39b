"""Audits of site inventory, software version and parameter values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.maps import map_columns
from netquarry.operators.aggregates import deviation_summary
from netquarry.operators.filters import (
    Members,
    by_prefix,
    differs,
    drop_incomplete,
    in_sites,
    members,
    site_part,
)
from netquarry.operators.joins import assign_site
from netquarry.operators.snapshots import Snapshots, latest_snapshot


def site_list(cm: Snapshots) -> DataFrame:
    """``name, mo_distname`` of every site in the newest snapshot, by name."""
    sites = latest_snapshot(cm, "LNBTS").select(
        "mo_distname", "raml_date", *map_columns("parameters", ["name"])
    )
    return drop_incomplete(sites).select("name", "mo_distname").orderBy("name")


def audit_sw_version(cm: Snapshots, sites: Members, version: str) -> DataFrame:
    """Whether each site runs the expected version: ``OK`` or ``NO-OK``."""
    current = members(latest_snapshot(cm, "LNBTS"), "mo_distname", sites)
    return current.select(
        *map_columns("parameters", {"name": "LNBTS_Name"}),
        "mo_distname",
        "mo_version",
        F.when(F.col("mo_version") == version, "OK").otherwise("NO-OK").alias("Version_OK"),
    )


def newest_rows_of(cm: Snapshots, classes: list[str]) -> DataFrame:
    """Rows of several classes, each on its own newest day, in one scan.

    The days (one row per class) are fetched first and put into the filter as literals, which then
    prunes the partitions of the single scan.
    """
    days = (
        cm.where(F.col("mo_class").isin(classes))
        .groupBy("mo_class")
        .agg(F.max("raml_date").alias("day"))
        .collect()
    )
    wanted = F.lit(False)
    for row in days:
        wanted = wanted | (
            (F.col("mo_class") == row["mo_class"]) & (F.col("raml_date") == F.lit(row["day"]))
        )
    return cm.where(wanted)


def audit_parameters(
    cm: Snapshots,
    template: DataFrame,
    sites: DataFrame,
    literal_sites: bool = False,
    exclude_zero: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Compare parameters with the template; returns ``(summary, detail)``.

    ``sites`` has the site DNs in ``item`` and, for ``literal_sites``, their order in ``pos``.
    A template row is looked up in the parameter map of every object of its class, so nothing is
    widened and melted again and all classes share one pass.  A parameter an object lacks counts
    as deviated.
    """
    classes = [row["Object"] for row in template.select("Object").distinct().collect()]
    current = newest_rows_of(cm, classes)
    if literal_sites:
        chosen = assign_site(
            by_prefix(current, "mo_distname", sites), "mo_distname", sites, literal=True
        )
    else:
        chosen = in_sites(current, "mo_distname", sites.select("item")).withColumn(
            "site_id", site_part("mo_distname")
        )
    objects = chosen.select(
        "mo_distname", "raml_date", F.col("mo_class").alias("Object"), "parameters", "site_id"
    )
    detail = (
        objects.join(template, on="Object")
        .withColumn("Cur_Value", F.element_at("parameters", F.col("Parameter")))
        .where(differs("Cur_Value", "Value"))
        .select("mo_distname", "raml_date", "Parameter", "Cur_Value", "Object", "Value", "site_id")
    )
    keys = ["site_id", "Object"]
    # Every object of a class is compared on all template parameters of the class, so the total is
    # objects times parameters and the compared rows themselves need not be shuffled.
    per_class = template.groupBy("Object").agg(F.count_distinct("Parameter").alias("parameters"))
    totals = (
        objects.groupBy(*keys)
        .agg(F.count_distinct("mo_distname").alias("objects"))
        .join(per_class, on="Object")
        .select(*keys, (F.col("objects") * F.col("parameters")).alias("total"))
    )
    deviated = detail.groupBy(*keys).agg(F.count("mo_distname").alias("deviated"))
    summary = deviation_summary(totals, deviated, keys, exclude_zero).select(
        *keys,
        F.col("total").alias("mo_distname_total"),
        F.col("deviated").alias("mo_distname_dev"),
        F.col("deviation").alias("Deviation"),
    )
    return summary, detail
