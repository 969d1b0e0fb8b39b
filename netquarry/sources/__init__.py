"""Inputs and outputs."""

from netquarry.sources.dump import Dump
from netquarry.sources.readers import (
    kpi_catalog,
    read_cm,
    read_counters,
    read_kpi_catalog,
    read_kpi_frame,
    read_sites,
    read_template,
    read_working_set,
)
from netquarry.sources.writers import (
    bundle_audits,
    deliver,
    deliver_audits,
    write_audit,
    write_bundle,
    write_class_tables,
    write_csv_export,
    write_report,
)

__all__ = [
    "Dump",
    "bundle_audits",
    "deliver",
    "deliver_audits",
    "kpi_catalog",
    "read_cm",
    "read_counters",
    "read_kpi_catalog",
    "read_kpi_frame",
    "read_sites",
    "read_template",
    "read_working_set",
    "write_audit",
    "write_bundle",
    "write_class_tables",
    "write_csv_export",
    "write_report",
]
