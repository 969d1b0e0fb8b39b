"""Reusable DataFrame operators."""

from netquarry.operators import aggregates, columns, filters, joins, reshape, snapshots

__all__ = ["aggregates", "columns", "filters", "joins", "reshape", "snapshots"]
