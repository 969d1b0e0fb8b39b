"""Every operator run on the driver tables, each beside an independent SQL statement."""

from checks.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
