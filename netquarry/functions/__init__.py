"""Column expressions."""

from netquarry.functions import dates, maps, numeric, text

__all__ = ["dates", "maps", "numeric", "text"]
