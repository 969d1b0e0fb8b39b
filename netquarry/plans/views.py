"""Current views of the site history, shared by the queries and audits of one run."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.text import parent_dn
from netquarry.operators.snapshots import latest_per_key
from netquarry.session import resolved

CELL_LEVEL = "sector_name"
SITE_LEVEL = "site_name"
# What a view to join counters with is made of.
VIEW_COLUMNS = ("moDistName", "sector_name", "site_name", "level_2", "band")


class SiteViews:
    """The current records of one site history, each view resolved once to a file.

    Whatever takes a site history takes this instead; then all that one run asks of it reads the same
    file, whose size is known, and the history itself is scanned once per view.  ``columns`` are those the
    run needs; a file keeps no others.
    """

    def __init__(self, history: DataFrame, columns: Sequence[str] | None = None) -> None:
        self.history = history if columns is None else history.select(*dict.fromkeys([*columns, "export_date"]))
        self._kept: dict[tuple[str, str | None], DataFrame] = {}

    def newest(self, key: str = CELL_LEVEL, as_of: str | date | None = None) -> DataFrame:
        """The newest records per key, ties included."""
        name = (key, None if as_of is None else str(as_of))
        if name not in self._kept:
            self._kept[name] = resolved(latest_per_key(self.history, [key], "export_date", as_of), f"current-{key}")
        return self._kept[name]

    def at(self, level: str) -> DataFrame:
        """Objects to join counters with; those of cells are read from the file of their newest records."""
        name = ("view", level)
        if name not in self._kept:
            view = site_view(self, level)
            self._kept[name] = view if level == CELL_LEVEL else resolved(view, f"site-view-{level}")
        return self._kept[name]


History = DataFrame | SiteViews


def shared(history: History, columns: Sequence[str] | None = None) -> SiteViews:
    """The history as views, for a plan that reads one of them more than once, with the columns it needs."""
    return history if isinstance(history, SiteViews) else SiteViews(history, columns)


def newest_sites(history: History, key: str = CELL_LEVEL, as_of: str | date | None = None) -> DataFrame:
    """The newest records per key of a history, from the shared view if there is one."""
    if isinstance(history, SiteViews):
        return history.newest(key, as_of)
    return latest_per_key(history, [key], "export_date", as_of)


def site_view(history: History, level: str) -> DataFrame:
    """Current objects to join counters with: cells, or sites under their own DN."""
    current = newest_sites(history, level)
    if level == CELL_LEVEL:
        dn, name = F.col("moDistName"), F.col("sector_name")
    else:
        dn, name = parent_dn("moDistName", "/LNCEL"), F.col("site_name")
    view = current.select(
        dn.alias("moDistName"),
        name.alias("sector_name"),
        "site_name",
        F.col("level_2"),
        "band",
    )
    return view if level == CELL_LEVEL else view.distinct()
