"""Catalog-driven KPI queries.

A catalog row holds the SQL text of an aggregate over counter columns.  KPIs that read the same
counters at the same level are computed together in one scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from netquarry.functions.dates import within_local_days
from netquarry.functions.text import text_before
from netquarry.operators.aggregates import offered_to_levels, split_kpis_by_scale, time_rollup
from netquarry.operators.filters import Members, members, probable_members
from netquarry.operators.reshape import pivot_values
from netquarry.plans.views import CELL_LEVEL, SITE_LEVEL, VIEW_COLUMNS, History, SiteViews, shared, site_view
from netquarry.session import resolved

# What a result row may stand for, and the site attribute that names it.
ELEMENTS = {
    "set": None,
    "cluster": "level_2",
    "cell": "sector_name",
    "site": "site_name",
    "band": "band",
}
WHOLE_SET = "WS"

Counters = Mapping[str, DataFrame]
Bound = Callable[[Column], Column] | DataFrame


@dataclass(frozen=True)
class KpiGroup:
    """KPIs that share counters, join condition and level."""

    technology: str
    tables: str
    condition: str
    level: str
    kpis: tuple[Row, ...]


def selected_kpis(catalog: DataFrame, kpi_ids: Sequence[str], technology: str | None = None) -> list[KpiGroup]:
    """Catalog rows of the wanted ids, grouped.  Only the selection is brought to the driver."""
    rows = catalog.where(F.col("KPI_Id").isin(list(kpi_ids)))
    if technology is not None:
        rows = rows.where(F.col("Technology") == technology)
    groups: dict[tuple[str, str, str, str], list[Row]] = {}
    for row in sorted(rows.collect(), key=lambda r: kpi_ids.index(r["KPI_Id"])):
        if row["Level"] not in (CELL_LEVEL, SITE_LEVEL):
            raise ValueError(f"KPI {row['KPI_Id']}: unknown level {row['Level']!r}")
        key = (row["Technology"], row["Tables"], row["Join"] or "", row["Level"])
        groups.setdefault(key, []).append(row)
    return [KpiGroup(*key, kpis=tuple(found)) for key, found in groups.items()]


def _conjuncts(condition: str) -> list[str]:
    """What a condition demands at its top level; nothing if it offers alternatives there."""
    depth, parts = 0, [""]
    for token in re.split(r"(\(|\)|\bAND\b|\bOR\b)", condition, flags=re.IGNORECASE):
        word = token.upper()
        if depth == 0 and word == "OR":
            return []
        if depth == 0 and word == "AND":
            parts.append("")
            continue
        depth += (word == "(") - (word == ")")
        parts[-1] += token
    return parts


def _equalities(condition: str) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """Pairs of (alias, column) that the condition demands to be equal."""
    found = [re.fullmatch(r"\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*", part) for part in _conjuncts(condition)]
    return [((m[1], m[2]), (m[3], m[4])) for m in found if m]


def _equal_to(start: tuple[str, str], equalities: Sequence[tuple[tuple[str, str], tuple[str, str]]]) -> set[tuple[str, str]]:
    """All columns that must equal ``start``."""
    reached, before = {start}, 0
    while len(reached) > before:
        before = len(reached)
        reached |= {x for pair in equalities if reached & set(pair) for x in pair}
    return reached


def counter_source(
    counters: Counters, tables: str, condition: str, bounds: Mapping[str, Bound] | None = None
) -> tuple[DataFrame, str]:
    """The counters of a group as one frame, and the alias of the first.

    ``tables`` reads like ``ho a`` or ``ho a, power b``; ``condition`` joins them.  Its equalities must
    link all tables, so that each join has a key.  ``bounds`` restricts columns of the first table: by a
    condition, or by a frame of the values that may occur.  It is applied to every table whose column
    of that name must equal the first one's, before any of them is joined.
    """
    named: dict[str, str] = {}
    for entry in tables.split(","):
        words = entry.split()
        if not words or words[0] not in counters:
            raise ValueError(f"no counters named {entry.strip()!r}")
        alias = words[-1] if len(words) > 1 else "a"
        if alias in named:
            raise ValueError(f"counters {tables!r} use {alias!r} twice")
        named[alias] = words[0]
    text = re.sub(r"\s+AND$", "", condition.strip(), flags=re.IGNORECASE)
    first = next(iter(named))
    equalities = _equalities(text)
    frames = {alias: counters[table].alias(alias) for alias, table in named.items()}
    for column, bound in (bounds or {}).items():
        for alias, name in sorted(_equal_to((first, column), equalities)):
            if alias not in frames or name not in frames[alias].columns:
                continue
            value = F.col(f"{alias}.{name}")
            if isinstance(bound, DataFrame):
                frames[alias] = probable_members(frames[alias], value, bound)
            else:
                frames[alias] = frames[alias].where(bound(value))
    source, joined = frames[first], {first}
    while len(joined) < len(named):
        for alias in named:
            links = [
                F.col(".".join(x)) == F.col(".".join(y))
                for x, y in equalities
                if {x[0], y[0]} & joined and {x[0], y[0]} - joined == {alias}
            ]
            if links:
                source, joined = source.join(frames[alias], reduce(Column.__and__, links)), joined | {alias}
                break
        else:
            raise ValueError(f"condition {condition!r} does not link the counters {tables!r} by equalities")
    return (source.where(F.expr(text)) if text else source), first


def check_formula(source: DataFrame, kpi_id: str, formula: str) -> None:
    """Raise ValueError unless the text is one aggregate over the columns of ``source``.

    Selected by itself an aggregate makes one row of all.  A constant, a plain column or a window function
    leaves the rows as they are, and a column beside an aggregate cannot be analysed at all.
    """
    try:
        analysed = source.select(F.expr(formula).alias("Value"))._jdf.queryExecution().analyzed()
    except (AnalysisException, ParseException) as error:
        raise ValueError(f"KPI {kpi_id}: {formula!r} is not a usable aggregate: {error}") from error
    if analysed.nodeName() != "Aggregate":
        raise ValueError(f"KPI {kpi_id}: {formula!r} is not an aggregate")


def _wanted_sites(view: DataFrame, level: str, cells: Members | None) -> DataFrame:
    if cells is None:
        return view
    if level == CELL_LEVEL:
        return members(view, "sector_name", cells)
    if isinstance(cells, DataFrame):
        return members(view, "sector_name", cells.select(text_before(cells.columns[0], "_")))
    names = [c[: c.find("_")] for c in cells]
    return members(view, "sector_name", sorted(set(names)))


def _group_rollup(
    group: KpiGroup,
    counters: Counters,
    view: DataFrame,
    levels: Mapping[str, Column],
    unit: str,
    tz: str,
    start: str | date,
    end: str | date,
    end_inclusive: bool,
) -> DataFrame:
    """``measTime, Level, Element`` and one column ``v<i>`` per KPI of the group.

    The view is a file, so Spark broadcasts it if it is small.  Above that size counters are shuffled to
    it, but no counters of objects that are not in it.
    """
    bounds = {
        "measTime": lambda time: within_local_days(time, start, end, tz, end_inclusive),
        "distName": view.select("moDistName"),
    }
    source, first = counter_source(counters, group.tables, group.condition, bounds)
    for kpi in group.kpis:
        check_formula(source, kpi["KPI_Id"], kpi["Formula"])
    sites = view.select(
        F.col("moDistName").alias("__dn"),
        *[c.cast("string").alias(f"__element_{i}") for i, c in enumerate(levels.values())],
    )
    joined = source.join(sites, F.col(f"{first}.distName") == F.col("__dn"))
    if len(levels) == 1:
        element = {"Level": F.lit(next(iter(levels))), "Element": F.col("__element_0")}
    else:
        offers = {name: F.col(f"__element_{i}") for i, name in enumerate(levels)}
        joined = offered_to_levels(joined, offers, "__level", "__element")
        element = {"Level": F.col("__level"), "Element": F.col("__element")}
    formulas = {f"v{i}": kpi["Formula"] for i, kpi in enumerate(group.kpis)}
    return time_rollup(joined, unit, tz, element, formulas, ts=F.col(f"{first}.measTime"))


def _element_column(element: str) -> Column:
    if element not in ELEMENTS:
        raise ValueError(f"unknown element {element!r}; expected one of {', '.join(ELEMENTS)}")
    attribute = ELEMENTS[element]
    return F.lit(WHOLE_SET) if attribute is None else F.col(attribute)


def kpi_query(
    catalog: DataFrame,
    kpi_ids: Sequence[str],
    counters: Counters,
    site_histories: Mapping[str, History],
    element: str | Sequence[str],
    unit: str,
    start: str | date,
    end: str | date,
    tz: str,
    cells: Members | None = None,
    end_inclusive: bool = False,
) -> DataFrame:
    """``measTime, Element, Value, KPI, KPI_Name``: every KPI per local time bucket and element.

    ``cells`` is the working set of cell names; site-level KPIs use the site part of the names.  Several
    elements (``["set", "cluster"]``) are answered in one scan; then ``Level`` tells them apart.
    """
    levels = {name: _element_column(name) for name in ([element] if isinstance(element, str) else element)}
    keys = ["measTime", "Element"] if isinstance(element, str) else ["measTime", "Level", "Element"]
    known: dict[str, SiteViews] = {}
    wanted: dict[tuple[str, str], DataFrame] = {}
    parts = []
    for group in selected_kpis(catalog, kpi_ids):
        views = known.setdefault(group.technology, shared(site_histories[group.technology], VIEW_COLUMNS))
        if (at := (group.technology, group.level)) not in wanted:
            chosen = _wanted_sites(views.at(group.level), group.level, cells)
            wanted[at] = chosen if cells is None else resolved(chosen, "wanted-sites")
        wide = _group_rollup(group, counters, wanted[at], levels, unit, tz, start, end, end_inclusive)
        entries = [
            F.struct(
                F.col(f"v{i}").cast("double").alias("Value"),
                F.lit(kpi["KPI_Id"]).alias("KPI"),
                F.lit(f"{kpi['KPI_Id']} - {kpi['Name']}").alias("KPI_Name"),
            )
            for i, kpi in enumerate(group.kpis)
        ]
        parts.append(wide.select(*keys, F.inline(F.array(*entries))))
    if not parts:
        raise ValueError("none of the wanted KPIs is in the catalog")
    return reduce(DataFrame.unionByName, parts)


def kpi_frame(
    counters: Counters,
    catalog: DataFrame,
    technology: str,
    kpi_ids: Sequence[str],
    start: str | date,
    end: str | date,
    site_history: History,
    groupby: str | None = "sector_name",
    sites: Members | None = None,
    unit: str = "day",
    tz: str = "UTC",
) -> DataFrame:
    """Wide KPI frame ``Date, Cell|Site, <kpi> ...`` (no element column without ``groupby``).

    ``groupby`` is ``sector_name``, ``site_name`` or None; ``sites`` restricts to site names.  KPIs
    the catalog does not know are left out, report schemas fill them in.  Groups of KPIs are put on top of
    each other and grouped once, so objects without a name share a row per date too.
    """
    label = {"sector_name": "Cell", "site_name": "Site", None: "Element"}[groupby]
    shown = F.lit(WHOLE_SET) if groupby is None else F.col(groupby)
    frames = []
    views = shared(site_history, VIEW_COLUMNS)
    for group in selected_kpis(catalog, kpi_ids, technology):
        view = views.at(group.level)
        if sites is not None:
            view = resolved(members(view, "site_name", sites), "wanted-sites")
        wide = _group_rollup(group, counters, view, {label: shown}, unit, tz, start, end, False)
        frames.append(
            wide.select(
                F.date_format("measTime", "yyyy-MM-dd HH:mm:ss").alias("Date"),
                F.col("Element").alias(label),
                *[
                    F.col(f"v{i}").cast("double").alias(kpi["KPI_Id"])
                    for i, kpi in enumerate(group.kpis)
                ],
            )
        )
    if not frames:
        raise ValueError(f"no KPI of {technology} among the wanted ones is in the catalog")
    merged = frames[0]
    if len(frames) > 1:
        stacked = reduce(lambda l, r: l.unionByName(r, allowMissingColumns=True), frames)
        found = [c for c in stacked.columns if c not in ("Date", label)]
        values = [F.first(f"`{c}`", ignorenulls=True).alias(c) for c in found]
        merged = stacked.groupBy("Date", label).agg(*values)
    ordered = [k for k in kpi_ids if k in merged.columns]
    keys = ["Date"] if groupby is None else ["Date", label]
    return merged.select(*keys, *[F.col(f"`{k}`") for k in ordered])


def kpi_pivot(long: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Export shape: one column per ``KPI_Name``.  Without ``names`` they are looked up first."""
    if names is None:
        names = [r[0] for r in long.select("KPI_Name").distinct().orderBy("KPI_Name").collect()]
    return pivot_values(long, ["measTime", "Element"], "KPI_Name", "Value", names)


__all__ = [
    "ELEMENTS",
    "SiteViews",
    "check_formula",
    "kpi_frame",
    "kpi_pivot",
    "kpi_query",
    "selected_kpis",
    "site_view",
    "split_kpis_by_scale",
]
