"""Flattening of map-typed configuration dumps into one table per class, list or item list.

The column sets are found in the data.  One aggregation over all classes and all kinds yields the keys,
how many values of each convert to integers and which ids a class has, so no further pass is needed to
narrow the types or to tell complete objects; each table is then a plain projection of its class.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from netquarry.functions.text import controller_code
from netquarry.operators.columns import last_of_equal_names
from netquarry.operators.snapshots import Snapshots, newest_day

ID_SUFFIX = "_id"
# The id column that carries the controller code, and the version column.
CONTROLLER_ID = "PLMN_id"
VERSION_COLUMN = "moVersion"
NEWEST_DAY_CLASS = "LNCEL"

# What a table is made of.
PARAMETERS, LISTS, ITEMS = "parameters", "lists", "items"
_IDS = "ids"
_FIELDS = "fields"
_ALL_FIELDS = "all fields"
_VERSION = "version"
_ROWS = "rows"
_MORE_ROWS = "more rows"
_KEYS = "keys"
_VALUES = "values"
_INTEGERS = "integers"


# ---- discovery --------------------------------------------------------------------------------


@dataclass
class TableProfile:
    """Row count of a table, and per column how many values exist and how many are integers."""

    rows: int = 0
    present: dict[tuple[str, str], int] = field(default_factory=lambda: defaultdict(int))
    integers: dict[tuple[str, str], int] = field(default_factory=lambda: defaultdict(int))

    def add(self, found: Row, part: str) -> None:
        self.present[part, found["name"]] += found["present"]
        self.integers[part, found["name"]] += found["integers"]

    def keys(self, part: str) -> list[str]:
        return sorted(name for p, name in self.present if p == part)

    def is_integer(self, part: str, name: str, null_is_zero: bool = False) -> bool:
        missing = self.rows - self.present[part, name] if null_is_zero else 0
        return self.integers[part, name] + missing == self.rows


def _entry(
    kind: str, part: str, mapping: Column | str, of: Column | None = None, weight: Column | None = None
) -> Column:
    """One map to be profiled: ``of`` names the list, ``weight`` tells how many rows it stands for."""
    column = F.col(mapping) if isinstance(mapping, str) else mapping
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(part).alias("part"),
        (F.lit("") if of is None else of).alias("of"),
        (F.lit(1) if weight is None else weight).cast("bigint").alias("weight"),
        column.cast("map<string,string>").alias("mapping"),
    )


def _one() -> Column:
    """A map with one entry, to count rows with."""
    return F.create_map(F.lit(""), F.lit(""))


def _present_ids() -> Column:
    return F.coalesce(F.size(F.array_compact(F.map_values("ids"))), F.lit(-1))


def _parameter_entries() -> Column:
    version = F.create_map(F.lit(VERSION_COLUMN), F.col("mo_version"))
    parts = [(_IDS, "ids"), (_FIELDS, "parameters"), (_VERSION, version), (_ROWS, _one())]
    return F.array(*[_entry(PARAMETERS, part, mapping) for part, mapping in parts])


def _list_entries() -> Column:
    def of_list(entry: Column) -> Column:
        name, values = entry["key"], F.array_compact(entry["value"])
        whole = F.filter(values, lambda v: v.try_cast("bigint").isNotNull())
        return F.array(
            _entry(LISTS, _IDS, "ids", name),
            _entry(LISTS, _ROWS, _one(), name),
            _entry(LISTS, _VALUES, _one(), name, F.size(values)),
            _entry(LISTS, _INTEGERS, _one(), name, F.size(whole)),
        )

    filled = F.filter(F.map_entries("p_lists"), lambda e: F.size(F.array_compact(e["value"])) > 0)
    return F.concat(F.array(_entry(LISTS, _KEYS, "ids")), F.flatten(F.transform(filled, of_list)))


def _item_entries() -> Column:
    def of_list(entry: Column) -> Column:
        name, items = entry["key"], F.coalesce(entry["value"], F.array().cast("array<map<string,string>>"))
        first = F.transform(F.slice(items, 1, 1), lambda m: _entry(ITEMS, _FIELDS, m, name))
        every = F.transform(items, lambda m: _entry(ITEMS, _ALL_FIELDS, m, name))
        more = _entry(ITEMS, _MORE_ROWS, _one(), name, F.greatest(F.size(items) - 1, F.lit(0)))
        return F.concat(F.array(more), first, every)

    whole = F.array(_entry(ITEMS, _IDS, "ids"), _entry(ITEMS, _ROWS, _one()))
    return F.concat(whole, F.flatten(F.transform(F.map_entries("item_lists"), of_list)))


_SOURCES = {PARAMETERS: "parameters", LISTS: "p_lists", ITEMS: "item_lists"}
_ENTRIES = {PARAMETERS: _parameter_entries, LISTS: _list_entries, ITEMS: _item_entries}


class DumpProfile:
    """What one pass over a dump has found, per kind, class and list.

    Classes whose names are equal but for case share a table, and so do lists.
    """

    def __init__(self, found: Iterable[Row]) -> None:
        self._rows: dict[tuple[str, str], list[Row]] = defaultdict(list)
        for row in found:
            self._rows[row["kind"], row["mo_class"].upper()].append(row)

    def classes(self, kind: str) -> list[str]:
        return sorted(name for k, name in self._rows if k == kind)

    def spellings(self, kind: str, name: str) -> list[str]:
        """The classes of that name."""
        return sorted({r["mo_class"] for r in self._rows[kind, name]})

    def lists(self, kind: str, name: str) -> dict[str, list[str]]:
        """The lists of a class by upper-case name, as they are spelt."""
        found: dict[str, set[str]] = defaultdict(set)
        for r in self._rows[kind, name]:
            if r["of"]:
                found[r["of"].upper()].add(r["of"])
        return {n: sorted(spelt) for n, spelt in sorted(found.items())}

    def id_counts(self, name: str) -> dict[str, int]:
        """How many ids an object of each class of that name has when it lacks none."""
        keys: dict[str, set[str]] = {spelt: set() for spelt in self.spellings(LISTS, name)}
        for r in self._rows[LISTS, name]:
            if r["part"] == _KEYS:
                keys[r["mo_class"]].add(r["name"])
        return {spelt: len(found) for spelt, found in keys.items()}

    def profile(self, kind: str, name: str, of: str = "", parts: Sequence[str] = ()) -> TableProfile:
        """The counts of some parts; of lists only those of complete objects."""
        profile, complete = TableProfile(), self.id_counts(name) if kind == LISTS else {}
        for r in self._rows[kind, name]:
            if r["of"].upper() not in ("", of) or (complete and r["ids"] != complete[r["mo_class"]]):
                continue
            if r["part"] == _ROWS or (r["part"] == _MORE_ROWS and _ALL_FIELDS in parts):
                profile.rows += r["seen"]
            elif r["part"] in parts:
                profile.add(r, r["part"])
        return profile

    def total(self, name: str, of: str, part: str) -> int:
        complete = self.id_counts(name)
        rows = (r for r in self._rows[LISTS, name] if r["part"] == part and r["of"].upper() == of)
        return sum(r["seen"] for r in rows if r["ids"] == complete[r["mo_class"]])


def profile_dump(rows: DataFrame, kinds: Sequence[str] = (PARAMETERS, ITEMS, LISTS)) -> DumpProfile:
    """Profile all classes in one aggregation.

    Entries become rows and are counted at once, so what is shuffled and fetched is one row per column of
    a table, whatever the size of a class.  Lists count complete objects only; which they are is known
    when all keys of a class are, so their counts are kept apart by the number of ids an object has.
    """
    entries = [
        F.when(F.col(_SOURCES[kind]).isNotNull(), _ENTRIES[kind]()).otherwise(F.array().cast(_ENTRY_TYPE)) for kind in kinds
    ]
    found = (
        rows.select("mo_class", _present_ids().alias("ids_present"), F.inline(F.concat(*entries)))
        .select(
            "mo_class", "kind", "part", "of", "weight", F.explode("mapping").alias("name", "value"),
            F.when(F.col("kind") == LISTS, F.col("ids_present")).otherwise(F.lit(-1)).alias("ids"),
        )
        .groupBy("mo_class", "kind", "part", "of", "ids", "name")
        .agg(
            F.sum("weight").alias("seen"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("weight"))), F.lit(0)).alias("present"),
            F.coalesce(F.sum(F.when(F.col("value").try_cast("bigint").isNotNull(), F.col("weight"))), F.lit(0)).alias("integers"),
        )
    )
    return DumpProfile(found.collect())


_ENTRY_TYPE = "array<struct<kind:string,part:string,of:string,weight:bigint,mapping:map<string,string>>>"


def _on_day(cm: Snapshots, day: str | date | None) -> DataFrame:
    if not isinstance(cm, DataFrame):
        day = cm.newest(NEWEST_DAY_CLASS) if day is None else day
        return cm.rows(day=day) if day is not None else cm.rows().limit(0)
    if day is None:
        return cm.where(F.col("raml_date") == newest_day(cm, NEWEST_DAY_CLASS).scalar())
    return cm.where(F.col("raml_date") == F.lit(str(day)).cast("date"))


# ---- names ------------------------------------------------------------------------------------


class TableNames:
    """Names of tables; one that is taken is qualified instead of lost."""

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}

    def add(self, table: DataFrame, *names: str) -> None:
        """Under the first name that is free, else the last one with a number."""
        free = [n for n in names if n not in self.tables]
        number = 2
        while not free:
            free = [n for n in (f"{names[-1]}_{number}",) if n not in self.tables]
            number += 1
        self.tables[free[0]] = table


def _table_columns(own: dict[str, Column], found: dict[str, Column], kind: str) -> list[Column]:
    """The table's own columns (ids, version), then those found in the data.

    Of found names that are equal ignoring case the last stays, and likewise among ids.  One that is equal
    to an own column's name is another thing and gets its kind behind its name.
    """
    columns = {n: own[n] for n in last_of_equal_names(list(own))}
    taken = {n.upper() for n in columns}
    for name in last_of_equal_names(list(found)):
        shown = name
        while shown.upper() in taken:
            shown = f"{shown}_{kind}"
        taken.add(shown.upper())
        columns[shown] = found[name]
    return [c.alias(n) for n, c in columns.items()]


def _id_columns(profile: TableProfile, mapping: str, null_is_zero: bool = False) -> dict[str, Column]:
    """``<key>_id`` columns, the controller code in place of the PLMN id."""
    found = {key + ID_SUFFIX: _value(profile, _IDS, mapping, key, null_is_zero) for key in profile.keys(_IDS)}
    return {**found, CONTROLLER_ID: controller_code("filename")}


def _value(profile: TableProfile, part: str, mapping: str, key: str, null_is_zero: bool = False) -> Column:
    value = F.element_at(mapping, F.lit(key))
    if null_is_zero:
        value = F.coalesce(value, F.lit("0"))
    return value.cast("bigint") if profile.is_integer(part, key, null_is_zero) else value


def _of_classes(rows: DataFrame, spellings: Sequence[str]) -> DataFrame:
    """Rows of the classes; a plain test on the column, so that it prunes partitions."""
    if len(spellings) == 1:
        return rows.where(F.col("mo_class") == spellings[0])
    return rows.where(F.col("mo_class").isin(list(spellings)))


# ---- tables -----------------------------------------------------------------------------------


def _parameter_tables(rows: DataFrame, found: DumpProfile, names: TableNames) -> None:
    rows = rows.where(F.col("parameters").isNotNull())
    for name in found.classes(PARAMETERS):
        profile = found.profile(PARAMETERS, name, parts=(_IDS, _FIELDS, _VERSION))
        version = F.col("mo_version")
        if profile.is_integer(_VERSION, VERSION_COLUMN):
            version = version.cast("bigint")
        own = {**_id_columns(profile, "ids"), VERSION_COLUMN: version}
        fields = {key: _value(profile, _FIELDS, "parameters", key) for key in profile.keys(_FIELDS)}
        of_class = _of_classes(rows, found.spellings(PARAMETERS, name))
        names.add(of_class.select(*_table_columns(own, fields, "parameter")), name)


def _list_tables(rows: DataFrame, found: DumpProfile, names: TableNames) -> None:
    rows = rows.where(F.col("p_lists").isNotNull())
    for name in found.classes(LISTS):
        counts = found.id_counts(name)
        complete = F.lit(False)
        for spelt, n in counts.items():
            complete = complete | ((F.col("mo_class") == spelt) & (_present_ids() == n))
        of_class = _of_classes(rows, list(counts)).where(complete)
        for of, spelt_lists in found.lists(LISTS, name).items():
            profile = found.profile(LISTS, name, of, (_IDS,))
            if not profile.rows:
                continue
            value = F.col("Value")
            if found.total(name, of, _INTEGERS) == found.total(name, of, _VALUES):
                value = value.cast("bigint")
            columns = _table_columns(_id_columns(profile, "ids"), {"optionId": F.col("optionId"), "Value": value}, "list")
            whole: DataFrame | None = None
            for spelt in spelt_lists:
                entries = F.posexplode(F.element_at("p_lists", F.lit(spelt))).alias("optionId", "Value")
                part = of_class.select("ids", "filename", entries).where(F.col("Value").isNotNull()).select(*columns)
                whole = part if whole is None else whole.unionByName(part)
            names.add(whole, f"{name}_{of}", f"{name}__{of}", f"{name}__{of}__LIST")


def _item_tables(rows: DataFrame, found: DumpProfile, names: TableNames, all_items: bool) -> None:
    rows = rows.where(F.col("item_lists").isNotNull())
    part = _ALL_FIELDS if all_items else _FIELDS
    for name in found.classes(ITEMS):
        of_class = _of_classes(rows, found.spellings(ITEMS, name))
        for of, spelt_lists in found.lists(ITEMS, name).items():
            profile = found.profile(ITEMS, name, of, (_IDS, part))
            items = F.element_at("item_lists", F.lit(spelt_lists[0]))
            if len(spelt_lists) > 1:
                items = F.flatten(F.array_compact(F.array(*[F.element_at("item_lists", F.lit(s)) for s in spelt_lists])))
            if all_items:
                of_list = of_class.select("ids", "filename", F.posexplode_outer(items).alias("itemId", "item"))
            else:
                of_list = of_class.select("ids", "filename", F.get(items, 0).alias("item"))
            own = _id_columns(profile, "ids", null_is_zero=True)
            # The controller code closes the table.
            last = {CONTROLLER_ID: own.pop(CONTROLLER_ID)}
            fields = {key: _value(profile, part, "item", key, null_is_zero=True) for key in profile.keys(part)}
            place = {"itemId": F.col("itemId")} if all_items else {}
            columns = _table_columns({**own, **place, **last}, fields, "item")
            code = next(i for i, c in enumerate({**own, **place, **last}) if c == CONTROLLER_ID)
            columns.append(columns.pop(code))
            names.add(of_list.select(*columns), f"{name}_{of}", f"{name}__{of}", f"{name}__{of}__ITEM")


def flatten_parameters(cm: Snapshots, day: str | date | None = None) -> dict[str, DataFrame]:
    """One wide table per class: ids, version and every parameter.  Keys are upper-case class names.

    A column becomes bigint when all its values convert; one with a missing value stays text.  Classes
    equal but for case share a table.  A parameter called like an id or version column, whatever the case,
    is named ``<name>_parameter``.
    """
    rows, names = _on_day(cm, day), TableNames()
    _parameter_tables(rows, profile_dump(rows, [PARAMETERS]), names)
    return names.tables


def flatten_lists(cm: Snapshots, day: str | date | None = None) -> dict[str, DataFrame]:
    """One table per class and list, a row per entry: ids, ``optionId`` from 0, ``Value``.

    Rows with any missing id or value are left out.
    """
    rows, names = _on_day(cm, day), TableNames()
    _list_tables(rows, profile_dump(rows, [LISTS]), names)
    return names.tables


def flatten_items(cm: Snapshots, day: str | date | None = None, all_items: bool = False) -> dict[str, DataFrame]:
    """One table per class and item list with the fields of each object's first item.

    Every object of the class has a row.  Missing values become 0.  The fields are those found in
    the first items of all objects.  With ``all_items`` there is a row per item, numbered by ``itemId``
    from 0, with the fields of all items; an object without any keeps one row, without a number.
    """
    rows, names = _on_day(cm, day), TableNames()
    _item_tables(rows, profile_dump(rows, [ITEMS]), names, all_items)
    return names.tables


def publish_daily(cm: Snapshots, all_items: bool = False) -> dict[str, DataFrame]:
    """All tables of the newest day of the cell class, found in one pass.

    Classes come first and keep their names.  An item list or list whose ``<class>_<list>`` is taken is
    called ``<class>__<list>``, with its kind behind it if that is taken too.
    """
    if isinstance(cm, DataFrame):
        day = newest_day(cm, NEWEST_DAY_CLASS).first()["last_date"]
    else:
        day = cm.newest(NEWEST_DAY_CLASS)
    names = TableNames()
    if day is not None:
        rows = _on_day(cm, day)
        found = profile_dump(rows)
        _parameter_tables(rows, found, names)
        _item_tables(rows, found, names, all_items)
        _list_tables(rows, found, names)
    return names.tables
