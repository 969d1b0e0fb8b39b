"""Column expressions over object names and other text.

Object names (DNs) look like ``PLMN-PLMN/MRBTS-1/LNBTS-1/LNCEL-3``.  Every helper takes a column
(or column name) and returns a column, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# The two name checks applied to uploaded working sets.
SITE_DN_PATTERN = r"^PLMN-PLMN/MRBTS-\w*/LNBTS-\w*$"
CELL_NAME_PATTERN = r"[A-Z][A-Z][A-Z].*_"


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_before(value: ColumnLike, token: str, back: int = 0) -> Column:
    """Python's ``x[:x.find(token) - back]``, including what it does when the token is absent.

    ``find`` then yields -1, so the slice end is negative and counts from the end of the text.
    """
    text = as_column(value)
    end = F.instr(text, token) - F.lit(1 + back)
    from_the_right = F.greatest(F.length(text) + end, F.lit(0))
    return F.substring(text, F.lit(1), F.when(end >= 0, end).otherwise(from_the_right))


def parent_dn(value: ColumnLike, marker: str) -> Column:
    """The part of a DN in front of ``marker`` (such as ``/LNCEL``); '' when the marker is absent."""
    text = as_column(value)
    return F.substring(text, F.lit(1), F.greatest(F.instr(text, marker) - F.lit(1), F.lit(0)))


def target_cell_id(value: ColumnLike) -> Column:
    """The identity between ``ECI-`` and ``/PLMN`` of a neighbour name, NULL if either is missing."""
    text = as_column(value)
    start = F.call_function("locate", F.lit("ECI"), text)
    stop = F.call_function("locate", F.lit("PLMN"), text, start)
    return F.when((start > 0) & (stop > 0), F.substring(text, start + 4, stop - start - 5))


def all_integers(value: ColumnLike) -> Column:
    return F.regexp_extract_all(as_column(value), F.lit("([0-9]+)"), F.lit(1))


def nth_integer(value: ColumnLike, n: int) -> Column:
    """The n-th (1-based) run of digits, NULL when there are fewer."""
    return F.get(all_integers(value), n - 1)


def controller_code(file_name: ColumnLike) -> Column:
    """First ``rc<digits>`` of a dump file name in upper case; '' when there is none."""
    return F.upper(F.regexp_extract(as_column(file_name), "rc[0-9]+", 0))


def is_site_dn(value: ColumnLike) -> Column:
    return as_column(value).rlike(SITE_DN_PATTERN)


def looks_like_cell_name(value: ColumnLike) -> Column:
    return as_column(value).rlike(CELL_NAME_PATTERN)


def split_list(value: ColumnLike, separator: str = ",") -> Column:
    return F.split(as_column(value), separator)


def first_token(value: ColumnLike, separator: str = " ") -> Column:
    return F.substring_index(as_column(value), separator, 1)


def day_text(value: ColumnLike) -> Column:
    """``yyyy-MM-dd`` part of a timestamp text."""
    return F.substring(as_column(value), 1, 10)


def compact_day(value: ColumnLike) -> Column:
    """``yyyyMMdd`` form of a day."""
    return F.replace(day_text(as_column(value).cast("string")), F.lit("-"), F.lit(""))


def kpi_label(kpi_id: ColumnLike, name: ColumnLike) -> Column:
    """Display label ``id - name``; NULL if either part is NULL."""
    return F.concat(as_column(kpi_id), F.lit(" - "), as_column(name))
