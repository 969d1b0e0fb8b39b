"""Arithmetic over antenna ports, angles, positions and KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.text import ColumnLike, as_column

# The WGS84 ellipsoid.
WGS84_EQUATOR_M = 6378137.0
WGS84_FLATTENING = 1 / 298.257223563


def _nonzero(ports: Sequence[ColumnLike]) -> Column:
    values = F.array(*[as_column(p).cast("double") for p in ports])
    return F.filter(values, lambda v: v != F.lit(0.0))


def port_spread(ports: Sequence[ColumnLike]) -> Column:
    """Largest minus smallest reading over the ports that are not zero; NULL if all are zero."""
    live = _nonzero(ports)
    return F.abs(F.array_max(live) - F.array_min(live))


def port_mean(ports: Sequence[ColumnLike]) -> Column:
    """Mean reading over the ports that are not zero; NULL if all are zero."""
    live = _nonzero(ports)
    total = F.aggregate(live, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(live).cast("double"))


def angle_gap(a: ColumnLike, b: ColumnLike) -> Column:
    """Smallest angle between two bearings in degrees."""
    turned = F.pmod(as_column(a) - as_column(b) + F.lit(180.0), F.lit(360.0))
    return F.abs(turned - F.lit(180.0))


def distance_m(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Distance on the WGS84 ellipsoid in metres (Lambert's formula for long lines).

    The haversine angle is taken on reduced latitudes and corrected for flattening, which stays
    within metres of the exact geodesic and needs no iteration.
    """
    flat = WGS84_FLATTENING
    beta1 = F.atan(F.lit(1 - flat) * F.tan(F.radians(as_column(lat1))))
    beta2 = F.atan(F.lit(1 - flat) * F.tan(F.radians(as_column(lat2))))
    dlon = F.radians(as_column(lon2) - as_column(lon1))
    chord = F.pow(F.sin((beta2 - beta1) / 2), F.lit(2.0)) + F.cos(beta1) * F.cos(beta2) * F.pow(
        F.sin(dlon / 2), F.lit(2.0)
    )
    sigma = F.lit(2.0) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
    mid, half = (beta1 + beta2) / 2, (beta2 - beta1) / 2
    x = F.try_divide(
        (sigma - F.sin(sigma)) * F.pow(F.sin(mid) * F.cos(half), F.lit(2.0)),
        F.pow(F.cos(sigma / 2), F.lit(2.0)),
    )
    y = F.try_divide(
        (sigma + F.sin(sigma)) * F.pow(F.cos(mid) * F.sin(half), F.lit(2.0)),
        F.pow(F.sin(sigma / 2), F.lit(2.0)),
    )
    correction = F.lit(flat / 2) * (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.lit(WGS84_EQUATOR_M) * (sigma - correction)


def success_product(a: ColumnLike, b: ColumnLike, c: ColumnLike) -> Column:
    """Three percentages chained into one."""
    return as_column(a) * as_column(b) * as_column(c) / F.lit(10000.0)


def row_max(first: ColumnLike, second: ColumnLike, *more: ColumnLike) -> Column:
    """Largest value of a row; NULLs are skipped."""
    return F.greatest(*[as_column(c) for c in (first, second, *more)])


def delivery_ratio(sent: ColumnLike, lost: ColumnLike) -> Column:
    """Percent of messages that arrived; NULL when none was sent."""
    tx = as_column(sent)
    return F.try_divide(F.lit(100.0) * (tx - as_column(lost)), tx)


def percent(part: ColumnLike, whole: ColumnLike, digits: int = 2) -> Column:
    ratio = F.try_divide(F.lit(100.0) * as_column(part), as_column(whole))
    return F.round(ratio, digits)


def log_magnitude(value: ColumnLike) -> Column:
    """log10 of the absolute value, a zero counting as 0.1."""
    v = as_column(value).cast("double")
    return F.log10(F.abs(F.when(v == 0, F.lit(0.1)).otherwise(v)))
