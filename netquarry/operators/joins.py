"""Joins with the NULL, neighbour, bearing and containment rules of the audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.numeric import angle_gap
from netquarry.operators.filters import maybe_member, site_part
from netquarry.session import resolved

KeyPair = str | tuple[str, str]


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[KeyPair],
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Equality join that keeps the left key columns.

    ``null_safe`` lets NULL keys match each other (data-frame libraries do, SQL does not); Spark
    still hashes on the keys.  The other column names of both sides must differ.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    renamed = right.withColumnsRenamed({r: f"__right_{r}" for _, r in pairs})
    condition: Column | None = None
    for l_name, r_name in pairs:
        l_key, r_key = left[l_name], renamed[f"__right_{r_name}"]
        same = l_key.eqNullSafe(r_key) if null_safe else l_key == r_key
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    kept_right = [r for l, r in pairs if l != r]
    joined = joined.drop(*[f"__right_{r}" for l, r in pairs if l == r])
    return joined.withColumnsRenamed({f"__right_{r}": r for r in kept_right})


def suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns})


def neighbour_pairs(
    pairs: DataFrame,
    cells: DataFrame,
    adjacency: DataFrame,
    code: str,
    name: str = "LNCEL_Name",
    site: str = "LNBTS_id",
    adjacent: str = "adjEnbId",
    carrier: str = "earfcnDL",
    null_safe: bool = False,
    sift: bool = False,
) -> DataFrame:
    """Those of the measured ``pairs`` whose cells lie on adjacent sites and share carrier and code.

    ``pairs`` has the cell names in ``<name>_Orig`` and ``<name>_Dest``; the attributes of both cells
    are added with these suffixes.  The cells are looked up by name and then compared, so work grows
    with the pairs; joining cells on their code would form every pair of cells that has it.
    ``null_safe`` counts two missing carriers or codes as equal.  With ``sift`` the pairs of like cells are
    resolved to a file first, and adjacent sites that no such pair asks for are not shuffled; cells that are
    dealt by name stay so.
    """

    def same(column: str) -> Column:
        left, right = F.col(f"{column}_Orig"), F.col(f"{column}_Dest")
        if null_safe:
            return left.eqNullSafe(right)
        # An equality would become a key of the join, and all cells be dealt anew by it.
        return (left <= right) & (left >= right) if sift else left == right

    links = adjacency.select(
        F.col(site).alias(f"{site}_Orig"), F.col(adjacent).alias(f"{site}_Dest")
    )
    ends = [f"{site}_Orig", f"{site}_Dest"]
    like = (
        pairs.join(suffixed(cells, "_Orig"), on=f"{name}_Orig")
        .join(suffixed(cells, "_Dest"), on=f"{name}_Dest")
        .where(same(carrier) & same(code))
    )
    if sift:
        like = resolved(like, "like-cells")
        # Equal values of unequal types have unequal hashes.
        if [like.schema[e].dataType for e in ends] == [links.schema[e].dataType for e in ends]:
            links = links.where(maybe_member(F.struct(*ends), like.select(F.struct(*ends))))
        # Conditions of the join on single sites would make relations and their newest day unlike plans.
        links = resolved(links, "adjacent-sites")
    return like.join(links, on=ends)


def join_within_angle(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_angle: str,
    right_angle: str,
    tolerance: float,
    gap: str = "dif_az",
) -> DataFrame:
    """Pairs with equal ``on`` whose bearings are at most ``tolerance`` degrees apart.

    The circle is cut into sectors wider than the tolerance.  A left row lies in one sector, a right
    row is offered to its own and the two next to it, and the join key is (``on``, sector).  A group
    with very many rows is so spread over the sectors and never compared as a whole.  Sectors are a
    tenth of a degree wide at least, so a tolerance of 0 finds equal bearings.
    """
    sectors = max(1, int(360.0 // (max(tolerance, 0.1) * 1.0001)))
    width = 360.0 / sectors
    sector = "__sector"

    def sector_of(angle: str) -> Column:
        turned = F.pmod(F.col(angle).cast("double"), F.lit(360.0))
        return F.least(F.floor(turned / F.lit(width)), F.lit(sectors - 1)).cast("int")

    around = F.array_distinct(
        F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)),
            lambda step: F.pmod(sector_of(right_angle) + step, F.lit(sectors)),
        )
    )
    left_rows = left.where(F.col(left_angle).isNotNull()).withColumn(sector, sector_of(left_angle))
    right_rows = right.where(F.col(right_angle).isNotNull()).withColumn(sector, F.explode(around))
    return (
        left_rows.join(right_rows, on=[on, sector])
        .drop(sector)
        .withColumn(gap, angle_gap(left_angle, right_angle))
        .where(F.col(gap) <= tolerance)
    )


def assign_site(
    df: DataFrame,
    dn: str,
    sites: DataFrame,
    item: str = "item",
    position: str = "pos",
    literal: bool = False,
    depth: int = 3,
) -> DataFrame:
    """Add ``site_id``: the site an object belongs to, '' if none.

    By default the first ``depth`` DN parts must equal a site.  With ``literal`` a site counts when
    it occurs anywhere inside the DN, and of several the one with the highest ``position`` wins;
    each distinct DN is then cut into pieces of the lengths that sites have, matched by equality.
    """
    known = sites.select(
        F.col(item).alias("__item"), F.col(position).alias("__pos")
    ).where(F.col("__item").isNotNull())
    names = df.select(dn).where(F.col(dn).isNotNull()).distinct()
    if literal:
        lengths = known.agg(F.collect_set(F.length("__item")).alias("lengths")).scalar()
        last_start = F.length(dn) - F.col("__length") + 1
        pieces = F.transform(
            F.sequence(F.lit(1), last_start),
            lambda start: F.substring(F.col(dn), start, F.col("__length")),
        )
        candidates = (
            names.select(dn, F.explode(lengths).alias("__length"))
            .where((F.col("__length") > 0) & (last_start >= 1))
            .select(dn, F.explode(F.array_distinct(pieces)).alias("__item"))
        )
    else:
        candidates = names.select(dn, site_part(dn, depth).alias("__item"))
    chosen = (
        candidates.join(known, on="__item")
        .groupBy(dn)
        .agg(F.max_by("__item", "__pos").alias("site_id"))
    )
    return df.join(chosen, on=dn, how="left").na.fill("", subset=["site_id"])


def missing_relations(expected: DataFrame, configured: DataFrame, on: Sequence[KeyPair]) -> DataFrame:
    """Expected rows without a configured counterpart."""
    return equi_join(expected, configured, on, how="left_anti")
