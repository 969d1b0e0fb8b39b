"""Mixing of sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import WORD, stored, whole_text

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2

# A document's place is 60 bits of a hash; a histogram resolves the first 12, the boundary bucket is
# resolved by 12 more, and what lies in that bucket of a bucket by the rest.
LEVELS = (48, 36, 0)


def place(doc_id: str = "doc_id") -> Column:
    """The document's place in the order of its source: 60 bits of the digest of its id."""
    text = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Sources in code-point order, null last, take the weights in turn.  A target is the source's part
    of ``share`` times all sizes by weight, but at most ``most`` times its own size; what is over is
    dealt to the others by weight until none is above.  With the sources in order of cap per weight
    those that reach their cap come first, and the first that stays below tells the level for the rest.
    The windows see one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__i", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    ranked = (
        ranked.withColumn("__w", weight)
        .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    ranked = ranked.withColumn("__level", level)
    below = F.col("__level") * F.col("__w") < F.col("__cap")
    ranked = ranked.withColumn("__least", F.min(F.when(below, F.struct(F.col("__cap") / F.col("__w"), F.col("__i"), F.col("__level")))).over(everything))
    settled = F.coalesce(F.col("__least.__level") * F.col("__w"), F.col("__cap"))
    return ranked.select("source", "source_size", F.least(settled, F.col("__cap")).alias("target"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the place up to which documents are taken once more than the rest.

    Each level sums sizes by source and bucket of the places, finds the bucket in which the running
    sum passes the budget, and only this one goes on to the next level.  Of the two cuts around the
    budget the nearer one is taken.
    """
    once = F.col("target") < F.col("source_size")
    state = targets.select(
        "source",
        F.when(once, F.col("target")).otherwise(F.col("target") - F.col("source_size")).alias("left"),
        F.when(once, 0).otherwise(1).alias("base"),
        F.lit(0).cast("long").alias("prefix"),
    )
    rows = sized.where("size > 0")
    shift_before = 60
    for shift in LEVELS:
        inside = rows.join(
            state, rows["source"].eqNullSafe(state["source"]) & (F.shiftright(rows["place"], shift_before) == state["prefix"])
        ).select(rows["source"], "left", "base", F.shiftright("place", shift).alias("bucket"), "size")
        sums = inside.groupBy("source", "left", "base", "bucket").agg(F.sum("size").alias("size"))
        running = F.sum("size").over(
            Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        crossing = sums.withColumn("upto", running).where(F.col("upto") >= F.col("left"))
        found = crossing.groupBy("source", "base").agg(
            F.min(F.struct("bucket", "size", "upto", "left")).alias("b")
        )
        short = F.col("b.left") - (F.col("b.upto") - F.col("b.size"))
        if shift:
            state = found.select("source", short.alias("left"), "base", F.col("b.bucket").alias("prefix"))
        else:
            whole = 2 * short >= F.col("b.size")
            state = found.select("source", "base", (F.col("b.bucket") - F.when(whole, 0).otherwise(1)).alias("upto"))
        state = stored(state, "mix-level")
        shift_before = shift
    return state


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How many words the mix takes of each document: ``doc_id, size, source_size, target, taken, times``.

    A document is taken a whole number of times, 0 to ``most`` (2 at most): all documents of a source
    the same number of times, and those up to a place in hash order once more.  The place is found by
    histograms, so nothing is sorted and a source of any size is handled by sums of buckets.  A source
    ends within half a document of its target.  Runs on the same rows agree.

    Null text has size 0, null is a source of its own, a null id has the place of the empty text, rows
    of one id are taken together.  Other columns are ignored.  An empty table gives no rows; a source
    without words gets target 0.
    """
    if most != 2:
        raise ValueError("documents are taken up to two times")
    own = {"size": _size(text), "place": place(doc_id)}
    sized = stored(
        docs.select(
            F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            *[value.alias(name) for name, value in own.items()],
        ),
        "mix-sizes",
    )
    plan = _plan(sized, weights, share, most)
    # One row per source, read from files, so that Spark checks its size before it broadcasts it.
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["__source"]))
    times = _times(F.col("size"), F.col("place"))
    return joined.select(
        "doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("size") * times).alias("taken"), times.alias("times"),
    )


def _size(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """One row per source: ``__source, __source_size, __target, __base, __upto``, stored."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most), "mix-targets")
    cut = _thresholds(sized, targets)
    joined = targets.join(cut, targets["source"].eqNullSafe(cut["source"]), "left")
    return stored(
        joined.select(
            targets["source"].alias("__source"), F.col("source_size").alias("__source_size"),
            F.col("target").alias("__target"), F.col("base").alias("__base"), F.col("upto").alias("__upto"),
        ),
        "mix-plan",
    )


def _times(size: Column, at: Column) -> Column:
    once_more = F.when(at <= F.col("__upto"), 1).otherwise(0)
    return F.when(size == 0, 0).otherwise(F.coalesce(F.col("__base") + once_more, F.lit(0))).cast("int")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    The texts are not shuffled: every row finds its number of times from its source's row of the plan.
    """
    own = {"__size": _size("text"), "__place": place("doc_id")}
    sized = docs.select(F.col("`source`"), own["__size"].alias("size"), own["__place"].alias("place"))
    plan = _plan(stored(sized, "mix-sizes"), weights, share, MOST)
    joined = docs.withColumns(own).join(plan, F.col("`source`").eqNullSafe(F.col("__source")))
    times = _times(F.col("__size"), F.col("__place"))
    copies = joined.withColumn("__times", times).where("__times > 0")
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
