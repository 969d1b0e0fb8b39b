"""Sharding by balanced label propagation."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import shuffle_partitions, stored, whole_text

SHARDS = 8
BLOCKS = 64
FINE = 4096
FILL = 65536


def _bucket(parts: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in of], F.lit(parts)), F.lit(parts)).cast("int")


def _upto(rows: DataFrame, by: str, room: dict[int, float]) -> DataFrame:
    """For each shard in ``by`` the bucket up to which its rows have room, from a histogram: ``by, upto``."""
    space = F.coalesce(*[F.when(F.col(by) == j, F.lit(float(max(0.0, r)))) for j, r in room.items()], F.lit(0.0))
    sums = rows.groupBy(by, "bucket").agg(F.sum("bytes").alias("bytes"))
    running = F.sum("bytes").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("__sum", running).where(F.col("__sum") <= space).groupBy(by).agg(F.max("bucket").alias("upto"))


def _loads(nodes: DataFrame, shards: int) -> dict[int, float]:
    found = {r["shard"]: float(r["bytes"]) for r in nodes.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    return {j: found.get(j, 0.0) for j in range(shards)}


def propagate(nodes: DataFrame, quota: float, shards: int = SHARDS, rounds: int = 4) -> DataFrame:
    """Move linked nodes (``text_key, o, b, bytes, shard``) to the shard where most of their group is.

    A group's links run through its text, so a round sums the group's bytes by shard and joins the
    fullest shard back; no pair of documents is formed.  A shard takes moves up to its quota: they come
    in hash order, all nodes of a group at once unless the group is a large part of a shard, and a
    histogram tells how far the room goes.
    """
    for _ in range(rounds):
        cells = nodes.groupBy("text_key", "shard").agg(F.sum("bytes").alias("bytes"))
        best = cells.groupBy("text_key").agg(
            F.max(F.struct("bytes", -F.col("shard"))).alias("m"), F.sum("bytes").alias("group_bytes")
        )
        best = best.select("text_key", (-F.col("m.col2")).alias("target"), "group_bytes")
        bucket = F.when(F.col("group_bytes") * 64 <= quota, _bucket(FINE, "text_key")).otherwise(_bucket(FINE, "text_key", "o", "b"))
        moves = stored(nodes.join(best, "text_key").withColumn("bucket", bucket), "shards-moves")
        load = _loads(nodes, shards)
        limits = _upto(moves.where("shard != target"), "target", {j: quota - v for j, v in load.items()})
        goes = (F.col("shard") != F.col("target")) & (F.col("bucket") <= F.coalesce("upto", F.lit(-1)))
        moved = moves.join(F.broadcast(limits), "target", "left")  # a row per shard
        nodes = stored(
            moved.select("text_key", "o", "b", "bytes", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard")),
            "shards-labels",
        )
    return nodes


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", rounds: int = 4) -> DataFrame:
    """Put documents into shards of near equal bytes, with equal texts together as far as that allows.

    Documents start in the shard of a hash of their id.  Those with an equal text move by label
    propagation; then documents without links (and what linked ones are over a shard's part) fill the
    shards evenly.  The law is ``bytes``: a size is the text's UTF-8 bytes and 1.  A group larger than a
    shard is spread over several.

    Columns: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  Null text has size 1 and the
    checksum of the empty text; rows of one id count separately and ids may be null; other columns are
    ignored; an empty table gives no rows.
    """
    body = whole_text(text).cast("binary")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.sha2(body, 256).alias("text_key"),
    )
    # A node is what of a group starts in one shard (o) and block (b); no node is large because its group is.
    rows = rows.withColumns({"o": _bucket(shards, "doc_id", "text_key"), "b": _bucket(BLOCKS, "doc_id")})
    rows = stored(rows, "shards-documents")
    nodes = rows.groupBy("text_key", "o", "b").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    nodes = stored(nodes, "shards-nodes")
    quota = float(nodes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) / shards
    linked = nodes.groupBy("text_key").agg(F.sum("n").alias("group_rows")).where("group_rows > 1").select("text_key")
    start = nodes.join(linked, "text_key").select("text_key", "o", "b", "bytes", F.col("o").alias("shard"))
    placed = propagate(stored(start, "shards-labels"), quota, shards, rounds)
    # Of linked nodes a shard keeps what fits; the rest goes with the unlinked ones.
    placed = stored(placed.withColumn("bucket", _bucket(FINE, "text_key", "o", "b")), "shards-placed")
    limits = _upto(placed, "shard", {j: quota for j in range(shards)})
    kept = stored(placed.join(F.broadcast(limits), "shard").where("bucket <= upto").select("text_key", "o", "b", "bytes", "shard"), "shards-kept")
    load = _loads(kept, shards)
    joined = nodes.join(kept.drop("bytes"), ["text_key", "o", "b"], "left")
    joined = stored(joined.withColumn("fill", _bucket(FILL, "text_key", "o", "b")).drop("n"), "shards-joined")
    sums = joined.where("shard is null").groupBy("fill").agg(F.sum("bytes").alias("bytes"))
    middle = F.sum("bytes").over(Window.orderBy("fill").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") / 2
    ends = list(accumulate(quota - load[j] for j in range(shards)))  # one number per shard
    shard_of = sum((F.when(middle > F.lit(end), 1).otherwise(0) for end in ends[:-1]), F.lit(0))
    filled = sums.select("fill", shard_of.alias("fill_shard"))
    # At most FILL rows of two numbers.
    labels = joined.join(F.broadcast(filled), "fill", "left").select(
        "text_key", "o", "b", F.coalesce("shard", "fill_shard").cast("int").alias("shard")
    )
    assigned = stored(rows.join(labels, ["text_key", "o", "b"]).drop("o", "b", "text_key"), "shards-assigned")
    return _with_slots(assigned)


def _with_slots(assigned: DataFrame) -> DataFrame:
    """Number the rows of each shard: blocks of a shard are numbered apart and put behind one another."""
    parts = 4 * shuffle_partitions(assigned.sparkSession)
    rows = assigned.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(11)), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    numbered = rows.withColumn("place", place).join(offsets, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
