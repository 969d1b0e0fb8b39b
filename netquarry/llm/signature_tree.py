"""N-gram Jaccard join with signature trees.

Documents that may be linked share one of their rarest shingles, so every such shingle is the root of
a tree.  Below the roots all trees share the same two levels: leaves of some documents that lie next to
each other in the order of their widest keys, and nodes of some leaves.  Leaves and nodes hold the
OR-combined bitmap of their shingles and the range of their set sizes.  A pair of nodes is traversed
together, and left as soon as the largest possible overlap is too small for a link, or as all of both
lies in one component already.  What remains at the leaves is compared on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netquarry.llm.common import BATCH_ROWS, arrow_rows, shuffle_partitions, stored, tasks_for, whole_text
from netquarry.llm.shingles import SHINGLE_WORDS, Shingles, connected_components
from netquarry.operators.filters import probable_members

LEAST_PERCENT = 80
# Linked sets share this percentage of the smaller one among their rarest shingles, which are as many more.
MORE_PERCENT = 5
# Counters of shingles by the high bits of their hash, sent about in pieces.
COUNTER_BITS, PIECE_BITS = 20, 12
# The summed counters (8 MB) come to the driver in so many parts, each by a job of its own.
COUNTER_PARTS = 4
# A leaf has this many documents and, unless it is a single one, this many shingles at most.
LEAF_DOCUMENTS, LEAF_SHINGLES = 32, 1 << 17
FANOUT_BITS = 5
# Rows sent to Python at once are fewer where a row holds the sets of one or two leaves, which may be 1 MB each.
LEAF_ROWS = 16
# Worth a task of their own: so many members, documents (by their hubs' bitmaps), rows of keys that two nodes share,
# and pairs of leaves.
MEMBERS_PER_TASK, DOCUMENTS_PER_TASK, KEYS_PER_TASK, PAIRS_PER_TASK = 5000, 2000, 100, 50
SIGNATURE_BITS = 14

Batches = Iterator[pa.RecordBatch]
# Which pairs of two lists of packed signatures may be linked.
Likely = Callable[[list[list[int]], list[list[int]]], np.ndarray]

_TREE = (
    "leaf long, node long, reps array<long>, components array<long>, sizes array<long>, widest array<long>, "
    "sets array<binary>, planes array<array<long>>, bits binary, low long, high long, slack long, one long, "
    "node_bits binary, node_low long, node_high long, node_slack long, node_one long"
)
_SETS = "rep long, size long, widest long, central long, shingles binary"


def _rows(batches: Batches) -> Iterator[dict]:
    """Rows one by one, so that Python holds one of them beside the batch."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


# ---- which shingles are rare ------------------------------------------------------------------


def _counts(batches: Batches) -> Batches:
    """Counters of the shingles of one task, in pieces."""
    sets, table = Shingles(SHINGLE_WORDS), np.zeros(1 << COUNTER_BITS, np.int64)
    held, n = [], 0
    for batch in batches:
        for text in batch.column("text"):
            held.append((sets.all_of(text.as_py()) >> np.uint64(64 - COUNTER_BITS)).astype(np.int32))
            n += len(held[-1])
            if n >= len(table):
                table += np.bincount(np.concatenate(held), minlength=len(table))
                held, n = [], 0
    if held:
        table += np.bincount(np.concatenate(held), minlength=len(table))
    pieces = table.reshape(-1, 1 << PIECE_BITS)
    used = np.flatnonzero(pieces.any(axis=1))
    yield pa.record_batch(
        [pa.array(used, pa.int32()), pa.array([pieces[k].astype(np.uint32).tobytes() for k in used], pa.binary())],
        names=["piece", "counts"],
    )


def _summed(batches: Batches) -> Batches:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counted = np.frombuffer(counts, np.uint32).astype(np.int64)
            found[piece] = found[piece] + counted if piece in found else counted
    yield pa.record_batch(
        [pa.array(list(found), pa.int32()), pa.array([c.tobytes() for c in found.values()], pa.binary())],
        names=["piece", "counts"],
    )


def shingle_ranks(rows: DataFrame) -> np.ndarray:
    """A rank per counter, small for rare shingles.

    All documents are counted.  The table has a fixed size, whatever the corpus; shingles that share a
    counter share its rank, and any order is a right one for prefixes, so that costs time only.
    """
    summed = rows.select("text").mapInArrow(_counts, "piece int, counts binary").repartition("piece")
    table = np.zeros((1 << (COUNTER_BITS - PIECE_BITS), 1 << PIECE_BITS), np.int64)
    for row in summed.mapInArrow(_summed, "piece int, counts binary").repartition(COUNTER_PARTS).toLocalIterator():
        table[row["piece"]] = np.frombuffer(row["counts"], np.int64)
    return (16 * np.log2(1 + table.ravel())).astype(np.uint16)


def ceil_percent(n: int, percent: int) -> int:
    return -(n * percent // -100)


def _prefixes(ranks: np.ndarray, percent: int) -> Callable[[Batches], Batches]:
    """The set size of each document, a digest of its set and its rarest shingles.

    Of two linked sets, either shares at least ``percent`` of its shingles with the other, so the first
    ``n - ceil(percent * n) + k`` of both in one common order have ``k`` in common; where ``k`` goes by the
    size, that of the smaller set.
    """

    def run(batches: Batches) -> Batches:
        import xxhash

        sets = Shingles(SHINGLE_WORDS)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column("text"):
                found = sets.of(text.as_py())
                n = len(found)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                first = n - ceil_percent(n, percent) + max(1, ceil_percent(n, MORE_PERCENT))
                # The set is sorted, so equal ranks stay in the order of the hashes.
                order = np.argsort(ranks[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")
                keys.append(found[order[:first]].view(np.int64) if n else None)
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )

    return run


# ---- trees ------------------------------------------------------------------------------------


def _full_sets(batches: Batches) -> Batches:
    sets = Shingles(SHINGLE_WORDS)
    for batch in batches:
        found = [sets.of(text.as_py()) for text in batch.column("text")]
        yield pa.record_batch(
            [
                batch.column("rep"), pa.array([len(s) for s in found], pa.int64()), batch.column("widest"),
                batch.column("central"), pa.array([s.tobytes() for s in found], pa.binary()),
            ],
            names=["rep", "size", "widest", "central", "shingles"],
        )


def full_sets(members: DataFrame, rows: DataFrame) -> DataFrame:
    """``rep, size, widest, central, shingles`` of the documents in ``members`` (``key, rep, n``, stored).

    ``widest`` is the key that most documents share with this one, ``central`` counts all that share
    one: the text that others were copied from has the largest.  Most texts have no member and are not shuffled.
    """
    rows = probable_members(rows, F.col("doc_id"), members.select("rep"))
    about = members.groupBy("rep").agg(F.max(F.struct("n", "key")).alias("top"), F.sum("n").alias("central"))
    about = about.select("rep", F.col("top.key").alias("widest"), "central")
    tasks = tasks_for(rows.sparkSession, members.count(), MEMBERS_PER_TASK)
    return rows.join(about, rows["doc_id"] == about["rep"]).coalesce(tasks).mapInArrow(_full_sets, _SETS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of a set, as bytes."""
    marked = np.zeros(1 << SIGNATURE_BITS, bool)
    marked[(shingles >> np.uint64(64 - SIGNATURE_BITS)).astype(np.int64)] = True
    return np.packbits(marked)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of some sets as 64-bit words, and the numbers of their bits."""
    words = np.stack([signature(s) for s in sets]).view(np.uint64)
    return words, np.bitwise_count(words).sum(axis=1).astype(np.int64)


def _deal(batches: Batches) -> Batches:
    """Leaves of neighbouring documents of one sorted partition, and nodes of neighbouring leaves.

    The first leaf of a node carries the node's summary.
    """
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    schema = pa.schema(
        [
            ("leaf", pa.int64()), ("node", pa.int64()), ("reps", pa.list_(pa.int64())),
            ("components", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("widest", pa.list_(pa.int64())),
            ("sets", pa.list_(pa.binary())), ("planes", pa.list_(pa.list_(pa.int64()))), ("bits", pa.binary()), ("low", pa.int64()), ("high", pa.int64()),
            ("slack", pa.int64()), ("one", pa.int64()), ("node_bits", pa.binary()), ("node_low", pa.int64()),
            ("node_high", pa.int64()), ("node_slack", pa.int64()), ("node_one", pa.int64()),
        ]
    )

    def leaf_of(docs: list[dict], number: int) -> dict:
        words, counts = _signatures([np.frombuffer(d["shingles"], np.uint64) for d in docs])
        sizes = [d["size"] for d in docs]
        components = {d["component"] for d in docs}
        return {
            "leaf": first + number, "node": (first + number) >> FANOUT_BITS, "reps": [d["rep"] for d in docs],
            "components": [d["component"] for d in docs], "sizes": sizes, "widest": [d["widest"] for d in docs],
            "sets": [d["shingles"] for d in docs], "planes": [d.get("planes") for d in docs], "bits": np.bitwise_or.reduce(words, axis=0).tobytes(),
            "low": min(sizes), "high": max(sizes), "slack": int((np.array(sizes) - counts).max()),
            "one": components.pop() if len(components) == 1 else None,
        }

    def node_of(leaves: list[dict]) -> pa.RecordBatch:
        merged = np.bitwise_or.reduce([np.frombuffer(x["bits"], np.uint64) for x in leaves], axis=0)
        ones = {x["one"] for x in leaves}
        leaves[0] |= {
            "node_bits": merged.tobytes(), "node_low": min(x["low"] for x in leaves),
            "node_high": max(x["high"] for x in leaves), "node_slack": max(x["slack"] for x in leaves),
            "node_one": ones.pop() if len(ones) == 1 else None,
        }
        return pa.RecordBatch.from_pylist(leaves, schema)

    docs: list[dict] = []
    leaves: list[dict] = []
    shingles = done = 0
    for doc in _rows(batches):
        if docs and (len(docs) == LEAF_DOCUMENTS or shingles + doc["size"] > LEAF_SHINGLES):
            leaves.append(leaf_of(docs, done))
            docs, shingles, done = [], 0, done + 1
            if done % (1 << FANOUT_BITS) == 0:
                yield node_of(leaves)
                leaves = []
        docs.append(doc)
        shingles += doc["size"]
    if docs:
        leaves.append(leaf_of(docs, done))
    if leaves:
        yield node_of(leaves)


def _tree(sets: DataFrame, labels: DataFrame | None, purpose: str) -> DataFrame:
    if labels is None:
        named = sets.withColumn("component", F.col("rep"))
    else:
        named = sets.join(labels, sets["rep"] == labels["node"], "left")
        named = named.withColumn("component", F.coalesce("component", "rep")).drop("node")
    # Without labels every document is its own component: then the most central ones come first.
    inner = ["component"] if labels is not None else []
    order = [F.col("widest"), *[F.col(c) for c in inner], F.desc("central"), F.col("rep")]
    parts = shuffle_partitions(sets.sparkSession)
    ranged = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # No more parts than there are whole nodes, so that nodes are full: neighbouring parts go together.
    nodes = -(-sets.count() // (LEAF_DOCUMENTS << FANOUT_BITS))
    return stored(ranged.coalesce(max(1, min(parts, nodes))).mapInArrow(_deal, _TREE), purpose)


# ---- dual traversal ---------------------------------------------------------------------------


def least_shared(size: Column, percent: int) -> Column:
    """How many of the rarest shingles a set of that size shares with any set that it is linked with.

    The smaller of both has ``percent`` of the size at least.
    """
    return F.greatest(F.lit(1), F.ceil(size * (percent * MORE_PERCENT) / 10_000)).cast("long")


def _too_far(percent: int) -> Column:
    """Whether the size ranges of ``a`` and ``b`` rule a link out."""
    return (100 * F.col("high_a") < percent * F.col("low_b")) | (100 * F.col("high_b") < percent * F.col("low_a"))


def _overlapping(percent: int, columns: list[str]) -> Callable[[Batches], Batches]:
    """Pairs whose bitmaps leave room for a link.

    A set of size ``s`` with ``p`` bits of its own has ``p`` shingles of different bits; those outside the
    common bits ``c`` are no common shingles.  So no set of the node has more than ``s - p + c`` of them,
    and a link needs ``percent`` of the larger set.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            get = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("low_a", "low_b", "slack_a", "slack_b")}
            common = np.fromiter(
                (
                    int(np.bitwise_count(np.frombuffer(a, np.uint64) & np.frombuffer(b, np.uint64)).sum())
                    for a, b in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)
                ),
                np.int64,
                batch.num_rows,
            )
            most = np.minimum(get["slack_a"], get["slack_b"]) + common
            room = 100 * most >= percent * np.maximum(get["low_a"], get["low_b"])
            yield batch.select(columns).filter(pa.array(room, pa.bool_()))

    return run


def _leaf_pairs(batches: Batches) -> Batches:
    """Leaves of two nodes that share keys, and how many.  A leaf is not paired with itself."""
    bits = np.arange(1 << FANOUT_BITS)
    for batch in batches:
        found: list[np.ndarray] = []
        for a, b, held in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "held")), strict=True):
            left, right, keys = (np.array([h[k] for h in held], np.int64) for k in ("leaves_a", "leaves_b", "keys"))
            has_a, has_b = (left[:, None] >> bits) & 1, (right[:, None] >> bits) & 1
            shared = (has_a * keys[:, None]).T @ has_b
            if a == b:
                shared = np.triu(shared, 1)
            x, y = np.nonzero(shared)
            found.append(np.stack([(a << FANOUT_BITS) | x, (b << FANOUT_BITS) | y, shared[x, y]]))
        rows = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        yield pa.record_batch([pa.array(r) for r in rows], names=["a", "b", "count"])


def _surviving(pairs: DataFrame, summaries: DataFrame, percent: int, tasks: int, *others: str) -> DataFrame:
    """Those of the pairs ``a, b`` of tree nodes that may hold a link between components.

    At most ``tasks`` tasks compare bitmaps.  ``others`` are further columns of the summaries that stay, as ``<name>_a`` and ``<name>_b``.
    """

    def side(name: str) -> DataFrame:
        return summaries.select(*[F.col(c).alias(f"{c}_{name}") for c in summaries.columns]).withColumnRenamed(
            f"id_{name}", name
        )

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    connected = F.coalesce(F.col("one_a") == F.col("one_b"), F.lit(False))
    both = both.where(~_too_far(percent) & ~connected)
    columns = ["a", "b", *[f"{c}_{s}" for c in others for s in "ab"]]
    return both.coalesce(tasks).mapInArrow(_overlapping(percent, columns), ", ".join(f"{c} long" for c in columns))


_HELD = ["reps", "components", "sizes", "sets", "planes"]


def _links(percent: int, likely: Likely | None) -> Callable[[Batches], Batches]:
    """Links between the documents of two leaves, as many as join their components."""

    def run(batches: Batches) -> Batches:
        for row in _rows(batches):
            yield _compare(row, percent, likely)

    return run


def _compare(row: dict, percent: int, likely: Likely | None) -> pa.RecordBatch:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    sides = []
    for s in "ab":
        sets = [np.frombuffer(x, np.uint64) for x in row[f"sets_{s}"]]
        sides.append((row[f"reps_{s}"], row[f"components_{s}"], np.array(row[f"sizes_{s}"]), sets, *_signatures(sets)))
    (reps_a, of_a, size_a, sets_a, words_a, count_a), (reps_b, of_b, size_b, sets_b, words_b, count_b) = sides
    common = np.stack([np.bitwise_count(w & words_b).sum(axis=1) for w in words_a]).astype(np.int64)
    most = np.minimum((size_a - count_a)[:, None], (size_b - count_b)[None, :]) + common
    wanted = percent * (size_a[:, None] + size_b[None, :])
    possible = (100 + percent) * most >= wanted
    if likely is not None:
        possible &= likely(row["planes_a"], row["planes_b"])
    if row["a"] == row["b"]:
        possible &= np.triu(np.ones_like(possible), 1)
    at_a, at_b = np.nonzero(possible)
    order = np.argsort(-(most[at_a, at_b] / wanted[at_a, at_b]), kind="stable")
    found: list[tuple[int, int]] = []
    for i, j in zip(at_a[order].tolist(), at_b[order].tolist(), strict=True):
        x, y = root(of_a[i]), root(of_b[j])
        if x == y:
            continue
        both = len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True))
        if (100 + percent) * both >= wanted[i, j]:
            parent[max(x, y)] = min(x, y)
            found.append((reps_a[i], reps_b[j]))
    return pa.record_batch(
        [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
    )


def _alone(percent: int, likely: Likely | None) -> Callable[[Batches], Batches]:
    """Links within each leaf."""

    def run(batches: Batches) -> Batches:
        for row in _rows(batches):
            if len(row["reps"]) > 1 and row["one"] is None:
                yield _compare({"a": 0, "b": 0} | {f"{c}_{s}": row[c] for c in _HELD for s in "ab"}, percent, likely)

    return run


def _surviving_leaves(pairs: DataFrame, tree: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Those of the leaf pairs that may hold a link, ``a`` being the leaf with fewer shingles."""
    weight = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, size: total + size)
    summaries = tree.select(F.col("leaf").alias("id"), "bits", "low", "high", "slack", "one", weight.alias("weight"))
    kept = _surviving(pairs.where("a != b"), summaries, percent, tasks, "weight")
    of = [F.struct(F.col(f"weight_{s}").alias("weight"), F.col(s).alias("leaf")) for s in "ab"]
    return kept.select(F.least(*of)["leaf"].alias("a"), F.greatest(*of)["leaf"].alias("b"))


def _linked_leaves(pairs: DataFrame, tree: DataFrame, percent: int, likely: Likely | None, purpose: str) -> DataFrame:
    """Links within leaves and between the leaves of the pairs; only the latter are shuffled.

    The sets of ``a`` are sent once for every pair.
    """
    within = tree.select("one", *_HELD).mapInArrow(_alone(percent, likely), "a long, b long")
    pairs = stored(pairs, f"{purpose}-pairs")
    # A join that was split for the sets leaves many tasks with a few pairs, each with a start of Python and a file.
    tasks = tasks_for(tree.sparkSession, pairs.count(), PAIRS_PER_TASK)
    side_a, side_b = (
        tree.select(F.col("leaf").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in _HELD]).join(
            pairs.select(s).distinct(), s, "left_semi"
        )
        for s in "ab"
    )
    both = pairs.join(side_a, "a").join(side_b, "b").coalesce(tasks)
    between = both.mapInArrow(_links(percent, likely), "a long, b long")
    with arrow_rows(tree.sparkSession, LEAF_ROWS):
        return stored(within.union(between), purpose)


def first_links(sets: DataFrame, percent: int, likely: Likely | None = None) -> DataFrame:
    """Links within each leaf, and between it and the first leaf of its documents' widest keys.

    A number of leaf pairs linear in the documents, which joins most of every group of near copies: the
    first leaf of a key holds the documents that share most with others.
    """
    tree = _tree(sets, None, "tree-first")
    homes = tree.select(F.col("leaf").alias("b"), F.explode("widest").alias("widest")).distinct()
    hubs = homes.groupBy("widest").agg(F.min("b").alias("a"))
    pairs = homes.join(hubs, "widest").where("a != b").select("a", "b").distinct()
    tasks = tasks_for(sets.sparkSession, sets.count(), DOCUMENTS_PER_TASK)
    return _linked_leaves(_surviving_leaves(pairs, tree, percent, tasks), tree, percent, likely, "tree-first-links")


def remaining_links(
    members: DataFrame,
    sets: DataFrame,
    labels: DataFrame,
    percent: int,
    shared: Column | None = None,
    likely: Likely | None = None,
) -> DataFrame:
    """Links between documents that share a key (``members``: ``key, rep``) but lie in different components.

    ``shared`` tells, by the larger least set size ``low`` of two leaves, how many keys a link needs;
    ``likely`` which pairs may be linked at all, by the packed signatures of ``sets``.

    Exact: a pair is left out only where sizes or bitmaps rule a link out, or where both documents are
    in one component.
    """
    named = members.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    named = named.select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    live = stored(named.join(mixed.where("least != most").select("key"), "key", "left_semi"), "tree-live")
    # Documents that share too few keys with other components are through.
    few = live.groupBy("rep").agg(F.count("*").alias("count")).join(sets.select("rep", F.col("size").alias("low")), "rep")
    few = few.where(F.col("count") >= (F.lit(1) if shared is None else shared)).select("rep").distinct()
    tree = _tree(sets.join(few, "rep", "left_semi"), labels, "tree-rest")
    places = tree.select("leaf", "node", F.explode(F.arrays_zip("reps", "sizes")).alias("d")).select(
        "leaf", "node", F.col("d.reps").alias("rep"), F.col("d.sizes").alias("size")
    )
    held = live.join(places, "rep")
    low, high = F.min("component").alias("from"), F.max("component").alias("to")
    # The leaves of a node that hold a key, as bits.
    leaf = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("leaf").bitwiseAND((1 << FANOUT_BITS) - 1).cast("int"))
    by_node = stored(
        held.groupBy("key", "node").agg(
            F.bit_or(leaf).alias("leaves"), low, high, F.min("size").alias("low"), F.max("size").alias("high")
        ),
        "tree-keys",
    )
    mixed = by_node.groupBy("key").agg(F.min("from").alias("least"), F.max("to").alias("most")).where("least != most")
    by_node = by_node.join(mixed.select("key"), "key", "left_semi")

    def side(s: str) -> DataFrame:
        return by_node.select("key", *[F.col(c).alias(f"{c}_{s}") for c in by_node.columns if c != "key"])

    split = (F.least("from_a", "from_b") != F.greatest("to_a", "to_b")) & ~_too_far(percent)
    met = side("a").join(side("b"), "key").where((F.col("node_a") <= F.col("node_b")) & split)
    met = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "leaves_a", "leaves_b")
    nodes = tree.where("node_bits is not null").select(
        F.col("node").alias("id"), F.col("node_bits").alias("bits"), F.col("node_low").alias("low"),
        F.col("node_high").alias("high"), F.col("node_slack").alias("slack"), F.col("node_one").alias("one"),
    )
    # Keys by node pair and leaves; the leaves of two nodes are paired where all their keys are together.
    met = stored(met.groupBy("a", "b", "leaves_a", "leaves_b").agg(F.count("*").alias("keys")), "tree-node-pairs")
    tasks = tasks_for(sets.sparkSession, met.count(), KEYS_PER_TASK)
    kept = _surviving(met.select("a", "b").distinct(), nodes, percent, tasks)
    keys = met.join(kept, ["a", "b"]).groupBy("a", "b").agg(F.collect_list(F.struct("leaves_a", "leaves_b", "keys")).alias("held"))
    counted = keys.coalesce(tasks).mapInArrow(_leaf_pairs, "a long, b long, count long")
    lows = tree.select(F.col("leaf"), "low")
    sized = (
        counted.join(lows.select(F.col("leaf").alias("a"), F.col("low").alias("low_a")), "a")
        .join(lows.select(F.col("leaf").alias("b"), F.col("low").alias("low_b")), "b")
        .withColumn("low", F.greatest("low_a", "low_b"))
    )
    pairs = sized.where(F.col("count") >= (F.lit(1) if shared is None else shared)).select("a", "b")
    return _linked_leaves(_surviving_leaves(pairs, tree, percent, tasks), tree, percent, likely, "tree-rest-links")


# ---- the join ---------------------------------------------------------------------------------


def _labelled(docs: DataFrame, doc_id: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of the documents, and the components of those that are linked."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    ranks = shingle_ranks(rows)
    schema = "doc_id long, n_shingles long, digest binary, keys array<long>"
    sketches = stored(rows.mapInArrow(_prefixes(ranks, percent), schema), "tree-sketches")
    # The row of the smallest id stands for all rows of its set.
    least = F.min_by(F.struct("n_shingles", "keys"), "doc_id")
    chosen = sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), least.alias("of")
    )
    keyed = chosen.select("rep", F.col("of.n_shingles").alias("size"), F.explode("of.keys").alias("key"))
    # Keys are counted where they lie: one shuffle, and the texts of a digest are chosen once.
    counted = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    met = stored(counted.where("n > 1"), "tree-met")
    # A document that shares too few of its rarest shingles, with whomever, is linked with nothing.
    # Of texts with one id the shortest decides, which lets through no fewer.
    enough = met.groupBy("rep").agg(F.count("*").alias("shared"), F.min("size").alias("size"))
    enough = enough.where(F.col("shared") >= least_shared(F.col("size"), percent)).select("rep")
    members = stored(met.join(enough, "rep", "left_semi").select("key", "rep", "n"), "tree-members")
    sets = stored(full_sets(members, rows), "tree-sets")
    links = first_links(sets, percent)
    labels = connected_components(links)
    rest = remaining_links(members, sets, labels, percent, least_shared(F.col("low"), percent))
    if rest.limit(1).count():
        labels = connected_components(links.union(rest))
    return sketches, labels


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = LEAST_PERCENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row per document.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles is at least
    ``percent``; a component is all that links reach, and its id is the smallest in it.  Equal sets are one
    class, represented by the smallest id.  The result is exact.

    A text of fewer words is one shingle; null text or one without words has no shingles and is linked
    with nothing.  Rows of one id count as one document where links are followed, but each gets its row
    and count.  A class of null ids only is linked with nothing and has no component.  Other columns are
    ignored, an empty table gives no rows.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        sketches, labels = _labelled(docs, doc_id, text, percent)
    classes = sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classed = sketches.drop("keys").join(classes, "digest", "left").drop("digest")
    return classed.join(labels, classed["rep"] == labels["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")
    )
