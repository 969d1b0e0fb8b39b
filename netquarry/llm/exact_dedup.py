"""Exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import BATCH_ROWS, BLANKS, arrow_rows, keep_matching, shuffle_partitions, stored, whole_text

LEAD_BYTES = 32

_ROWS = (
    "doc_id long, n_chars int, text_sha256 string, pid int, run long, first boolean, "
    "keep_id long, keep_chars int, size long, head binary, tail binary"
)


def normalised(text: str = "text") -> Column:
    """The text without any white space, as bytes."""
    return F.translate(whole_text(text), BLANKS, "").cast("binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted partition.

    Every row gets the number of its run, the run's first row (which is the one to keep, by the sort
    order) and the run's size.  The text of the first run goes out in ``head`` and that of the last
    one in ``tail``, on the first row of either.  Only the open run is held back: its ids and digests.
    """
    pid = TaskContext.get().partitionId()
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_chars", pa.int32()), ("text_sha256", pa.string()),
            ("pid", pa.int32()), ("run", pa.int64()), ("first", pa.bool_()), ("keep_id", pa.int64()),
            ("keep_chars", pa.int32()), ("size", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()),
        ]
    )

    def out(ids, chars, shas, starts, first_run, texts, is_last):
        n = len(ids)
        sizes = np.diff(np.append(starts, n))
        run = np.repeat(np.arange(len(starts)), sizes)
        at = pa.array(starts[run])
        first = np.zeros(n, bool)
        first[starts] = True
        head, tail = [None] * n, [None] * n
        if first_run == 0:
            head[0] = texts[0]
        if is_last:
            tail[int(starts[-1])] = texts[-1]
        return pa.record_batch(
            [
                ids, chars, shas, pa.array(np.full(n, pid, np.int32)), pa.array(run + first_run),
                pa.array(first), ids.take(at), chars.take(at), pa.array(sizes[run].astype(np.int64)),
                pa.array(head, pa.binary()), pa.array(tail, pa.binary()),
            ],
            schema=schema,
        )

    open_rows, open_text, done, last_text = None, None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, chars, norm, sha = (batch.column(k) for k in ("doc_id", "n_chars", "norm", "text_sha256"))
        differs = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            differs[1:] = pc.not_equal(norm.slice(1), norm.slice(0, batch.num_rows - 1)).to_numpy(False)
        differs[0] = last_text is None or norm[0].as_py() != last_text
        last_text = norm[batch.num_rows - 1].as_py()
        held = 0
        if open_rows is not None:
            held = len(open_rows[0])
            ids, chars, sha = (pa.concat_arrays([a, b]) for a, b in zip(open_rows, (ids, chars, sha), strict=True))
        starts = np.flatnonzero(differs) + held
        if held:
            starts = np.append(0, starts)
        last = int(starts[-1])
        if last:
            # Only the text of the partition's first run goes out with these rows.
            text = open_text if held else norm[0].as_py()
            yield out(ids.slice(0, last), chars.slice(0, last), sha.slice(0, last), starts[:-1], done, [text], False)
            done += len(starts) - 1
        open_rows, open_text = [x.slice(last) for x in (ids, chars, sha)], last_text
    if open_rows is not None:
        yield out(*open_rows, np.array([0]), done, [open_text], True)


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None
) -> DataFrame:
    """One row per document with the row that stays of its group of equal texts.

    Texts are equal when they are identical after deletion of white space.  Of equal texts the one
    with the most code points of the original stays, then the smallest id; of rows that agree in
    both, any one.

    The normalised bytes are range-partitioned at sampled splitters and sorted, so that equal texts
    become neighbours, and neighbours are compared in full.  A splitter is the text's first bytes, its
    digest, its length and the id: bounded in size however long texts are, and fine enough to cut a
    group that holds a third of all rows.  A group that runs over a boundary is put together from one
    record per partition.

    Null or missing text is the empty text; all empty ones form a group.  A null id counts as larger
    than any other.  Rows with the same id count as separate rows.  Other columns are ignored.  An
    empty table gives no rows.  Columns: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    keyed = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.length(whole_text(text)).alias("n_chars"),
        normalised(text).alias("norm"),
    ).select("doc_id", "n_chars", "norm", F.sha2("norm", 256).alias("text_sha256"))
    lead, digest = F.substring("norm", 1, LEAD_BYTES), F.col("text_sha256")
    tail_order = [F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()]
    ordered = keyed.repartitionByRange(n, lead, digest, *tail_order).sortWithinPartitions(
        lead, digest, F.col("norm"), *tail_order
    )
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = stored(ordered.mapInArrow(_runs, _ROWS), "content-sort")
    return _across_boundaries(rows)


def _across_boundaries(rows: DataFrame) -> DataFrame:
    """Put runs together that go on in the next partition.

    Per partition there is one record of its first and its last run; the full texts of neighbouring
    partitions are compared in a join, and the chains follow from one flag per partition.
    """
    edges = rows.where(F.col("head").isNotNull() | F.col("tail").isNotNull())
    parts = edges.groupBy("pid").agg(
        F.max("head").alias("head"), F.max("tail").alias("tail"), F.max("run").alias("last_run")
    )
    order = Window.orderBy("pid")  # a row per partition
    before = parts.select("pid").withColumn("before", F.lag("pid").over(order))
    left = parts.select(F.col("pid").alias("before"), F.col("tail").alias("tail_before"))
    linked = (
        parts.join(before, "pid")
        .join(left, "before", "left")
        .select("pid", "last_run", F.coalesce(F.col("head") == F.col("tail_before"), F.lit(False)).alias("goes_on"))
    )
    through = F.col("goes_on") & (F.col("last_run") == 0)
    origin = F.last(F.when(~through, F.struct("pid", "last_run")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    chains = linked.withColumn("origin", origin)
    first = chains.where("goes_on").select(
        "pid", F.lit(0).cast("long").alias("run"), F.col("origin.pid").alias("from_pid"),
        F.col("origin.last_run").alias("from_run"),
    )
    heads = first.select(F.col("from_pid").alias("pid"), F.col("from_run").alias("run")).distinct()
    members = first.unionByName(
        heads.select("pid", "run", F.col("pid").alias("from_pid"), F.col("run").alias("from_run"))
    )
    measured = members.join(edges.select("pid", "run", "keep_id", "keep_chars", "size"), ["pid", "run"])
    whole = measured.groupBy("from_pid", "from_run").agg(
        F.sum("size").alias("whole_size"),
        F.max(F.when((F.col("pid") == F.col("from_pid")) & (F.col("run") == F.col("from_run")), F.col("keep_id"))).alias("whole_keep"),
    )
    fixes = members.join(whole, ["from_pid", "from_run"]).select(
        "pid", "run", "whole_size", "whole_keep",
        ((F.col("pid") == F.col("from_pid")) & (F.col("run") == F.col("from_run"))).alias("is_head"),
        F.lit(True).alias("fixed"),
    )
    fixes = stored(fixes, "content-sort-boundaries")
    # At most two runs per partition are fixed, so this side is bounded by the number of partitions.
    joined = rows.drop("head", "tail").join(F.broadcast(fixes), ["pid", "run"], "left")
    fixed = F.coalesce(F.col("fixed"), F.lit(False))
    return joined.select(
        "doc_id",
        F.when(fixed, F.col("whole_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(fixed, F.col("whole_size")).otherwise(F.col("size")).alias("group_size"),
        (F.col("first") & (~fixed | F.coalesce(F.col("is_head"), F.lit(False)))).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of fully repeated rows one stays."""
    kept = exact_duplicates(docs, doc_id, text).where("kept")
    keys = {
        "doc_id": F.col(f"`{doc_id}`").cast("long"),
        "text_sha256": F.sha2(normalised(text), 256),
        "n_chars": F.length(whole_text(text)),
    }
    marked = docs.withColumns({f"__key_{name}": value for name, value in keys.items()})
    own = {name: F.col(f"__key_{name}") for name in keys}
    found = keep_matching(marked, own, kept)
    return found.dropDuplicates([f"__key_{name}" for name in keys]).select(*[F.col(f"`{c}`") for c in docs.columns])
