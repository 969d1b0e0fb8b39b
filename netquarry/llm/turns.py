"""Conversation structure repair with a rank-convergence parallel Viterbi search.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``.  The cheapest edits to get
there are a shortest path over (row, state of that pattern).  Conversations are cut into chunks that are
searched at the same time, backwards, each from a guess of the costs behind it.  Where the guess turns out
wrong by more than a constant the chunk is searched again from the vector that its successor has found;
that ends after very few turns, since four states soon forget where they came from.  A second pass goes
forwards and takes the least edit that keeps to the cheapest costs; each chunk does so for all four
states it may be entered in, and the chunks are then chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import BLANKS, shuffle_partitions, stored

# What edits cost, and what a truncated row costs that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# The row that may come next by state, and the state behind it.
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
BEHIND = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# Costs at the end of a conversation by state: what is still to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
CHUNK_BITS = 10
LEAD = 64

Batches = Iterator[pa.RecordBatch]


def _filled(name: str) -> Column:
    """The column as text, one space where it is null."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))


def damage(rows: DataFrame, every: int = 20) -> DataFrame:
    """``conv_id, turn, role, text, copy``: the rows after the damage that their crc32 asks for.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 makes it a
    user row.  Null role and text become one space, and so do null ids and turns in the checksum.
    """
    kind = F.pmod(F.crc32(F.concat_ws(":", _filled("conv_id"), _filled("turn")).cast("binary")), F.lit(every))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(_filled("text"), ".!?", "")).otherwise(_filled("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select(
        F.col("`conv_id`").alias("conv_id"),
        F.col("`turn`").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(_filled("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``position``, which grows along a conversation.

    Rows are range-partitioned on all that orders them, so a conversation that holds a third of all rows
    is dealt to many tasks; positions are numbers of the partition and of the row in it.
    """
    # Texts may be long, so the bounds of the ranges hold their beginnings only.
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.substring("text", 1, LEAD).asc()]
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order)
    sorted_rows = ranged.sortWithinPartitions(*order, F.asc("text"), F.asc("copy"))
    return stored(sorted_rows.withColumn("position", F.monotonically_increasing_id()), "turns-ordered")


def with_faults(ordered: DataFrame) -> DataFrame:
    """Rows with ``fault``: ``blank``, ``duplicate``, ``truncated`` or null, the first that applies."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    marked = ordered.withColumn("said", F.sha2(F.concat_ws("\n", "role", "text"), 256)).withColumn(
        "blank", F.translate("text", BLANKS, "") == ""
    )
    first = marked.groupBy("conv_id", "said").agg(F.min("position").alias("first"))
    first = first.select(F.col("conv_id").alias("of"), F.col("said").alias("same"), "first")
    seen = marked.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("same")))
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("position") > F.col("first"), "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return seen.select("conv_id", "turn", "role", "text", "position", fault.alias("fault"))


# ---- one chunk --------------------------------------------------------------------------------


def _row_edits(initial: str, fault: str | None, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state behind) of the edits of one row, least letter first."""
    found = [("D", DELETE, state)]
    if fault in ("blank", "duplicate"):
        return found
    more = TRUNCATED if fault == "truncated" else 0
    if state == START and initial == "s":
        found.append(("K", KEEP + more, SYSTEM))
    elif initial == NEXT_ROLE[state][0]:
        found.append(("K", KEEP + more, BEHIND[state]))
    found.append(("R", REROLE + more, BEHIND[state]))
    return found


def _inserted(costs: list[int]) -> list[int]:
    """Costs by state where rows may be inserted first."""
    for _ in range(STATES - 1):
        costs = [min(c, INSERT + costs[BEHIND[s]]) for s, c in enumerate(costs)]
    return costs


def backwards(kinds: list[tuple[str, str | None]], behind: list[int]) -> list[list[int]]:
    """Costs to the end by state before each row, and behind the last one, from the costs ``behind``."""
    costs = [list(behind)]
    for initial, fault in reversed(kinds):
        after = costs[-1]
        costs.append(_inserted([min(c + after[t] for _, c, t in _row_edits(initial, fault, s)) for s in range(STATES)]))
    return costs[::-1]


def relative(costs: list[int]) -> list[int]:
    least = min(costs)
    return [c - least for c in costs]


def search(kinds: list[tuple[str, str | None]], behind: list[int], found: list[list[int]] | None) -> list[list[int]]:
    """Costs of a chunk from a new vector behind it; ends as soon as only a constant has changed."""
    if found is None:
        return backwards(kinds, behind)
    costs = list(found)
    costs[-1] = list(behind)
    for i in range(len(kinds) - 1, -1, -1):
        after = costs[i + 1]
        new = _inserted([min(c + after[t] for _, c, t in _row_edits(*kinds[i], s)) for s in range(STATES)])
        shift = new[0] - costs[i][0]
        if all(n - c == shift for n, c in zip(new, costs[i], strict=True)):
            costs[: i + 1] = [[c + shift for c in row] for row in costs[: i + 1]]
            break
        costs[i] = new
    return costs


def forwards(kinds: list[tuple[str, str | None]], costs: list[list[int]], state: int, last: bool) -> tuple[list[str], int, int]:
    """Letters before and on each row (and behind the last one), cost and state of the least cheapest edits."""
    letters, total = [], 0
    for (initial, fault), now, after in zip(kinds, costs[:-1], costs[1:], strict=True):
        here = ""
        while True:
            choices = _row_edits(initial, fault, state)
            tight = [x for x in choices if x[1] + after[x[2]] == now[state]]
            # D comes before I, which comes before the others.
            if tight and tight[0][0] == "D":
                step = tight[0]
            elif INSERT + now[BEHIND[state]] == now[state]:
                here, total, state = here + "I", total + INSERT, BEHIND[state]
                continue
            else:
                step = tight[0]
            break
        letters.append(here + step[0])
        total, state = total + step[1], step[2]
    if last:
        end = ""
        while END[state] > 0:
            end, total, state = end + "I", total + INSERT, BEHIND[state]
        letters.append(end)
    return letters, total, state


def _kinds(row: dict) -> list[tuple[str, str | None]]:
    return list(zip(row["initials"], row["faults"], strict=True))


_CHUNK = "id long, next long, behind array<long>, before array<long>, changed boolean, costs array<array<long>>"


def _searched(batches: Batches) -> Batches:
    schema = pa.schema(
        [
            ("id", pa.int64()), ("next", pa.int64()), ("behind", pa.list_(pa.int64())), ("before", pa.list_(pa.int64())),
            ("changed", pa.bool_()), ("costs", pa.list_(pa.list_(pa.int64()))),
        ]
    )
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            behind = relative(row["given"])
            changed = row["costs"] is None or behind != row["behind"]
            costs = search(_kinds(row), behind, row["costs"]) if changed else row["costs"]
            before = relative(costs[0])
            out.append(
                {"id": row["id"], "next": row["next"], "behind": behind, "before": before, "changed": changed, "costs": costs}
            )
        yield pa.RecordBatch.from_pylist(out, schema)


def _traced(batches: Batches) -> Batches:
    """The four traces of each chunk."""
    schema = pa.schema([("id", pa.int64()), ("exits", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            exits = [forwards(_kinds(row), row["costs"], s, False)[2] for s in range(STATES)]
            out.append({"id": row["id"], "exits": exits})
        yield pa.RecordBatch.from_pylist(out, schema)


def _repaired(batches: Batches) -> Batches:
    """The edits of each chunk from the state it is entered in, and the lines that they leave."""
    schema = pa.schema([("conv_id", pa.int64()), ("id", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("lines", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            state, lines = row["entry"], []
            letters, cost, _ = forwards(_kinds(row), row["costs"], state, row["next"] is None)
            said = list(zip(row["roles"], row["texts"], strict=True)) + [None]
            for one, on in zip(letters, said, strict=False):
                for letter in one:
                    if letter == "D":
                        continue
                    if letter == "K" and state == START and on[0][:1] == "s":
                        state = SYSTEM
                        lines.append(f"{on[0]}:{on[1]}")
                        continue
                    role = on[0] if letter == "K" else NEXT_ROLE[state]
                    lines.append(f"{role}:" + ("" if letter == "I" else on[1]))
                    state = BEHIND[state]
            joined = "".join(f"{line}\n" for line in lines)
            out.append({"conv_id": row["conv_id"], "id": row["id"], "audit": "".join(letters), "cost": cost, "lines": joined})
        yield pa.RecordBatch.from_pylist(out, schema)


def _digested(batches: Batches) -> Batches:
    """One row per conversation from its chunks in order, which stream by: only the open digest is held."""
    schema = pa.schema([("of", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    class Open:
        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.cost, self.audit, self.digest, self.rest = conv_id, 0, [], hashlib.sha256(), b""

        def add(self, row: dict) -> None:
            self.cost += row["cost"]
            self.audit.append(row["audit"])
            lines = self.rest + row["lines"].encode("utf-8", "surrogatepass")
            # Lines are joined by newlines, so the last one waits for another line.
            self.rest = lines[-1:]
            self.digest.update(lines[:-1])

        def row(self) -> dict:
            return {
                "of": self.conv_id, "cost": self.cost, "audit": "".join(self.audit),
                "repaired_sha256": self.digest.hexdigest(),
            }

    now: Open | None = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if now is None or now.conv_id != row["conv_id"]:
                if now is not None:
                    done.append(now.row())
                now = Open(row["conv_id"])
            now.add(row)
        yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema)


# ---- all chunks -------------------------------------------------------------------------------


def _costs(chunks: DataFrame) -> DataFrame:
    """``id, next, costs``: the costs of every chunk, right but for a constant."""
    kinds = chunks.select("id", "next", "initials", "faults")
    end = F.array(*[F.lit(c).cast("long") for c in END])
    first = kinds.select(
        "*", end.alias("given"), F.lit(None).cast("array<long>").alias("behind"),
        F.lit(None).cast("array<array<long>>").alias("costs"),
    )
    state = stored(first.mapInArrow(_searched, _CHUNK), "turns-costs")
    while state.where("next is not null and changed").limit(1).count():
        successor = state.select(F.col("id").alias("next"), F.col("before").alias("given"))
        again = state.drop("before", "changed").join(successor, "next", "left").join(kinds.drop("next"), "id")
        again = again.withColumn("given", F.coalesce("given", end))
        state = stored(again.mapInArrow(_searched, _CHUNK), "turns-costs")
    return state.select("id", "next", "costs")


def _entries(traced: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, entry``: the state in which each chunk is entered.

    ``exits`` tells the state behind a chunk by the state before it.  Every turn puts the map of a chunk's
    predecessors in front of its own and doubles the number of chunks that it spans.
    """
    links = chunks.select("id", "next")
    before = links.where("next is not null").select(F.col("next").alias("id"), F.col("id").alias("previous"))
    spans = stored(traced.join(before, "id", "left"), "turns-spans")
    while spans.where("previous is not null").limit(1).count():
        front = spans.select(F.col("id").alias("previous"), F.col("exits").alias("first"), F.col("previous").alias("further"))
        chained = F.when(F.col("first").isNull(), F.col("exits")).otherwise(
            F.transform("first", lambda s: F.element_at("exits", s + 1))
        )
        spans = stored(
            spans.join(front, "previous", "left").select("id", chained.alias("exits"), F.col("further").alias("previous")),
            "turns-spans",
        )
    ends = spans.select(F.col("id").alias("previous"), F.element_at("exits", START + 1).alias("entry"))
    return before.join(ends, "previous").select("id", "entry")


def repair_conversations(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation.

    ``rows`` are ``conv_id, turn, role, text`` (no nulls in role and text; see :func:`damage`).  They are
    taken by turn, nulls first; of rows of one turn by role, then text.  Faults: no character but blanks;
    role and text seen earlier in the conversation; last such character not one of ``.!?``.  Edits per row
    are to keep it, to change its role to the one that is due, or to delete it (which blank and duplicate
    rows must be); empty user and assistant rows may be inserted anywhere.  Of the cheapest edits those
    whose initials come first are taken.  ``illegal`` counts neighbours whose initials are not su, ua or
    au, ``gaps`` the turns that lack between the least and the greatest.

    Null ids are one conversation.  Other columns are ignored, an empty table gives no rows.  The digest of
    a repaired conversation is sequential, so the chunks of one conversation pass through one task, as a
    stream; all else is dealt by chunks of ``2 ** chunk_bits`` rows at most.
    """
    faulty = stored(with_faults(_ordered(rows)), "turns-faults")
    chunk = F.shiftright("position", chunk_bits)
    held = F.sort_array(F.collect_list(F.struct("position", "role", "text", "fault")))
    chunks = faulty.groupBy("conv_id", chunk.alias("chunk")).agg(held.alias("rows"), F.min("position").alias("id"))
    # A row per chunk, not per row of a conversation.
    along = Window.partitionBy("conv_id").orderBy("id")
    edge = F.col("rows")[0]["role"].substr(1, 1)
    chunks = chunks.select(
        "conv_id", "id", F.lead("id").over(along).alias("next"), F.lead(edge).over(along).alias("next_initial"),
        F.transform("rows.role", lambda r: F.substring(r, 1, 1)).alias("initials"), F.col("rows.fault").alias("faults"),
        F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"),
    )
    chunks = stored(chunks, "turns-chunks")
    costs = _costs(chunks)
    traced = costs.join(chunks.select("id", "initials", "faults"), "id").mapInArrow(_traced, "id long, exits array<int>")
    entries = _entries(traced, chunks)
    whole = chunks.join(costs.select("id", "costs"), "id").join(entries, "id", "left")
    whole = whole.withColumn("entry", F.coalesce("entry", F.lit(START))).select(
        "conv_id", "id", "next", "initials", "faults", "roles", "texts", "costs", "entry"
    )
    pieces = whole.mapInArrow(_repaired, "conv_id long, id long, audit string, cost long, lines string")
    repaired = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(
        _digested, "of long, cost long, audit string, repaired_sha256 string"
    )
    after = F.concat(F.slice("initials", 2, F.size("initials")), F.array(F.col("next_initial")))
    pairs = F.zip_with("initials", after, lambda a, b: F.when(b.isNull() | F.concat(a, b).isin("su", "ua", "au"), 0).otherwise(1))
    illegal = chunks.groupBy("conv_id").agg(F.sum(F.aggregate(pairs, F.lit(0), lambda x, y: x + y)).alias("illegal"))
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = faulty.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    named = counts.withColumnRenamed("conv_id", "counted").join(
        illegal, F.col("counted").eqNullSafe(F.col("conv_id"))
    ).join(repaired, F.col("counted").eqNullSafe(F.col("of")))
    return named.select(
        F.col("counted").alias("conv_id"), "gaps", "blank", "duplicate", "truncated",
        F.col("illegal").cast("long").alias("illegal"), "cost", "audit", "repaired_sha256",
    )


def audit_conversations(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows``, after the damage that their checksums ask for.

    A conversation that loses all its rows has zeros, an empty audit and the digest of nothing.
    """
    ids = rows.select(F.col("`conv_id`").cast("long").alias("of")).distinct()
    plain = rows.select(
        F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), "role", "text"
    )
    found = repair_conversations(damage(plain))
    joined = ids.join(found, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("of").alias("conv_id"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
