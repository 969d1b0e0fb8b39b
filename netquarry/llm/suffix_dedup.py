"""Removal of repeated passages with a range-partitioned sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import shuffle_partitions, stored, whole_text

WIDTH = 100
LEAD = 24
BLOCK = 8
BUCKET_BYTES = 8_000_000
LAST_ID = 2**63 - 1

FACTOR = 0x9E3779B97F4A7C15

Batches = Iterator[pa.RecordBatch]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit digests of all strings of ``width`` bytes, by doubling."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, size, factor = data.astype(np.uint64) + np.uint64(1), 1, FACTOR
    out, done, bits = None, 0, width
    while bits:
        if bits & 1:
            out = part[:n] if out is None else out * np.uint64(factor) + part[done : done + n]
            done += size
        bits >>= 1
        if bits:
            part = part[:-size] * np.uint64(factor) + part[size:]
            factor, size = factor * factor % 2**64, size * 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, width: int = WIDTH, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: ``place, digest of the lead, first start, last start``.

    The anchor of a string of ``width`` bytes is the leftmost of its substrings of ``lead`` bytes with
    the smallest digest.  Equal strings have equal anchors at the same distance; the strings of one
    anchor start in a row.
    """
    digests = rolling(data, lead)
    n = len(data) - width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    window = width - lead + 1
    least = (digests & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(digests), dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], n) - 1
    at = place[first]
    return at, digests[at].view(np.int64), first, last


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)


class Contents:
    """Digests of any substrings of a text, from running sums over its bytes."""

    def __init__(self) -> None:
        self._power, self._inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        while len(self._power) < len(data):
            n, inverse = len(self._power), pow(FACTOR, -1, 1 << 64)
            self._power = np.concatenate([self._power, self._power * np.uint64(pow(FACTOR, n, 1 << 64))])
            self._inverse = np.concatenate([self._inverse, self._inverse * np.uint64(pow(inverse, n, 1 << 64))])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._power[: len(data)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64)
        found = (found ^ (found >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return found ^ (found >> np.uint64(27))


def _anchor_rows(batches: Batches) -> Batches:
    """The anchors of every text, with a digest of all bytes that the anchor's strings cover.

    Of anchors of one content in a batch all but the earliest are ``sure`` to start earlier elsewhere.  They
    need not meet any other, so they are dealt by their own place: what recurs in very many documents,
    or very often in one, is not gathered.
    """
    names = ["sure", "digest", "content", "doc", "text_crc32", "first", "last"]
    contents = Contents()
    for batch in batches:
        ids = list(zip(batch.column("doc").to_pylist(), batch.column("text_crc32").to_pylist(), strict=True))
        parts: list[tuple[np.ndarray, ...]] = []
        for i in sorted(range(len(ids)), key=ids.__getitem__):
            data = _bytes(batch.column("text")[i])
            at, digest, first, last = anchors(data)
            n = len(digest)
            if n:
                content = contents.of(data, first, last + WIDTH) ^ (at - first).astype(np.uint64)
                parts.append((digest, content.view(np.int64), np.full(n, ids[i][0]), np.full(n, ids[i][1]), first, last))
        if not parts:
            continue
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort(columns[1::-1])  # stable: documents and places stay in order
        digest, content, doc, crc, first, last = (c[order] for c in columns)
        same = np.append(False, (digest[1:] == digest[:-1]) & (content[1:] == content[:-1]))
        twin = same & np.append(False, (doc[1:] == doc[:-1]) & (crc[1:] == crc[:-1]) & (first[1:] == first[:-1]))
        sure = same & ~twin
        own = (doc.view(np.uint64) * np.uint64(FACTOR)) ^ first.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        digest = np.where(sure, (own ^ (own >> np.uint64(29))).view(np.int64), digest)
        found = [sure, digest, content, doc, crc, first.astype(np.int32), last.astype(np.int32)]
        yield pa.record_batch([pa.array(c[~twin]) for c in found], names=names)


def _settled(batches: Batches) -> Batches:
    """Of anchors sorted by digest, content, document and place those that are settled, or still open.

    Sure ones are settled.  Of the other anchors with one content all strings are equal, so those of all but the earliest start earlier
    elsewhere: settled.  The earliest ones are open if their digest has other contents too, and nothing
    else is to be done about the rest.  One row is held back, the earliest of the present content while it
    is the first of its digest.
    """
    names = ["open", "doc", "text_crc32", "first", "last"]
    columns = ("digest", "content", "doc", "text_crc32", "first", "last")
    before: tuple | None = None  # the row in front of the batch
    held: tuple | None = None  # the earliest row of a digest with one content so far
    for batch in batches:
        sure = batch.column("sure")
        passed = batch.filter(sure)
        yield pa.record_batch(
            [pa.array(np.zeros(passed.num_rows, bool)), *[passed.column(c) for c in names[1:]]], schema=_SETTLED
        )
        batch = batch.filter(pc.invert(sure))
        n = batch.num_rows
        if not n:
            continue
        digest, content, doc, crc, first, last = (batch.column(c).to_numpy() for c in columns)
        values = (digest, content, doc, crc, first)
        same = [np.append(before is not None and before[k] == v[0], v[1:] == v[:-1]) for k, v in enumerate(values)]
        new_digest = ~same[0]
        new_content = new_digest | ~same[1]
        twin = ~new_content & same[2] & same[3] & same[4]  # a repeated row of one document
        settled = ~new_content & ~twin
        # Contents per digest, within the batch; the group in front of the first new digest goes on from before.
        group = np.cumsum(new_digest)
        several = np.bincount(group, new_content, minlength=int(group[-1]) + 1)
        several[0] += 0 if held is None and before is not None else 1  # one held: one content; none held: many
        if before is None:
            several[0] = 0
        elif held is None:
            several[0] = 2 if (group == 0).any() else 0
        is_open = new_content & (several[group] > 1)
        first_rows = np.flatnonzero(new_digest)
        keep = settled | is_open
        out = [pa.array(is_open[keep]), *[pa.array(v[keep]) for v in (doc, crc, first, last)]]
        if held is not None and several[0] > 1 and (group == 0).any():
            yield pa.record_batch([pa.array([v]) for v in (True, *held)], names=names).cast(_SETTLED)
        yield pa.record_batch(out, names=names).cast(_SETTLED)
        if several[group[-1]] > 1:
            held = None
        elif len(first_rows):
            i = first_rows[-1]
            held = (doc[i], crc[i], first[i], last[i])
        before = tuple(v[-1] for v in values)


_SETTLED = pa.schema(
    [("open", pa.bool_()), ("doc", pa.int64()), ("text_crc32", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
)


def _suffix_rows(batches: Batches) -> Batches:
    """Open anchors as suffixes: the bytes they begin with, and those that their strings cover."""
    names = ["lead", "doc", "text_crc32", "start", "anchor", "body"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        found: list[tuple] = []
        for doc, crc, text, places in zip(*(batch.column(c) for c in ("doc", "text_crc32", "text", "found")), strict=True):
            raw, doc, crc = text.as_py().encode("utf-8", "surrogatepass"), doc.as_py(), crc.as_py()
            ranges = np.array([(f["first"], f["last"]) for f in places.as_py()], np.int64)
            at, _, first, _ = anchors(np.frombuffer(raw, np.uint8))
            anchor = at[np.searchsorted(first, ranges[:, 0])]
            for (start, last), place in zip(ranges.tolist(), anchor.tolist(), strict=True):
                found.append((raw[place : place + LEAD], doc, crc, start, place - start, raw[start : last + WIDTH]))
        columns = zip(*found, strict=True) if found else [[] for _ in names]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def multikey_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Which of the strings ``data[at : at + width]`` are equal: their indices, and the group of each.

    Multikey quicksort with blocks of eight bytes as characters: the strings of a group are sorted by one
    block, those of equal blocks are the groups of the next, and strings that are alone drop out.
    Only strings of one ``group`` are compared.
    """
    windows = np.lib.stride_tricks.sliding_window_view(data, BLOCK)
    index, now = np.arange(len(at)), group
    for offset in (None, *range(0, width - BLOCK, BLOCK), width - BLOCK):
        if offset is None:
            order = np.argsort(now, kind="stable")
            changed = now[order[1:]] != now[order[:-1]]
        else:
            block = windows[at[index] + offset].view(">u8").ravel().astype(np.uint64)
            order = np.lexsort((block, now))
            changed = (now[order[1:]] != now[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
        begins = np.append(True, changed)[: len(order)]
        number = np.cumsum(begins)
        several = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
        index, now = index[order[several]], number[several]
    return index, now


def _repeated(batches: Batches) -> Batches:
    """Starts of strings that also start earlier, as runs, from one bucket of suffixes sorted by their lead.

    Equal strings have one lead, at one distance from their start, and are found by multikey quicksort; the
    earliest of them stays.  Some leads are taken together.
    """
    names = ["doc", "text_crc32", "first", "last"]

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        doc, crc, start, anchor = (table.column(c).to_numpy() for c in ("doc", "text_crc32", "start", "anchor"))
        bodies, leads = table.column("body").to_pylist(), table.column("lead").to_pylist()
        lead = np.cumsum([a != b for a, b in zip(leads, [None, *leads[:-1]], strict=True)])
        sizes = np.array([len(b) for b in bodies])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        counts = sizes - WIDTH + 1
        owner = np.repeat(np.arange(len(bodies)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (np.cumsum(sizes) - sizes)[owner] + within
        index, group = multikey_groups(data, at, lead[owner] * WIDTH + anchor[owner] - within)
        place = (start[owner] + within)[index]
        docs, crcs = doc[owner[index]], crc[owner[index]]
        order = np.lexsort((place, crcs, docs, group))
        index, group, place, docs, crcs = (x[order] for x in (index, group, place, docs, crcs))
        begins = np.append(True, group[1:] != group[:-1])[: len(group)]
        # Rows of one id and text are one document; its strings do not repeat each other.
        head = np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0)) if len(group) else np.empty(0, np.int64)
        first = (docs == docs[head]) & (crcs == crcs[head]) & (place == place[head])
        flag = np.zeros(len(owner), bool)
        flag[index[~first]] = True
        # Runs within rows.
        row_begins = np.cumsum(counts) - counts
        goes_on = np.append(False, flag[:-1])
        goes_on[row_begins] = False
        stops_here = np.append(~flag[1:], True)
        stops_here[row_begins[1:] - 1] = True
        opened, closed = np.flatnonzero(flag & ~goes_on), np.flatnonzero(flag & stops_here)
        row = owner[opened]
        return pa.record_batch(
            [
                pa.array(doc[row]), pa.array(crc[row]), pa.array((start[row] + within[opened]).astype(np.int32)),
                pa.array((start[row] + within[closed]).astype(np.int32)),
            ],
            names=names,
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lead = batch.column("lead")
        cut = [i for i in range(1, batch.num_rows) if lead[i] != lead[i - 1]]
        if held and held[-1].column("lead")[-1] != lead[0]:
            cut = [0, *cut]
        if size + batch.nbytes > BUCKET_BYTES and cut:
            at = cut[-1]
            if at:
                held.append(batch.slice(0, at))
            yield solve(held)
            held, size = [batch.slice(at)], batch.slice(at).nbytes
        else:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield solve(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        rows = []
        for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            covered = np.zeros(len(raw) + 1, np.int32)
            if runs:
                np.add.at(covered, [r["first"] for r in runs], 1)
                np.add.at(covered, [r["last"] + WIDTH for r in runs], -1)
            gone = np.cumsum(covered)[:-1] > 0
            spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What stays of each document without strings of 100 bytes that start earlier elsewhere.

    Suffixes are taken at anchors chosen by content (one in 35 bytes): strings that are equal have
    equal anchors at the same distance, and a suffix stands for all strings of its anchor.  Anchors whose
    strings cover equal bytes are settled without looking at the strings: the earliest stays and all
    others go, so that a passage with very many copies leaves one suffix.  Those that recur with other
    bytes around them are range-partitioned by their leading bytes, at splitters that Spark samples; a
    bucket sorts their strings by multikey quicksort and marks all but the earliest of equal ones.  Equal
    strings have one lead, so none lie on both sides of a boundary.

    A bucket holds the different suffixes of one lead at once, which are as many as there are different
    surroundings of 24 equal bytes.

    Columns: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.  Null text is empty.  A null id counts
    as the largest.  Rows with the same id and text are one document and keep the same; of rows with the
    same id and different texts that with the smaller checksum is earlier.  Other columns are ignored,
    an empty table gives no rows.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.crc32(whole_text(text).cast("binary")).alias("text_crc32"),
        whole_text(text).alias("text"),
    )
    n = shuffle_partitions(docs.sparkSession)
    places = rows.select("doc", "text_crc32", "text").mapInArrow(
        _anchor_rows, "sure boolean, digest long, content long, doc long, text_crc32 long, first int, last int"
    )
    settled = places.repartition(n, "digest").sortWithinPartitions("digest", "content", "doc", "text_crc32", "first")
    found = stored(settled.mapInArrow(_settled, "open boolean, doc long, text_crc32 long, first int, last int"), "suffix-anchors")
    place = F.struct("first", "last")
    unsettled = found.where("open").groupBy("doc", "text_crc32").agg(F.collect_set(place).alias("found"))
    suffixes = rows.select("doc", "text_crc32", "text").join(unsettled, ["doc", "text_crc32"]).mapInArrow(
        _suffix_rows, "lead binary, doc long, text_crc32 long, start int, anchor int, body binary"
    )
    suffixes = stored(suffixes, "suffixes")
    buckets = suffixes.repartitionByRange(n, "lead").sortWithinPartitions("lead")
    runs = stored(buckets.mapInArrow(_repeated, "doc long, text_crc32 long, first int, last int"), "suffix-runs")
    whole = found.where("not open").drop("open").union(runs)
    of_document = whole.groupBy("doc", "text_crc32").agg(F.collect_set(place).alias("runs"))
    return rows.join(of_document, ["doc", "text_crc32"], "left").select("doc_id", "text", "runs").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
