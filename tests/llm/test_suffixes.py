"""Removal of repeats against brute force: batches cut anywhere, one letter, copies, repeated rows."""

import hashlib
import random

import numpy as np
import pytest

from netquarry.llm import suffix_dedup
from netquarry.llm.suffix_dedup import multikey_groups, remove_repeats

SCHEMA = "doc_id long, text string, digest string, runs int, found int, open int, lead string, doc int"


def expected(rows):
    """By id, then by checksum of the text; repeated rows are one document."""
    import zlib

    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - 99):
            part = data[p : p + 100]
            if part in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(part)
        rest = bytes(c for c, gone in zip(data, covered) if not gone)
        spans = sum(c and not (p and covered[p - 1]) for p, c in enumerate(covered))
        out[doc_id, text] = (len(data), sum(covered), spans, hashlib.sha256(rest).hexdigest())
    return [(doc_id, *out[doc_id, text]) for doc_id, text in rows]


def corpus():
    rnd = random.Random(4)
    sentence = lambda n: " ".join(f"w{rnd.randrange(400)}" for _ in range(n))
    passages = [sentence(n) for n in (18, 25, 40, 120)]
    line = "This very common line is repeated in very many documents, at most ninety-nine bytes long."
    rows = [(k, sentence(rnd.randrange(5, 60)) + rnd.choice(passages) + "\n" + line + sentence(20)) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(8)] + [(200, rows[0][1][3:-2]), (201, "é" * 90 + rows[1][1])]
    rows += [(300, "a" * 700), (301, "a" * 99), (302, "b" + "a" * 350), (303, "ab" * 300), (304, None), (305, ""), (306, "x" * 100)]
    rows += [(400, passages[3]), (400, passages[3]), (400, passages[2] * 2), (None, passages[3]), (None, "tail " + passages[3])]
    rows += [(500, sentence(20_000)), (501, "\n".join([passages[1]] * 9))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("records", [3, 10_000])
def test_repeats(spark, monkeypatch, records):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    rows = corpus()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        docs = spark.createDataFrame([(*r, "d", 1, 2, 3, "l", 4) for r in rows], SCHEMA).repartition(5)
        got = [tuple(r) for r in remove_repeats(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_multikey_groups():
    rnd = np.random.default_rng(2)
    data = rnd.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1500] = data[100:600]
    at = np.arange(0, 2800)
    group = rnd.integers(0, 2, len(at))
    index, found = multikey_groups(data, at, group, 20)
    strings = {}
    for k in at.tolist():
        strings.setdefault((int(group[k]), bytes(data[k : k + 20])), []).append(k)
    want = sorted(tuple(v) for v in strings.values() if len(v) > 1)
    got = {}
    for i, g in zip(index.tolist(), found.tolist()):
        got.setdefault(g, []).append(i)
    assert sorted(tuple(sorted(v)) for v in got.values()) == want
