"""Signature trees and spelling variants against brute force on small tables."""

import itertools
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from netquarry.llm import near_dedup, signature_tree
from netquarry.llm import shingles as shingle_sets
from netquarry.llm.common import SHUFFLE_CLEANUP, stored
from netquarry.llm.shingles import Shingles
from netquarry.llm.signature_tree import LEAF_ROWS, jaccard_components
from netquarry.llm.spelling import differ_by_one, pivots, spelling_variants

SCHEMA = "doc_id long, text string, rep string, key int, word string, n int, component string"


def words_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    words = words_of(text)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(sets, percent):
    root = dict.fromkeys(sets)
    root = {k: k for k in root}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


def family(rnd, size, length, edits):
    """An original and copies of it with some words changed."""
    original = [f"w{rnd.randrange(5000)}" for _ in range(length)]
    yield " ".join(original)
    for _ in range(size):
        copy = list(original)
        for _ in range(rnd.randrange(edits + 1)):
            copy[rnd.randrange(length)] = f"x{rnd.randrange(5000)}"
        yield " ".join(copy)


def corpus(seed):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "one two", "One  two ", "one", "ÀB àb ÀB", "a b c d e", "A B C D E f", "\x00 a", "\x00\x00 a"]
    for size, length, edits in ((70, 120, 6), (40, 60, 3), (3, 400, 20), (8, 30, 2), (5, 12, 1)):
        texts += family(rnd, size, length, edits)
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"u{rnd.randrange(9000)}" for _ in range(rnd.randrange(10, 200))) for _ in range(60)]
    texts += [" ".join(f"v{k % 4099}" for k in range(30_000)), " ".join(f"v{k % 4099}" for k in range(30_010)), "x" * 600_000]
    rnd.shuffle(texts)
    return {k: t for k, t in enumerate(texts)}


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(k, t, "r", 1, "w", 2, "c") for k, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed, percent, leaf", [(2, 80, 4), (3, 60, 8)])
def test_jaccard_components(spark, monkeypatch, seed, percent, leaf):
    monkeypatch.setattr(signature_tree, "LEAF_DOCUMENTS", leaf)
    monkeypatch.setattr(signature_tree, "FANOUT_BITS", 2)
    texts = corpus(seed)
    sets = {k: shingles(t) for k, t in texts.items()}
    want = components(sets, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, texts.items()), percent=percent).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in sets}


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(7, text), (7, text), (3, text + " tail"), (None, text), (None, "alone among null ids"), (9, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(7, 46, 3), (7, 46, 3), (3, 47, 3), (None, 46, 3), (None, 1, None), (9, 0, 9)], key=repr)


@pytest.mark.parametrize("operator", [jaccard_components, spelling_variants])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_shingles_of_long_texts_in_pieces(monkeypatch):
    whole = Shingles()
    rnd = random.Random(5)
    for _ in range(50):
        text = "".join(rnd.choice("ab C\n\x0b é") for _ in range(rnd.randrange(300)))
        monkeypatch.setattr(Shingles, "PIECE", 1 << 18)
        plain = whole.all_of(text)
        monkeypatch.setattr(Shingles, "PIECE", 7)
        assert np.array_equal(Shingles().all_of(text), plain)
        assert len(set(plain.tolist())) == len(shingles(text))


# ---- spelling ---------------------------------------------------------------------------------


def vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(min(len(b), 50)))


def expected_forms(rows):
    n = vocabulary(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled(seed):
    """Words of few letters, so that many are near each other, some with accents and repeated grams."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(6, 11))) for _ in range(150)]
    words += ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "Bananana", "banananana", "ÉTÉÉTÉÉ", "étéétéé", "×÷×÷×÷×", "abababab", "babababa"]
    rows = [(k, " ".join(rnd.choices(words, k=120)) + ", " + rnd.choice(words).upper()) for k in range(20)]
    common = words[0] if len(words[0]) > 6 else "aaaaaaaa"
    rows += [(100, f"{common} " * 700), (101, (common + "b ") * 60), (102, (common + "bb ") * 5), (103, (common[:-1] + "z ") * 2)]
    return rows + [(None, "aaaaaaaa bbbbbbbbb bbbbbbbbb"), (None, None), (5, ""), (5, "x" * 30_000), (5, "x" * 30_000), (6, "x" * 30_001), (6, "x" * 30_001)]


def test_spelling_variants(spark):
    rows = spelled(1)
    names = ("form", "root", "n", "n_near", "form_n")
    found = spelling_variants(frame(spark, rows)).collect()
    got = {r["word"]: tuple(r[n] for n in names) for r in found}
    assert len(got) == len(found)
    assert got == expected_forms(rows)
    assert any(v[0] is not None and v[0] != v[1] for v in got.values())


def test_differ_by_one():
    words = ["".join(w) for n in range(5) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        assert differ_by_one(a, b) == one_edit(a, b)


def test_pivots_are_the_cheapest_disjoint_grams():
    rnd = random.Random(1)
    for _ in range(300):
        places = rnd.sample(range(12), rnd.randrange(3, 8))
        grams = [(p, rnd.randrange(1, 50)) for p in places]
        pairs = [c for c in itertools.combinations(grams, 2) if abs(c[0][0] - c[1][0]) >= 2]
        chosen = pivots(grams, 2)
        assert sum(w for _, w in chosen) == min(a[1] + b[1] for a, b in pairs)
        assert abs(chosen[0][0] - chosen[1][0]) >= 2


def test_keys_and_partners_texts_are_shuffled_once(spark, monkeypatch):
    plans = {}
    plain = signature_tree.stored

    def recording(df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, purpose)

    monkeypatch.setattr(signature_tree, "stored", recording)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "alone"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    # One shuffle by digest, one by key: keys are counted where they lie.
    assert plans["tree-met"].count("Exchange hashpartitioning(") == 2
    # Texts pass a bitmap of the documents with partners before they are shuffled.
    assert "__bits" in plans["tree-sets"]


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    plain = signature_tree.stored

    def recording(df, purpose):
        seen.append(int(spark.conf.get(name)))
        return plain(df, purpose)

    monkeypatch.setattr(signature_tree, "stored", recording)
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_components(docs).collect()} == {1}
    assert seen and max(seen) <= 500 and spark.conf.get(name) == before


@pytest.mark.parametrize("operator", [near_dedup.near_duplicates, jaccard_components])
def test_sets_of_leaves_go_to_python_in_smaller_batches(spark, monkeypatch, operator):
    seen, name = {}, "spark.sql.execution.arrow.maxRecordsPerBatch"
    plain = signature_tree.stored

    def recording(df, purpose):
        seen[purpose] = int(spark.conf.get(name))
        return plain(df, purpose)

    for module in (near_dedup, signature_tree):
        monkeypatch.setattr(module, "stored", recording)
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f g")], "doc_id long, text string")
    assert operator(docs).count() == 3
    assert max(seen.values()) <= 500 and spark.conf.get(name) == before
    assert LEAF_ROWS <= 16 and {seen["tree-first-links"], seen["tree-rest-links"]} == {LEAF_ROWS}


def test_rows_of_a_batch_are_made_one_by_one():
    made = []

    class Batch:
        num_rows = 3

        def slice(self, at, n):
            made.append((at, n))
            return pa.record_batch([pa.array([at])], names=["at"])

    found = signature_tree._rows(iter([Batch()]))
    assert next(found) == {"at": 0} and made == [(0, 1)]
    assert list(found) == [{"at": 1}, {"at": 2}]


def test_few_links_are_followed_by_few_tasks(spark, monkeypatch):
    files = []
    plain = shingle_sets.stored

    def recording(df, purpose):
        out = plain(df, purpose)
        if purpose != "components-edges":
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(shingle_sets, "stored", recording)
    monkeypatch.setattr(shingle_sets, "EDGES_PER_TASK", 300)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        edges = spark.range(200).selectExpr("id + 1 as a", "id as b").union(spark.range(300, 310).selectExpr("id as a", "300L as b"))
        found = {tuple(r) for r in shingle_sets.connected_components(edges).collect()}
    finally:
        spark.conf.set(name, before)
    assert found == {(k, 0) for k in range(201)} | {(k, 300) for k in range(300, 310)}
    # 418 edges in both directions: two tasks, not one for each of the eight shuffle partitions.
    assert max(files) == 2


def test_few_pairs_of_leaves_are_taken_by_few_tasks(spark, monkeypatch):
    files = {}

    def recording(plain):
        def run(df, purpose):
            out = plain(df, purpose)
            files[purpose] = max(files.get(purpose, 0), len(out.inputFiles()))
            return out

        return run

    for module in (signature_tree, shingle_sets):
        monkeypatch.setattr(module, "stored", recording(module.stored))
    monkeypatch.setattr(signature_tree, "LEAF_DOCUMENTS", 2)
    rnd = random.Random(5)
    texts = [t for _ in range(6) for t in family(rnd, 8, 60, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    finally:
        spark.conf.set(name, before)
    assert found == components({k: shingles(t) for k, t in enumerate(texts)}, 80)
    few = ("tree-sets", "tree-first-links-pairs", "tree-rest-links-pairs", "components-edges")
    assert {p: files[p] for p in few} == dict.fromkeys(few, 1)


def test_counters_come_in_few_jobs(spark):
    context, name = spark.sparkContext, "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    rows = spark.createDataFrame([(" ".join(f"w{k}{i}" for i in range(200)),) for k in range(40)], "text string")
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    context.setJobGroup("counters", "")
    try:
        ranks = signature_tree.shingle_ranks(rows)
    finally:
        context._jsc.clearJobGroup()
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert (ranks > 0).sum() > 7000
    # The counters are summed in parallel; each part that then comes to the driver is a job, and was one of 40.
    assert 0 < len(context.statusTracker().getJobIdsForGroup("counters")) <= 10


def test_stored_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for top in disk.localDirs() for f in Path(top.getPath()).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP)
    kept = stored(spark.range(1000).repartition(4, "id"), "cleanup")
    until = time.monotonic() + 10
    while (left := files() - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not left and kept.count() == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
