"""The pipeline stage by stage against plain versions, on a small table with awkward rows and columns."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from netquarry.llm import exact_dedup, packing, toxicity  # noqa: E402
from netquarry.llm.common import BATCH_ROWS, stored  # noqa: E402
from netquarry.llm.toxicity import drop_toxic  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __score double, __kept_doc_id string, component long, keep_id long, size int"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "__score", "__kept_doc_id", "component", "keep_id", "size"]


def corpus():
    rnd = random.Random(8)
    sentence = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    rows = []
    for k in range(240):
        toxic = k % 6 == 0
        rows.append((k, sentence(30) + (" vilegrub snarlhex" if toxic else "") + " " + sentence(20), int(toxic)))
    clean = [t for _, t, toxic in rows if not toxic]
    rows += [(300 + k, clean[k].replace(" ", "  "), 0) for k in range(10)]
    rows += [(320 + k, clean[k + 10] + " one more word here", 0) for k in range(10)]
    rows += [(340, None, 0), (341, "", 0), (342, " \n", 0), (343, sentence(30_000), 0), (344, "short text", 0), (344, "short text", 0), (None, sentence(40), 0)]
    return [(k, t, toxic, "ab"[i % 2] if i % 5 else None) for i, (k, t, toxic) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    frame = spark.createDataFrame([(k, t, "en", s, 1, 0.5, "x", 9, 9, 3) for k, t, _, s in rows], SCHEMA)
    frame.repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, toxic) for k, _, toxic, _ in rows if k is not None and k < 240]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    found = words(text)
    return {tuple(found[k : k + 5]) for k in range(len(found) - 4)} or ({tuple(found)} if found else set())


def test_stages(spark, folder):
    rows = corpus()
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == COLUMNS
        seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (repr(r[0]), repr(r[1]))
    kept = [(k, t) for k, t, toxic, _ in rows if not toxic]
    assert sorted(seen["toxicity"], key=key) == sorted(kept, key=key)
    groups = {}
    for k, t in set(kept):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), k is None, k or 0, k, t))
    exact = [min(g)[3:] for g in groups.values()]
    assert sorted(seen["exact_dedup"], key=key) == sorted(exact, key=key)
    # Of near copies one stays, and every document is like one that stays.
    near = seen["near_dedup"]
    assert set(near) <= set(exact)
    sets = {r: shingles(r[1]) for r in exact}
    for a in exact:
        like = [b for b in near if a == b or (sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))]
        assert len(like) == 1
    # The mix takes a document not at all, once or twice.
    mixed = seen["source_mixing"]
    assert set(mixed) <= set(near) and all(mixed.count(r) <= 2 for r in set(mixed))


def test_whole_texts_go_to_python_in_small_batches(spark, folder, monkeypatch):
    seen, name = {}, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def recording(df, purpose):
        seen[purpose] = int(spark.conf.get(name))
        return stored(df, purpose)

    for module in (corpus_pipeline, toxicity, exact_dedup, packing):
        monkeypatch.setattr(module, "stored", recording)
    before = spark.conf.get(name)
    assert corpus_pipeline.run(spark, folder).count() and spark.conf.get(name) == before
    written = {p: seen[p] for p in ("toxicity-kept", "content-sort", "token-pieces")}
    assert written == dict.fromkeys(written, BATCH_ROWS) and BATCH_ROWS <= 500
    # What is planned later knows nothing of these batches, so Python has no part in it.
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert "MapIn" not in docs._jdf.queryExecution().executedPlan().toString()


def test_run(spark, folder):
    packed = corpus_pipeline.run(spark, folder).collect()
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_toxicity_keeps_columns_of_any_name(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = drop_toxic(docs.withColumnRenamed("size", "__SCORE_"), labels)
    assert got.columns == [*COLUMNS[:-1], "__SCORE_"] and got.where("__score = 0.5").count() == got.count() > 0
