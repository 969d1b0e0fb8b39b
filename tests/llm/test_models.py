"""Packing, language mixtures, decision lists and the lexicon against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm.languages import learn_languages, predict_languages
from netquarry.llm.packing import pack, pack_documents, token_pieces, vector_best_fit
from netquarry.llm.quality_rules import first_rule, learn_rules, rate_quality
from netquarry.llm.toxicity import Folding, Lexicon, folded_words, score_toxicity

SCHEMA = "doc_id long, text string, lang string, label int, piece string, length int, score double"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, lang, 1, "p", 2, 0.5) for k, t, lang in rows], SCHEMA).repartition(parts)


# ---- packing ----------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity, most_documents, most_attention, weights, rule):
    bins = []  # [residual tokens, documents, attention, pieces]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        demand = (lengths[i], 1, lengths[i] ** 2)
        best, best_score = None, None
        for bin_ in bins:
            if all(r >= d for r, d in zip(bin_[0], demand)):
                whole = (capacity, most_documents, most_attention)
                if rule == "norm":
                    score = sum(w * ((r - d) / c) ** 2 for r, d, c, w in zip(bin_[0], demand, whole, weights))
                else:
                    dot = sum(w * r / c * d / c for r, d, c, w in zip(bin_[0], demand, whole, weights))
                    score = -dot / sum(w * (r / c) ** 2 for r, c, w in zip(bin_[0], whole, weights))
                if best is None or score < best_score - 1e-12:
                    best, best_score = bin_, score
        if best is None:
            best = [[capacity, most_documents, most_attention], []]
            bins.append(best)
        best[0] = [r - d for r, d in zip(best[0], demand)]
        best[1].append(i)
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 4_000), (100, 4, 5_000)])
def test_vector_best_fit(rule, limits):
    rnd = random.Random(limits[1] + limits[2])
    lengths = [rnd.randrange(1, 60) for _ in range(300)]
    weights = (1.0, 1 / 64, 1 / 64)
    bins, offsets = vector_best_fit(np.array(lengths), *limits, weights, rule)
    found = {}
    for i, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist())):
        found.setdefault(b, []).append((o, lengths[i]))
    for pieces in found.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limits[0] and len(pieces) <= limits[1] and sum(n * n for _, n in pieces) <= limits[2]
    # Equal scores may be settled differently, so the number of sequences is compared.
    plain = plain_best_fit(lengths, *limits, weights, rule)
    assert abs(len(found) - len(plain)) <= max(1, len(plain) // 50)
    least = max(sum(lengths) / limits[0], len(lengths) / limits[1], sum(n * n for n in lengths) / limits[2])
    assert len(found) <= 1.35 * least + 1


def test_a_piece_that_fits_nowhere_is_refused():
    with pytest.raises(ValueError):
        vector_best_fit(np.array([50]), 100, 10, 2_000, (1.0, 1.0, 1.0), "norm")


def texts():
    rnd = random.Random(6)
    rows = [(k, " ".join(f"word{rnd.randrange(500)}" for _ in range(rnd.randrange(0, 400))), "en") for k in range(80)]
    return rows + [(90, None, None), (91, "", "en"), (92, "é ü 漢字 " * 3000, "en"), (93, "x", "en"), (93, "x", "en"), (None, "y", None)]


def test_pieces_and_sequences(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for k, text, _ in texts():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        start, pieces = 0, []
        while start < len(ids):
            size = (len(ids) - start - 1) % 1024 + 1 if start == 0 else 1024
            part = ids[start : start + size]
            pieces.append((k, len(pieces), start, size, zlib.crc32(np.array(part, "<u4").tobytes())))
            start += size
        want += pieces
    packed = pack_documents(frame(spark, texts())).collect()
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 1024
    total = sum(r["length"] for r in packed)
    assert len(places) <= 1.05 * total / 1024 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_limit(spark, rule):
    pieces = token_pieces(frame(spark, texts()), 256)
    packed = pack(pieces, 256, most_documents=3, most_attention=40_000 + 25_536, rule=rule, group_rows=40).groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.count("*").alias("documents"), F.sum(F.col("length") * F.col("length")).alias("attention")
    )
    found = packed.collect()
    assert max(r["tokens"] for r in found) <= 256 and max(r["documents"] for r in found) <= 3
    assert max(r["attention"] for r in found) <= 65_536


# ---- languages --------------------------------------------------------------------------------


def spoken(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(n))


LETTERS = {"aa": "aeioubdg", "bb": "aeiouklmnst", "cc": "éèàùçlmrst"}


@pytest.fixture(scope="module")
def languages(spark):
    rnd = random.Random(2)
    rows = [(k, spoken(rnd, LETTERS[lang], 200), lang) for k, lang in enumerate(list(LETTERS) * 20)]
    return learn_languages(frame(spark, rows).select("doc_id", "text", "lang"))


@pytest.mark.parametrize("shares", [{"aa": 1.0}, {"cc": 1.0}, {"aa": 0.7, "bb": 0.3}, {"bb": 0.5, "cc": 0.5}, {"aa": 0.4, "bb": 0.35, "cc": 0.25}])
def test_mixtures_are_estimated(spark, languages, shares):
    rnd = random.Random(3)
    rows = []
    for k in range(12):
        words = [w for lang, share in shares.items() for w in spoken(rnd, LETTERS[lang], int(600 * share)).split()]
        rows.append((k, " ".join(words), None))
    for r in predict_languages(frame(spark, rows), languages).collect():
        found = {p.split(":")[0]: float(p.split(":")[1]) for p in r["mixture"].split(",")}
        assert found.keys() == shares.keys()
        assert all(abs(found[lang] - share) < 0.12 for lang, share in shares.items())
        assert shares[r["lang_pred"]] >= max(shares.values()) - 0.1 and 0 < r["score"] <= 1


def test_languages_of_odd_texts(spark, languages):
    rows = [(1, None, None), (2, "", None), (3, "123 !? 456", None), (4, "aeiou " * 30_000, None), (4, "aeiou", None), (None, "klmnst klm", None)]
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"] > 0) for r in predict_languages(frame(spark, rows), languages).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(k, "und", False) for k in (1, 2, 3)]
    assert len(got) == 6 and all(g[1] in LETTERS for g in got if g[0] in (4, None))
    assert predict_languages(frame(spark, []), languages).count() == 0
    nothing = learn_languages(frame(spark, []).select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in predict_languages(frame(spark, rows), nothing).collect()} == {"und"}


# ---- decision lists ---------------------------------------------------------------------------


def planted(n=3000, seed=1):
    """Bad are rows with a large first value, or a small second one with a large third."""
    rnd = np.random.default_rng(seed)
    x = rnd.random((n, 4))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.3) & (x[:, 2] > 0.6))
    return x, bad, np.arange(n) % 3


def verdicts(rules, x, names):
    out = np.zeros(len(x), int)
    for number, rule in enumerate(rules, 1):
        holds = np.ones(len(x), bool)
        for c in rule:
            value = x[:, names.index(c.feature)]
            holds &= value > c.limit if c.above else value <= c.limit
        out[(out == 0) & holds] = number
    return out


def test_rules_find_a_planted_list():
    names = ["a", "b", "c", "d"]
    x, bad, part = planted()
    rules = learn_rules(x, bad, names, part)
    fresh, truth, _ = planted(seed=2)
    told = verdicts(rules, fresh, names) > 0
    assert (told & truth).sum() >= 0.9 * truth.sum() and (told & truth).sum() >= 0.9 * told.sum()
    # The rule that covers most with one condition comes first, and no rule looks at the idle feature alone.
    assert [c.feature for c in rules[0]][0] == "a" and rules[0][0].above
    assert all(any(c.feature != "d" for c in rule) for rule in rules)


def test_rules_need_evidence():
    x, _, part = planted(600)
    noise = np.random.default_rng(5).random(600) < 0.1
    assert len(learn_rules(x, noise, ["a", "b", "c", "d"], part)) <= 1
    assert learn_rules(x[:0], noise[:0], ["a", "b", "c", "d"], part[:0]) == []


def test_rules_as_columns(spark):
    names = ["a", "b", "c", "d"]
    x, bad, part = planted(800)
    rules = learn_rules(x, bad, names, part)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = [r["rule"] for r in rows.select(first_rule(rules).alias("rule")).collect()]
    assert got == verdicts(rules, x, names).tolist()


def test_statistics_and_verdicts(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, None, None), (2, words, None), (3, (words + "\n") * 2, None), (4, "# * $ " * 10, None), (5, "one " * 19, None), (5, words, None), (None, words, None)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rated, rules = rate_quality(frame(spark, rows), labels)
    assert rules == []
    got = {(r["doc_id"], r["n_words"]): (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rated.collect()}
    chars = sum(len(w) for w in words.split())
    assert got[2, 30] == got[5, 30] == got[None, 30] == (chars, 0, 0, 0, False, True)
    assert got[3, 60] == (2 * chars, 0, 1, 60, True, False)
    assert got[1, 0] == (0, 0, 0, 0, True, False) and got[4, 30] == (30, 30, 0, 30, True, False) and got[5, 19][4:] == (True, False)


# ---- lexicon ----------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["vilegrub", "VileGrub", "v1legrub", "vileɡrub", "vіlegrub", "v​ilegrub", "vílegrub", "ｖｉｌｅｇｒｕｂ", "vilegrub!"])
def test_folding(text):
    assert folded_words(f"so {text} it", Folding())[1].rstrip("i") == "vilegrub"


def scores(spark, lexicon, found):
    rows = [(k, t, None) for k, t in enumerate(found)]
    return {r["doc_id"]: r["__score"] for r in score_toxicity(frame(spark, rows).drop("score"), lexicon).collect()}


def test_lexicon_scores(spark):
    lexicon = Lexicon({" vilegrub ": 4.0, " vile": 2.0, " snarl ": 3.0}, ("snarl gently",), -3.0, 0.2, 1.5)
    filler = " fine words" * 40
    got = scores(spark, lexicon, ["vilegrub", "vile", "vilest", "evil", "snarl", "snarl gently", "snarl gently snarl", None, "", "vilegrub" + filler, "vilegrub" + filler * 5])
    base = got[8]
    assert got[7] == base and got[3] == base and got[5] == base  # nothing found, or excused
    assert got[0] > got[4] > got[1] == got[2] > base  # the heaviest entry of a word counts once
    assert base < got[6] < got[4]  # one of two is excused, and the text is longer
    assert got[0] > got[9] > got[10] > base  # diluted by length
    assert all(0 <= s <= 1 for s in got.values())
    assert set(scores(spark, Lexicon({}, (), -60.0, 0.0, 0.0), ["vilegrub", None]).values()) == {scores(spark, Lexicon({}, (), -60.0, 0.0, 0.0), [""])[0]}

