"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding of disguised letters."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.llm.common import BATCH_ROWS, arrow_rows, free_name, sampled_labels, stored, whole_text

LABEL_BOUND = 100_000
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and digits and signs that stand
# for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v",
    "х": "x", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ł": "l", "ø": "o",
    "đ": "d", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ᴏ": "o",
}
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "i", "€": "e",
}


class Folding(dict):
    """A table for ``str.translate`` that fills itself: one step from any character to its folded form.

    Letters lose case, marks and width and look-alikes become Latin; substitutes become letters;
    zero-width characters vanish; everything else becomes a blank.
    """

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        if letter in SUBSTITUTES:
            found = SUBSTITUTES[letter]
        elif unicodedata.category(letter) in ("Cf", "Mn", "Me"):
            found = ""
        else:
            base = "".join(HOMOGLYPHS.get(x, x) for x in letter.lower())
            base = "".join(x for x in unicodedata.normalize("NFKD", base) if unicodedata.category(x) not in ("Mn", "Me"))
            base = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x)) for x in base.lower())
            found = base if base and all(x.isalpha() for x in base) else " "
        self[code] = found
        return found


def folded_words(text: str, table: Folding) -> list[str]:
    """Words of the folded text.  ``!`` and ``|`` at the end of a word are punctuation."""
    return text.replace("! ", " ").replace("!\n", " ").replace(" | ", " ").translate(table).split()


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights (``" word "`` or the start ``" stem"``), exception phrases, and the scale.

    ``score = 1 / (1 + exp(-(bias + total * sum + dense * sum / sqrt(words))))``
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    total: float
    dense: float


def _automaton(lexicon: Lexicon):
    """One automaton of entries and exceptions; an exception covers the entries that lie within it."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for entry, weight in lexicon.weights.items():
        machine.add_word(entry, (len(entry), weight))
    for phrase in lexicon.exceptions:
        machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
    if len(machine):
        machine.make_automaton()
    return machine


def _signal(words: list[str], machine) -> tuple[float, float]:
    """Sum of the weights found, and the same over the square root of the length in words.

    Of several entries that start at the same word the heaviest counts; those inside an exception
    phrase do not count.
    """
    if not len(machine) or not words:
        return 0.0, 0.0
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in machine.iter(f" {' '.join(words)} "):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        else:
            found[start] = max(weight, found.get(start, 0.0))
    if excused and found:
        starts = np.array([a for a, _ in excused])
        ends = np.maximum.accumulate(np.array([b for _, b in excused])[np.argsort(starts, kind="stable")])
        starts = np.sort(starts)
        places = np.array(list(found))
        at = np.searchsorted(starts, places, "right") - 1
        free = (at < 0) | (ends[np.maximum(at, 0)] <= places)
        total = float(sum(w for (_, w), ok in zip(found.items(), free, strict=True) if ok))
    else:
        total = float(sum(found.values()))
    return total, total / math.sqrt(len(words))


def _probability(lexicon: Lexicon, total: float, dense: float) -> float:
    z = lexicon.bias + lexicon.total * total + lexicon.dense * dense
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


_COUNTS = "entry string, toxic long, other long"


def _as_batch(seen: dict[int, Counter]) -> pa.RecordBatch:
    keys = list(seen[0].keys() | seen[1].keys())
    return pa.record_batch(
        [
            pa.array(keys, pa.string()),
            pa.array([seen[1][k] for k in keys], pa.int64()),
            pa.array([seen[0][k] for k in keys], pa.int64()),
        ],
        names=["entry", "toxic", "other"],
    )


def _entry_counts(labelled: DataFrame, shortest: int, longest: int) -> DataFrame:
    """``entry, toxic, other``: in how many labelled documents of either kind an entry occurs.

    Entries are folded words and their starts, and pairs of words (for exceptions).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = Folding(), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(folded_words(text, table))
                entries = {f" {w} " for w in words}
                entries |= {f" {w[:n]}" for w in words for n in range(shortest, min(longest, len(w)) + 1)}
                seen[int(label)].update(entries)
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield _as_batch(seen)
                seen = {0: Counter(), 1: Counter()}
        yield _as_batch(seen)

    return labelled.mapInArrow(count, _COUNTS).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _phrase_counts(labelled: DataFrame, entries: list[str]) -> DataFrame:
    """How often a lexicon word stands in documents of either kind with the same neighbour."""
    exact = {e.strip() for e in entries if e.endswith(" ")}
    stems = tuple(e.strip() for e in entries if not e.endswith(" "))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = Folding(), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = folded_words(text, table)
                phrases = set()
                for i, word in enumerate(words):
                    if word in exact or (stems and word.startswith(stems)):
                        phrases.update(" ".join(words[a : a + 2]) for a in (i - 1, i) if 0 <= a < len(words) - 1)
                seen[int(label)].update(phrases)
        yield _as_batch(seen)

    return labelled.mapInArrow(count, _COUNTS).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    bound: int = LABEL_BOUND,
    least_documents: int = 8,
    least_ratio: float = 1.5,
    certainty: float = 4.0,
    stem: tuple[int, int] = (4, 10),
) -> Lexicon:
    """Learn entries, weights, exceptions and the scale from labelled documents.

    About ``bound`` labelled rows are used (chosen by a hash of the id), which bounds the broadcast of
    their ids, the lexicon, and what the fit of the three numbers of the scale gathers.  An entry needs
    ``least_documents`` toxic documents and a log ratio of ``least_ratio`` that is ``certainty`` standard
    errors above 0.  Whole words and starts of words compete; of nested ones that stays which tells most.
    Of neighbour pairs around entries those that speak for a clean document become exceptions.
    Without usable labels the lexicon is empty and every score is 0.
    """
    chosen = sampled_labels(labels, F.col(label).isin(0, 1), label, bound)
    rows = docs.select("doc_id", whole_text().alias("text"))
    labelled = stored(rows.join(F.broadcast(chosen), "doc_id").select("text", "label"), "toxicity-labelled")
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_other:
        return Lexicon({}, (), -60.0, 0.0, 0.0)

    def ratio(toxic, other):
        return F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((other + 0.5) / (n_other + 1.0))

    def error(toxic, other):
        return F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))

    counts = _entry_counts(labelled, *stem).where(F.col("toxic") >= least_documents)
    counts = counts.withColumn("weight", ratio(F.col("toxic"), F.col("other")))
    surely = F.col("weight") - certainty * error(F.col("toxic"), F.col("other"))
    strong = counts.where((F.col("weight") >= least_ratio) & (surely >= 0))
    found = {r["entry"]: (r["weight"], _told(r["toxic"], r["other"], n_toxic, n_other)) for r in strong.collect()}
    entries = _without_covered(found)
    phrases = _phrase_counts(labelled, list(entries))
    clean = phrases.where(F.col("other") >= least_documents)
    clean = clean.where(ratio(F.col("toxic"), F.col("other")) + 2 * error(F.col("toxic"), F.col("other")) <= 0)
    exceptions = tuple(sorted(r["entry"] for r in clean.select("entry").collect()))
    rough = Lexicon(entries, exceptions, 0.0, 1.0, 0.0)

    def signals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, machine = Folding(), _automaton(rough)
        for batch in batches:
            pairs = [_signal(folded_words(t, table), machine) for t in batch["text"]]
            yield pd.DataFrame({"total": [a for a, _ in pairs], "dense": [b for _, b in pairs], "label": batch["label"]})

    # At most about ``bound`` rows of three numbers.
    sample = labelled.mapInPandas(signals, "total double, dense double, label int").toPandas()
    x = sample[["total", "dense"]].to_numpy(float)
    order = np.lexsort((x[:, 1], x[:, 0], sample["label"].to_numpy()))
    bias, total, dense = _logistic(x[order], sample["label"].to_numpy(float)[order])
    return Lexicon(entries, exceptions, float(bias), float(total), float(dense))


def _told(toxic: int, other: int, n_toxic: int, n_other: int) -> float:
    """What the presence of an entry tells about the label, in nats over all documents."""
    share = (toxic + other) / (n_toxic + n_other)
    told = 0.0
    for seen, n in ((toxic, n_toxic), (other, n_other)):
        for k, part in ((seen, share), (n - seen, 1 - share)):
            told += k * math.log(k / n / part) if k else 0.0
    return told


def _without_covered(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Of entries of which one is the start of another only the one that tells most stays."""
    kept: dict[str, float] = {}
    starts: set[str] = set()
    for entry in sorted(found, key=lambda e: (-found[e][1], e)):
        if entry not in starts and not any(entry[:n] in kept for n in range(1, len(entry) + 1)):
            kept[entry] = found[entry][0]
            starts.update(entry[:n] for n in range(1, len(entry) + 1))
    return kept


def score_toxicity(docs: DataFrame, lexicon: Lexicon, into: str = "__score") -> DataFrame:
    """``docs`` with all columns and ``into``, a probability; null text is the empty text.

    ``into`` must not be a column of ``docs``.  Repeated rows get the same score, an empty table none.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, machine = Folding(), _automaton(lexicon)
        for batch in batches:
            found = [
                _probability(lexicon, *_signal(folded_words(text.as_py() or "", table), machine))
                for text in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, into])

    return docs.mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever they are called.

    Null text counts as empty, repeated rows stay or go together, an empty table gives no rows.  The rows that stay
    are written here, because only then it is known how many rows Python gets at once.
    """
    score = free_name(docs, "__score")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        scored = score_toxicity(docs, learn_lexicon(docs, labels, **options), score)
        return stored(scored.where(F.col(f"`{score}`") < threshold).drop(score), "toxicity-kept")
