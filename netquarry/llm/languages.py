"""Language identification as a mixture of languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import whole_text

BUCKETS = 1 << 15
FIT_BOUND = 100_000
UNKNOWN = "und"


class Trigrams:
    """Hashed letter trigrams of words; everything that is no letter is one blank."""

    def __init__(self) -> None:
        # One entry per code point, built once per task.
        self._letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def counts(self, text: str) -> np.ndarray | None:
        """Counts by bucket, or None if there is no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self._letter[codes]
        if not letter.any():
            return None
        padded = np.full(len(codes) + 2, np.uint32(32))
        padded[1:-1] = np.where(letter, codes, np.uint32(32))
        mixed = (padded[:-2] * np.uint32(0x9E3779B1)) ^ (padded[1:-1] * np.uint32(0x85EBCA77)) ^ (padded[2:] * np.uint32(0xC2B2AE3D))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return np.bincount((mixed[letter] >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of trigram buckets, a row per language."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def learn_languages(labelled: DataFrame, lang: str = "lang", text: str = "text", bound: int = FIT_BOUND, smooth: float = 0.5) -> LanguageModel:
    """Trigram counts of the languages, from about ``bound`` labelled documents (chosen by a hash).

    A task adds up its documents by language before the shuffle, and Spark adds the sums; the model has
    ``BUCKETS`` numbers per language, whatever the size of the table.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), "doc_id")
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(bound / n * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Trigrams(), {}
        for batch in batches:
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found = grams.counts(value.as_py())
                if found is not None:
                    sums[name] = sums.get(name, 0) + found
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    sums = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    table = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    counts = np.zeros((len(languages), BUCKETS))
    index = {name: i for i, name in enumerate(languages)}
    counts[table["lang"].map(index).to_numpy(np.int64), table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(float)
    smoothed = counts + smooth
    return LanguageModel(languages, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32) if languages else counts)


def mixtures(
    counts: list[np.ndarray], log_p: np.ndarray, candidates: int = 8, most: int = 3, rounds: int = 10, weight: float = 3.0
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Languages and their shares for each document.

    Expectation-maximisation over the document's trigrams: an occurrence belongs to the languages by
    their present share times the trigram's probability, and shares are the means of these parts.  The
    ``candidates`` likeliest languages take part.  Then the sets of the 1, 2, ... ``most`` largest
    languages are fitted by themselves, and that with the best likelihood less ``weight * log(n) / 2``
    for each further language is taken (trigrams overlap, so plain ``log(n) / 2`` would be too little).
    """
    at = [np.flatnonzero(c) for c in counts]
    starts = np.cumsum([0] + [len(a) for a in at[:-1]])
    bucket = np.concatenate(at)
    times = np.concatenate([c[a] for c, a in zip(counts, at, strict=True)]).astype(np.float32)
    sizes = np.array([len(a) for a in at])
    n = np.add.reduceat(times, starts)
    owner = np.repeat(np.arange(len(counts)), sizes)
    logs = log_p[:, bucket]  # languages x entries
    alone = np.add.reduceat(logs * times, starts, axis=1)  # languages x documents
    chosen = np.argsort(-alone, axis=0, kind="stable")[:candidates]  # candidates x documents
    picked = np.take_along_axis(logs, chosen[:, owner], axis=0)
    top = picked.max(axis=0)
    p = np.exp(picked - top)
    constant = np.add.reduceat(times * top, starts)

    def fit(share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            part = p * share[:, owner]
            part *= times / np.maximum(part.sum(axis=0), 1e-30)
            share = np.add.reduceat(part, starts, axis=1) / n
        mixed = np.log(np.maximum((p * share[:, owner]).sum(axis=0), 1e-30))
        return share, np.add.reduceat(mixed * times, starts) + constant

    k = len(chosen)
    share, _ = fit(np.full((k, len(counts)), 1 / k, np.float32), rounds)
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
    single = np.zeros_like(share)
    single[0] = 1  # candidates come by their likelihood alone
    best, best_score = single, np.take_along_axis(alone, chosen[:1], axis=0)[0]
    for size in range(2, min(most, k) + 1):
        start = np.where(rank < size, np.maximum(share, 1e-4), 0).astype(np.float32)
        fitted, likelihood = fit(start / start.sum(axis=0), rounds // 2)
        score = likelihood - weight * (size - 1) * np.log(np.maximum(n, 2)) / 2
        better = score > best_score
        best = np.where(better, fitted, best)
        best_score = np.where(better, score, best_score)
    return [(chosen[:, i], best[:, i]) for i in range(len(counts))]


def predict_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, mixture`` (languages with their shares, largest first).

    ``score`` is the share of the predicted language.  A text that is null or has no letter is ``und``
    with score 0, and so is every text if nothing could be learned.  Ids may be null or repeated, other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))  # BUCKETS numbers per language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, (languages, log_p) = Trigrams(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = [grams.counts(t.as_py()) if languages else None for t in part.column("text")]
                names, scores, mixed = [UNKNOWN] * len(counts), [0.0] * len(counts), [""] * len(counts)
                known = [i for i, c in enumerate(counts) if c is not None]
                if known:
                    for i, (which, share) in zip(known, mixtures([counts[i] for i in known], log_p), strict=True):
                        order = [j for j in np.argsort(-share, kind="stable") if share[j] > 0.005]
                        names[i], scores[i] = languages[which[order[0]]], float(min(1.0, share[order[0]]))
                        mixed[i] = ",".join(f"{languages[which[j]]}:{share[j]:.2f}" for j in order)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, pa.string())],
                    names=["doc_id", "lang_pred", "score", "mixture"],
                )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, mixture string")


def held_out(crc: Column, parts: int, part: int) -> Column:
    return F.pmod(crc, F.lit(parts)) == part
