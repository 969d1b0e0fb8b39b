"""Quality rules: a decision list learned by sequential covering, applied as conditional expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import WORD, sampled_labels, stored, whole_text

LABEL_BOUND = 50_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits",
    "n_upper", "n_most_frequent", "n_same_as_last", "n_chars", "n_marks",
)
_STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)


def repeated_words(words: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more in the text.

    Windows get exact numbers by doubling: pairs of words, pairs of pairs, and so on.
    """
    names, step = words.astype(np.int64), 1
    if len(names) < width + 1:
        return 0
    while step < width:
        pairs = (names[: len(names) - step] << 32) | names[step:]
        names, step = np.unique(pairs, return_inverse=True)[1], step * 2
    twice = np.bincount(names)[names] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text, a row per document; null text counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                body = value.as_py()
                words = word.findall(body)
                lines = [line for line in body.split("\n") if word.search(line)]
                codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.empty(0, np.int64)
                often = np.bincount(codes) if words else np.zeros(1, np.int64)
                rows.append(
                    (
                        len(words), sum(map(len, words)), sum(body.count(s) for s in SYMBOLS), len(lines) - len(set(lines)),
                        repeated_words(codes), len(lines), int((often > 0).sum()), len(re.findall("[0-9]", body)),
                        sum(w[0].isupper() for w in words), int(often.max()), int((codes[1:] == codes[:-1]).sum()), len(body),
                        sum(w[-1] in ".!?,;:" for w in words),
                    )
                )
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _COUNTS]
            yield pa.record_batch(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *_COUNTS]
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(measure, _STATISTICS)


def features() -> dict[str, Column]:
    """What the rules look at, from the counts."""

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "digits_per_char": share("n_digits", "n_chars"),
        "upper_word_share": share("n_upper", "n_words"),
        "top_word_share": share("n_most_frequent", "n_words"),
        "same_as_last_share": share("n_same_as_last", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "marked_word_share": share("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def learn_rules(
    x: np.ndarray,
    bad: np.ndarray,
    names: list[str],
    part: np.ndarray,
    conditions: int = 4,
    cuts: int = 64,
    precision: float = 0.8,
    support: int = 5,
) -> list[Rule]:
    """An ordered list of conjunctions that tell bad rows, by sequential covering.

    A rule grows on two thirds of the rows (``part`` is not 0) by the threshold of most information
    gain, loses conditions at its end as long as that does not lower its worth on the other third, and
    is kept if it is right there often enough.  What it covers is taken away before the next one.
    """
    grow, prune = part != 0, part == 0
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while True:
        inside, chosen = left & grow, []
        if (bad & inside).sum() < support:
            return rules
        while len(chosen) < conditions and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            base, best = np.log2(p0 / (p0 + n0)), (0.0, None, None)
            for j, cut in enumerate(limits):
                values, is_bad = x[inside, j], bad[inside]
                at = np.searchsorted(cut, values, "left")  # values <= cut[at]
                p_below = np.cumsum(np.bincount(at[is_bad], minlength=len(cut) + 1))[: len(cut)]
                n_below = np.cumsum(np.bincount(at[~is_bad], minlength=len(cut) + 1))[: len(cut)]
                for above, p, n in ((False, p_below, n_below), (True, p0 - p_below, n0 - n_below)):
                    gain = np.where(p >= support, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0.0)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0] + 1e-9:
                        best = (float(gain[i]), Condition(names[j], above, float(cut[i])), j)
            if best[1] is None:
                break
            chosen.append(best[1:])
            inside &= _holds(x, best[1], best[2])
        if not chosen:
            return rules

        def worth(some: list) -> tuple[float, int, int]:
            rows = left & prune
            for condition, j in some:
                rows &= _holds(x, condition, j)
            p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        size = max(range(1, len(chosen) + 1), key=lambda k: (worth(chosen[:k])[0], -k))
        chosen = chosen[:size]
        _, p, n = worth(chosen)
        if p + n == 0 or p / (p + n) < precision:
            return rules
        covered = left.copy()
        for condition, j in chosen:
            covered &= _holds(x, condition, j)
        rules.append(tuple(c for c, _ in chosen))
        left &= ~covered


def _holds(x: np.ndarray, condition: Condition, j: int) -> np.ndarray:
    return x[:, j] > condition.limit if condition.above else x[:, j] <= condition.limit


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), 0 if none does: one conditional expression."""
    verdict = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        verdict = F.when(holds, i) if verdict is None else verdict.when(holds, i)
    return F.lit(0) if verdict is None else verdict.otherwise(0)


def rate_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABEL_BOUND, precision: float = 0.8
) -> tuple[DataFrame, list[Rule]]:
    """Statistics of all documents with ``base_failed``, ``rule`` and ``kept``, and the rules.

    The rules are learned from about ``bound`` labelled rows, chosen by a hash of the id.  Without
    labels of both kinds there are none, and only the base decides.  Null text has no words and fails
    the base.  Ids may be null or repeated, other columns are ignored, an empty table gives no rows.
    """
    rows = stored(text_statistics(docs), "quality-statistics")
    values = features()
    chosen = sampled_labels(labels, F.col(label).isin(0, 1), label, bound)
    # The labelled sample is bounded by a parameter, and so is what is fitted on the driver.
    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", *[v.alias(k) for k, v in values.items()]).toPandas()
    rules: list[Rule] = []
    if sample["label"].nunique() == 2:
        sample = sample.sort_values(["doc_id", *values], kind="stable")
        part = (sample["doc_id"].to_numpy(np.int64) * 2654435761 % 2**32 >> 16) % 3
        rules = learn_rules(sample[list(values)].to_numpy(float), sample["label"].to_numpy() == 0, list(values), part, precision=precision)
    rated = rows.select(*rows.columns, *[v.alias(f"__{k}") for k, v in values.items()])
    named = [tuple(Condition(f"__{c.feature}", c.above, c.limit) for c in rule) for rule in rules]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rated = rated.withColumns({"base_failed": failed, "rule": first_rule(named)})
    rated = rated.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return rated.select(*rows.columns, "base_failed", "rule", "kept"), rules
