"""Sets of word shingles, and the components that links between documents form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import stored, tasks_for

SHINGLE_WORDS = 5
# So many edges, in both directions, are worth a task of their own.
EDGES_PER_TASK = 10_000

# Odd factors of the hashes.
_BYTE_FACTOR = 0x9E3779B97F4A7C15
_WORD_FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([c + 33 if 65 <= c <= 90 else c + 1 for c in range(256)], np.uint64)


class Shingles:
    """Sets of word shingles as sorted 64-bit hashes.

    A word's hash is a polynomial over its bytes, taken as a difference of running sums, so that all words
    of a text are hashed in a few vector operations.  Long texts are hashed in pieces that end between words.
    """

    PIECE = 1 << 18

    def __init__(self, words: int = SHINGLE_WORDS) -> None:
        self.words = words
        self._power, self._inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, text: str) -> np.ndarray:
        found = self.all_of(text)
        found.sort()
        return found[np.append(True, found[1:] != found[:-1])] if len(found) else found

    def all_of(self, text: str) -> np.ndarray:
        """The hashes in order of the text, repeated ones too."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        found, start = [], 0
        while start < len(data):
            end = min(start + self.PIECE, len(data))
            while end < len(data):  # only A-Z, and only ASCII blanks, are special
                ahead = np.flatnonzero(_BLANK[data[end : end + self.PIECE]])
                end += int(ahead[0]) if len(ahead) else len(data[end : end + self.PIECE])
                if len(ahead):
                    break
            found.append(self._words(data[start:end]))
            start = end
        hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
        width = min(self.words, len(hashes))
        if not width:
            return hashes
        mixed = np.full(len(hashes) - width + 1, np.uint64(width))
        for i in range(width):
            mixed += hashes[i : len(hashes) - width + 1 + i] * np.uint64(_WORD_FACTORS[i % 5] + 2 * (i // 5))
        return mix64(mixed)

    def _words(self, data: np.ndarray) -> np.ndarray:
        while len(self._power) <= len(data):
            self._grow()
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_BLANK[data]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LOWER[data] * self._power[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))

    def _grow(self) -> None:
        n = len(self._power)
        inverse = pow(_BYTE_FACTOR, -1, 1 << 64)
        self._power = np.concatenate([self._power, self._power * np.uint64(pow(_BYTE_FACTOR, n, 1 << 64))])
        self._inverse = np.concatenate([self._inverse, self._inverse * np.uint64(pow(inverse, n, 1 << 64))])


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of the nodes of ``edges`` (``a, b``).

    Every node takes the smallest label around it and then the label of its label, until nothing
    changes.  Each round is written, labels are never collected.  Few edges are taken by few tasks: every task of
    every round writes a file.  ``edges`` are read twice, so they should be stored.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    tasks = tasks_for(both.sparkSession, 2 * edges.count(), EDGES_PER_TASK)
    both = stored(both.coalesce(tasks), "components-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = stored(labels.coalesce(tasks), "components")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        near = around.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        step = stored(step.coalesce(tasks), "components-step")
        of = step.select(F.col("node").alias("next"), F.col("next").alias("over"))
        jumped = step.join(of, "next", "left").select("node", "component", F.least("next", "over").alias("next"))
        jumped = stored(jumped.coalesce(tasks), "components")
        changed = jumped.where("component != next").limit(1).count()
        labels = jumped.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
