"""Spelling variant grouping with pivotal grams.

Words one edit apart share a bigram that the edit did not touch.  Of every word's rarest bigrams two
that do not overlap are its pivots: one edit can touch only one of them, so the other one occurs in the
other word too, at most one place off, and among the rarest bigrams of the word whose rarest reach
further.  The edit lies on one side of it, so the word is the same on the other side.  Only such words
are looked up, by bigram, place, length and the side that is the same, and what meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import stored, whole_text

GRAM = 2
EDITS = 1
LEAST_LENGTH, LEAST_COUNT = 7, 2
OWN, OTHER = GRAM * EDITS + 1, 2 * GRAM * EDITS + 1
# A form is at least so many times as frequent as the word.
FORM_FACTOR = 10
DAMAGED_EVERY = 31
HELD_WORDS = 500_000
SHORT_LENGTH = 100

Batches = Iterator[pa.RecordBatch]

_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema(
    [
        ("pivot", pa.bool_()), ("key", pa.int64()), ("reach", pa.int32()), ("grams", pa.int64()),
        ("word", pa.string()), ("n", pa.int64()),
    ]
)
_KEYS_DDL = "pivot boolean, key long, reach int, grams long, word string, n long"


# ---- words ------------------------------------------------------------------------------------


def _counted(least: int, every: int) -> Callable[[Batches], Batches]:
    """Counts of the words of one task, let go when there are many."""
    run_of_letters = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")  # a shorter run gives no word

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_WORDS)

    def run(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                lower = text.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(run_of_letters.findall(lower)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = DAMAGED_EVERY) -> DataFrame:
    """``word, n``: the words of all texts that are long enough and occur often enough.

    A word is a run of letters, A to Z in lower case, with one letter deleted where the crc32 of
    ``<doc_id>:<run>`` is a multiple of ``every``.  A null id counts as ''.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc_id"), whole_text(text).alias("text")
    )
    counted = rows.mapInArrow(_counted(LEAST_LENGTH, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- pivots -----------------------------------------------------------------------------------


def pivots(grams: Sequence[tuple[int, int]], wanted: int, width: int = GRAM) -> list[tuple[int, int]]:
    """The ``wanted`` grams (place, weight) of least total weight of which no two overlap.

    ``best[k]`` is the cheapest choice of ``k`` grams that end before the present one starts; the grams
    are gone through by place, and each choice is let in once its last gram has ended.
    """
    best: list[tuple[int, list[tuple[int, int]]] | None] = [(0, [])] + [None] * wanted
    waiting: list[tuple[int, int, int, list[tuple[int, int]]]] = []
    for place, weight in sorted(grams):
        while waiting and waiting[0][0] <= place:
            _, k, cost, chosen = waiting.pop(0)
            if best[k] is None or cost < best[k][0]:
                best[k] = (cost, chosen)
        for k in range(wanted):
            if best[k] is not None:
                waiting.append((place + width, k + 1, best[k][0] + weight, [*best[k][1], (place, weight)]))
    for _, k, cost, chosen in waiting:
        if best[k] is None or cost < best[k][0]:
            best[k] = (cost, chosen)
    return best[wanted][1]


def _key(rank: int, place: int, length: int, left: bool, part: str) -> int:
    """Hash of a gram, where it is, and the part of the word to its left or right."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(f"{rank}:{place}:{length}:{left:d}:{part}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _look_ups(word: str, rank: int, place: int) -> list[int]:
    """Keys under which a word one edit away has the gram at ``place``, which the edit did not touch.

    A replaced letter leaves either side the same.  One inserted or deleted behind the gram leaves the
    left side and the place, one in front of it the right side, and moves the gram.
    """
    length, left, right = len(word), word[:place], word[place + GRAM :]
    found = [_key(rank, place, length, True, left), _key(rank, place, length, False, right)]
    for step in (1, -1):
        found.append(_key(rank, place, length + step, True, left))
        found.append(_key(rank, place + step, length + step, False, right))
    return found


def _keys(rank: dict[str, int], weight: dict[str, int]) -> Callable[[Batches], Batches]:
    """Index rows for the rarest grams of every word, and look-ups for its pivots.

    Of a gram that a word repeats the first ``OWN`` occurrences may become pivots, enough to hold disjoint
    ones.  One edit makes no more than ``GRAM * EDITS`` new grams, so they are among the first ``OTHER``
    occurrences of the other word.  ``grams`` is the set of all grams as 64 bits, of which one edit changes
    ``2 * GRAM`` at most.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                grams = sorted((rank[word[p : p + GRAM]], p) for p in range(len(word) - GRAM + 1))
                reach = grams[min(GRAM * EDITS, len(grams) - 1)][0]
                bits, prefix, times = 0, [], Counter()
                for r, p in grams:
                    bits |= 1 << (r & 63)
                    if r <= reach:
                        times[r] += 1
                        prefix.append((r, p, times[r]))
                bits -= (bits >> 63) << 64
                for r, p, k in prefix:
                    if k <= OTHER:
                        out.append((False, _key(r, p, len(word), True, word[:p]), reach, bits, word, n))
                        out.append((False, _key(r, p, len(word), False, word[p + GRAM :]), reach, bits, word, n))
                for p, _ in pivots([(p, weight[word[p : p + GRAM]]) for _, p, k in prefix if k <= OWN], EDITS + 1):
                    out += [(True, key, reach, bits, word, n) for key in _look_ups(word, rank[word[p : p + GRAM]], p)]
            columns = zip(*out, strict=True) if out else [[] for _ in _KEYS]
            yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(columns, _KEYS, strict=True)], schema=_KEYS)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, n_other``: all pairs of words (``word, n``) exactly one edit apart, both ways round.

    Of two words the one whose rarest grams reach less far is looked up by its pivots.  Bigrams are
    counted over all words; there are no more of them than pairs of letters, so their ranks travel
    with the tasks.
    """
    gram = F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda p: F.col("word").substr(p, F.lit(GRAM)))
    counted = words.select(F.explode(gram).alias("gram")).groupBy("gram").count().collect()
    weight = {r["gram"]: r["count"] for r in counted}
    rank = {g: k for k, (_, g) in enumerate(sorted((c, g) for g, c in weight.items()))}
    keys = stored(words.mapInArrow(_keys(rank, weight), _KEYS_DDL), "spelling-keys")
    index = keys.where("not pivot").drop("pivot")
    asked = keys.where("pivot").select(
        "key", F.col("reach").alias("reach_a"), F.col("grams").alias("grams_a"), F.col("word").alias("word_a"),
        F.col("n").alias("n_a"),
    )
    like = F.bit_count(F.col("grams").bitwiseXOR(F.col("grams_a"))) <= 2 * GRAM * EDITS
    other = (F.col("reach_a") <= F.col("reach")) & like & (F.col("word_a") != F.col("word"))
    # Spark's function takes quadratic time, so long words are compared by their common ends instead.
    short = F.length("word") <= SHORT_LENGTH
    met = stored(asked.join(index, "key").where(other & (~short | one_edit())), "spelling-met")
    pairs = ["word_a", "n_a", "word", "n"]
    met = met.where(short).select(*pairs).union(
        met.where(~short).select(*pairs).mapInArrow(_long_pairs, "word_a string, n_a long, word string, n long")
    )
    both = F.array(
        F.struct(F.col("word_a").alias("word"), F.col("word").alias("other"), F.col("n").alias("n_other")),
        F.struct(F.col("word").alias("word"), F.col("word_a").alias("other"), F.col("n_a").alias("n_other")),
    )
    return met.select(F.inline(both)).distinct()


def differ_by_one(a: str, b: str) -> bool:
    """Whether one code point was inserted, deleted or replaced; time grows with the length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # the length of the common start
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _long_pairs(batches: Batches) -> Batches:
    for batch in batches:
        near = [differ_by_one(a, b) for a, b in zip(batch.column("word_a").to_pylist(), batch.column("word").to_pylist(), strict=True)]
        yield batch.filter(pa.array(near, pa.bool_()))


def one_edit() -> Column:
    """Whether ``word`` and ``word_a`` differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein("word", "word_a", EDITS) == EDITS


# ---- forms and roots --------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: the end of the chain of forms.

    A form is ``FORM_FACTOR`` times as frequent as its word, so a chain is no longer than the digits of
    the largest count, and is halved in each turn.
    """
    chains = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(
            chains.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        chains = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return chains


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n, form, form_n, root, n_near``: every word of the vocabulary with the word it is a variant of.

    Two words are near if exactly one code point was inserted, deleted or replaced.  The form is the
    most frequent near word (of ties the smallest) if it is ten times as frequent, else null; the root is
    the end of the chain of forms, the word itself without one.  The result is exact.

    Null text has no words, a null id counts as ''.  Rows of one id count like those of different ones.
    Other columns are ignored, an empty table gives no rows.
    """
    words = stored(vocabulary(docs, doc_id, text), "spelling-words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other"))
    about = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(about, "word", "left")
    is_form = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    formed = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
