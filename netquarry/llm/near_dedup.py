"""Near-duplicate detection with b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import BATCH_ROWS, arrow_rows, keep_matching, stored, whole_text
from netquarry.llm.shingles import Shingles, connected_components, mix64
from netquarry.llm.signature_tree import first_links, full_sets, remaining_links

LEAST_PERCENT = 75
BANDS, ROWS_PER_BAND = 40, 5
HASHES = BANDS * ROWS_PER_BAND
BITS = 2
# Standard deviation of the estimate at 0.75 is 0.037 with 200 hashes of 2 bits; pairs five of them
# below the bound and less are not looked at.
MARGIN = 0.185
LONGS = -(-HASHES // 64)

_SKETCH = "doc_id long, n_shingles long, digest string, keys array<long>, planes array<long>"


def _factors() -> tuple[np.ndarray, np.ndarray]:
    drawn = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = drawn.astype(np.uint32)
    return low[:HASHES] | np.uint32(1), low[HASHES:]


def minima(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima of all hash functions, mixed so that their low bits are good ones."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    a, b = factors
    found = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(short), 1024):
        np.minimum(found, (short[at : at + 1024, None] * a + b).min(axis=0), out=found)
    return mix64(found.astype(np.uint64) + np.uint64(1))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    sets, factors = Shingles(), _factors()
    band = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        sizes, digests, keys, planes = [], [], [], []
        for text in batch.column("text"):
            shingles = sets.of(text.as_py())
            sizes.append(len(shingles))
            if not len(shingles):
                digests.append(None), keys.append(None), planes.append(None)
                continue
            digests.append(xxhash.xxh3_128_hexdigest(shingles.tobytes()))
            least = minima(shingles, factors)
            key = band.copy()
            for row in least.reshape(BANDS, ROWS_PER_BAND).T:
                key = mix64((key * np.uint64(0x9E3779B97F4A7C15)) ^ row)
            keys.append(key.view(np.int64))
            packed = np.zeros((BITS, LONGS * 64), np.uint8)
            for bit in range(BITS):
                packed[bit, :HASHES] = (least >> np.uint64(bit)) & np.uint64(1)
            planes.append(np.packbits(packed, axis=1).view(np.int64).ravel())
        yield pa.record_batch(
            [
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "digest", "keys", "planes"],
        )


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities of all pairs of two lists of packed signatures.

    Minima agree with probability J; those that do not have equal low bits by chance once in
    ``2**BITS``, for which the share of agreements is corrected.
    """
    wrong = np.zeros((len(left), len(right), LONGS), np.int64)
    for bit in range(BITS):
        plane = slice(bit * LONGS, (bit + 1) * LONGS)
        wrong |= left[:, None, plane] ^ right[None, :, plane]
    unlike = np.bitwise_count(wrong.view(np.uint64)).sum(axis=2)
    chance = 2.0**-BITS
    return (1 - unlike / HASHES - chance) / (1 - chance)


def _likely(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    return estimate(np.array(left, np.int64), np.array(right, np.int64)) >= LEAST_PERCENT / 100 - MARGIN


def _labelled(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their class, and the components of the classes that are linked."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    sketches = stored(rows.mapInArrow(_sketches, _SKETCH), "near-sketches")
    classes = sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    own = F.col("doc_id") == F.col("rep")
    classed = sketches.join(classes, "digest", "left").select(
        "doc_id", "n_shingles", "rep", F.when(own, F.col("keys")).alias("keys"), F.when(own, F.col("planes")).alias("planes")
    )
    classed = stored(classed, "near-classes")
    chosen = classed.where("keys is not null").dropDuplicates(["rep"])
    bands = chosen.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(bands.join(shared, "key"), "near-buckets")
    sets = full_sets(members, rows).join(chosen.select("rep", "planes"), "rep")
    sets = stored(sets, "near-sets")
    links = first_links(sets, LEAST_PERCENT, _likely)
    labels = connected_components(links)
    rest = remaining_links(members, sets, labels, LEAST_PERCENT, likely=_likely)
    if rest.limit(1).count():
        labels = connected_components(links.union(rest))
    return classed, labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per document.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles is at least
    0.75.  Equal sets are one class, represented by the smallest id.  Representatives get 200 minima;
    five of them make a band key, the low two bits of all of them the packed signature.  Documents that
    share a band key are candidates.  They meet in leaves of neighbouring documents, where the signatures'
    corrected estimate picks pairs to be confirmed on their full sets; pairs of one component are not
    compared, so a group of copies costs in proportion to its members, and all others are, whatever the
    size of a bucket.  A pair at exactly 0.75 shares no band with probability 2e-5.

    A text of fewer words is one shingle; null text or one without words has no shingles and is linked
    with nothing.  Rows of one id count as one document where links are followed, but each gets its row
    and count.  A null id is never a representative of others.  Other columns are ignored, an empty
    table gives no rows.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        classed, labels = _labelled(docs, doc_id, text)
    component = F.coalesce("component", "rep", "doc_id")
    return classed.join(labels, classed["rep"] == labels["node"], "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id").eqNullSafe(component), F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all columns."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return keep_matching(docs, {"doc_id": F.col("`doc_id`").cast("long")}, kept)
