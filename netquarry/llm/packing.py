"""Best-fit packing of tokenised documents into sequences, under several capacities at once."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import BATCH_ROWS, arrow_rows, stored, whole_text

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
END_ID = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of a byte-level vocabulary.

    ``tokenizers`` encodes 1.8 MB a second and core here and ``tiktoken`` 7.9 MB with the same
    vocabulary and the same ids, so the latter does the work.  A few texts it refuses (its pattern
    engine gives up on a million blanks in a row); those go to ``tokenizers``.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self._fast = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
        )
        self._path = public_tokenizers.path(f"{vocabulary}.json")
        self._plain = None

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self._fast.encode(text, allowed_special="all"), dtype="<u4")
        except ValueError:
            if self._plain is None:
                from tokenizers import Tokenizer

                self._plain = Tokenizer.from_file(self._path)
            return np.asarray(self._plain.encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_pieces(
    docs: DataFrame,
    capacity: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids; each document ends with the end id.

    Only a longer document is cut; all its pieces but the first are full.  Null text is the empty
    text, which is the end id alone.  ``with_ids`` adds the ids themselves.
    """
    schema = _PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            found: list[tuple] = []
            for key, value in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = np.append(encoder.ids(value), np.array([END_ID], "<u4")).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for i, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[start:end]
                    row = (key, i, start, end - start, zlib.crc32(part.tobytes()))
                    found.append((*row, part.astype("int32")) if with_ids else row)
                if len(found) > 50_000:
                    yield as_frame(found)
                    found = []
            yield as_frame(found)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def as_frame(found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=names)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    # Ids travel as text: a null among numbers would turn the others into floats.
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(text).alias("text"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from cut(b.assign(doc_id=[None if x is None else int(x) for x in b["doc_id"]]) for b in batches)

    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(exact, schema)


def vector_best_fit(
    lengths: np.ndarray,
    capacity: int,
    most_documents: int,
    most_attention: int,
    weights: tuple[float, float, float],
    rule: str,
) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every piece, and its place in it, by vector best fit.

    A piece asks for its tokens, one document, and the square of its tokens in attention.  Pieces come
    in order of falling demand.  Of the open bins that have room in all three dimensions the one is
    taken whose weighted residual after the piece has the smallest norm (``rule="norm"``), or whose
    residual is matched best by the piece, by weighted dot product over the residual's squared norm
    (``rule="dot"``); a new bin if there is none.
    """
    whole = np.array([capacity, most_documents, most_attention], dtype=np.float64)
    scale = np.sqrt(np.asarray(weights, dtype=np.float64)) / whole
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((3, max(1, len(lengths))))  # residuals of open bins
    number = np.empty(max(1, len(lengths)), np.int64)
    n_open, n_bins, smallest = 0, 0, int(lengths.min()) if len(lengths) else 0
    for i in order:
        size = int(lengths[i])
        demand = np.array([size, 1.0, float(size) * size])
        chosen = -1
        if n_open:
            rest = room[:, :n_open] - demand[:, None]
            fits = np.flatnonzero((rest >= 0).all(axis=0))
            if len(fits):
                if rule == "norm":
                    score = ((rest[:, fits] * scale[:, None]) ** 2).sum(axis=0)
                else:
                    space = room[:, fits] * scale[:, None]
                    score = -(space * (demand * scale)[:, None]).sum(axis=0) / np.maximum((space**2).sum(axis=0), 1e-30)
                chosen = int(fits[np.argmin(score)])
        if chosen < 0:
            if (demand > whole).any():
                raise ValueError("a piece asks for more than a whole sequence has")
            chosen, n_open = n_open, n_open + 1
            room[:, chosen], number[chosen] = whole, n_bins
            n_bins += 1
        bins[i], offsets[i] = number[chosen], capacity - int(room[0, chosen])
        room[:, chosen] -= demand
        if room[0, chosen] < smallest or room[1, chosen] < 1:
            n_open -= 1  # closed: nothing fits any more
            room[:, chosen], number[chosen] = room[:, n_open], number[n_open]
    return bins, offsets


def pack(
    pieces: DataFrame,
    capacity: int = 1024,
    most_documents: int = 1024,
    most_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1 / 64, 1 / 64),
    rule: str = "norm",
    group_rows: int = 8192,
    fill: float = 0.98,
    rounds: int = 3,
) -> DataFrame:
    """``pieces`` (of ``token_pieces``, stored) with ``sequence_id`` and ``offset``.

    Pieces are dealt by hash into groups of about ``group_rows`` and each group is packed by itself.
    Sequences filled to ``fill`` are done; the pieces of all others meet those of other groups in the
    next round, so that the loss is that of a few groups and not of all.  The default limits on
    documents and on attention, ``capacity`` squared, never bind; smaller ones do.
    """
    most_attention = capacity * capacity if most_attention is None else most_attention
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    columns = pieces.columns
    full = F.col("length") == capacity
    whole = pieces.where(full).withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 8 + 7, "offset": F.lit(0).cast("long")}
    )
    rest = pieces.where(~full)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", __group long, __bin long, offset long, __fill double"
    done = [whole]
    for turn in range(rounds):
        n = rest.count()
        groups = max(1, -(-n // group_rows))
        last = turn == rounds - 1 or groups == 1

        def one_group(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable")
            lengths = frame["length"].to_numpy(np.int64)
            bins, offsets = vector_best_fit(lengths, capacity, most_documents, most_attention, weights, rule)
            filled = np.bincount(bins, lengths) / capacity
            return frame.assign(__bin=bins, offset=offsets, __fill=filled[bins])

        # The row's number spreads repeated rows; it is that of a row in a written file, so a retry agrees.
        row = F.monotonically_increasing_id()
        group = F.pmod(F.xxhash64("doc_id", "piece", row, F.lit(turn)), F.lit(groups)).cast("long")
        packed = rest.withColumn("__group", group).groupBy("__group").applyInPandas(one_group, schema)
        packed = stored(packed, f"packing-{turn}")
        keep = F.lit(True) if last else F.col("__fill") >= fill
        # Rounds, groups and bins make the number; full pieces have those that end in 7.
        sequence = (F.col("__group") * F.lit(group_rows * 8) + F.col("__bin")) * 8 + turn
        done.append(packed.where(keep).withColumn("sequence_id", sequence).select(*columns, "sequence_id", "offset"))
        if last:
            break
        rest = packed.where(~keep).select(*columns)
    out = done[0].select(*columns, "sequence_id", "offset")
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``.

    Result per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  Null text is
    the empty text, repeated rows are packed as often as they come, other columns are ignored, an
    empty table gives no rows.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        pieces = stored(token_pieces(docs, capacity), "token-pieces")
    return pack(pieces, capacity, **options)


def packed_sequences(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids, doc_ids, starts``; a group has ``capacity`` ids at most."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        pieces = stored(token_pieces(docs, capacity, with_ids=True), "token-pieces")
    packed = pack(pieces, capacity, **options)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.col("parts.ids")).alias("ids"),
            F.col("parts.doc_id").alias("doc_ids"),
            F.col("parts.offset").alias("starts"),
        )
    )
