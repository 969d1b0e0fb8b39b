"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.session import work_folder

# The white space that separates words everywhere in this subpackage: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str = "text") -> Column:
    """The text, '' where it is null."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


# Whole texts go to Python so many rows at once.
BATCH_ROWS = 500

# Spark deletes the shuffle files of a query when it ends, and not when the driver's memory is next collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    Cuts the lineage: a lost executor costs a new read of the file and not a new computation, and
    what several consumers need is computed once.  What was shuffled for it is deleted with the write.
    """
    conf = df.sparkSession.conf
    path, before = work_folder(df.sparkSession, purpose), conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows in a batch for Python meanwhile: of whole texts, the usual 10,000 take much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Few rows are taken by few tasks, however many shuffle partitions there are: each task starts Python or writes a file."""
    return max(1, min(shuffle_partitions(spark), -(-rows // per_task)))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, whatever the case: ``wanted`` with underscores behind it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def keep_matching(docs: DataFrame, keys: dict[str, Column], kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key values occur in ``kept`` (columns named as in ``keys``).

    Nulls match nulls.  All columns of ``docs`` stay, whatever they are called.
    """
    names = {name: free_name(docs, f"__kept_{name}") for name in keys}
    right = kept.select(*[F.col(n).alias(alias) for n, alias in names.items()])
    condition: Column | None = None
    for name, value in keys.items():
        same = value.eqNullSafe(F.col(names[name]))
        condition = same if condition is None else condition & same
    return docs.join(right, condition, "left_semi")


def sampled_labels(labels: DataFrame, usable: Column, value: str, bound: int) -> DataFrame:
    """About ``bound`` of the usable labelled rows as ``doc_id``, ``label``, chosen by a hash of the id.

    All of them if there are no more than ``bound``.  The size of the result is bounded by the
    parameter, so it may be broadcast.
    """
    rows = labels.where(usable & F.col(value).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(value).cast("int").alias("label")
    )
    n = rows.count()
    if n > bound:
        share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
        rows = rows.where(share < int(bound / n * 1_000_000))
    return rows


def columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])
