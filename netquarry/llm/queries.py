"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.common import crc_of_id
from netquarry.llm.exact_dedup import exact_duplicates
from netquarry.llm.languages import learn_languages, predict_languages
from netquarry.llm.mixing import mix_sources
from netquarry.llm.near_dedup import near_duplicates
from netquarry.llm.packing import pack_documents
from netquarry.llm.quality_rules import rate_quality
from netquarry.llm.secret_scan import find_secrets
from netquarry.llm.sharding import shard_documents
from netquarry.llm.signature_tree import jaccard_components
from netquarry.llm.spelling import spelling_variants
from netquarry.llm.suffix_dedup import remove_repeats
from netquarry.llm.toxicity import THRESHOLD, learn_lexicon, score_toxicity
from netquarry.llm.turns import audit_conversations

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents"))


def op3_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    docs = table(spark, folder, "documents")
    model = learn_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = predict_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rated, _ = rate_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(docs, table(spark, folder, "labels").where(~held_out))
    score = F.col("__score")
    return score_toxicity(docs, lexicon).select(
        "doc_id", held_out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")
    )


def op6_label_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mix_sources(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents")).drop("n_chars")


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op11_signature_tree(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return audit_conversations(table(spark, folder, "conversations"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


_EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w < cap) * w, cap)) AS target
  FROM l),
c AS (
  SELECT d.*, source_size, target, CASE WHEN target < source_size THEN target ELSE target - source_size END AS budget,
         CASE WHEN target < source_size THEN 0 ELSE 1 END AS base,
         sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (base + CASE WHEN 2 * (budget - (upto - size)) >= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_secret_scan,
        op3_language_mixture,
        op4_quality_rules,
        op5_toxicity,
        op6_label_sharding,
        op7_suffix_dedup,
        op8_source_mixing,
        op9_exact_dedup,
        op10_near_dedup,
        op11_signature_tree,
        op12_conversation_repair,
        op13_spelling_variants,
    )
}

_SQL = {"op8_source_mixing": _MIX_SQL, "op9_exact_dedup": _EXACT_SQL}


def llm_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(_SQL)
