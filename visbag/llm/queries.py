"""The operators as queries over the driver's tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, curriculum, decontaminate, html_extract, jaccard, language_model, licenses, media, merkle, quality, sharding, substring, trie
from .common import columns, table
from .oracles import ORACLES  # noqa: F401  beside QUERIES


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extracted(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = decontaminate.judged(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated",
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    out = substring.deduplicated(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def _held_out(docs: DataFrame, parts: int, part: int) -> DataFrame:
    """doc_id, text and held_out: the remainder of doc_id's CRC-32 (a null doc_id counts as an empty text)."""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return columns(docs, doc_id="bigint", text="string").withColumn("held_out", number % parts == part)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(_held_out(table(spark, sf_dir, "documents"), 7, 2))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _held_out(table(spark, sf_dir, "documents"), 5, 0)
    model = quality.fit(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffled_shards(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.copies(media.rendered(table(spark, sf_dir, "embeddings")))
    return found.withColumnRenamed("image_id", "vec_id")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.scheduled(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("first_position", F.round(F.expr("array_min(transform(passes, p -> p.position))"), 6))
    rows = rows.repartitionByRange("first_position", "source", "doc_id").sortWithinPartitions("first_position", "source", "doc_id")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered, merkle.lower_cased(F.col("text")))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_decontamination, op3_jaccard_join, op4_byte_bpe, op5_lm_score, op6_substring_dedup, op7_quality, op8_license_scan, op9_feistel_shards, op10_image_copies, op11_conversation_trie, op12_curriculum, op13_merkle_manifest)}
