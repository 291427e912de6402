"""A training corpus from raw documents: quality, near copies, repeated passages, contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Rows whose doc_id is null go by their text in the second stage; of rows that share a doc_id that stage keeps one, the
first by text; texts may be null or empty (those without words stay). Columns other than those of ``documents`` are left
out. The first stage learns from the labels that its query learns from. The second removes the tables that its
join makes before it returns, and nothing else; stages and queries of one session do not touch one another.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visbag.llm import byte_bpe, decontaminate, jaccard, quality, substring
from visbag.llm.common import columns, materialised, passing, table

TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
LEAST_SCORE = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored LEAST_SCORE or more by the discriminant learned from the labelled ones."""
    docs = columns(docs, **TYPES)
    known = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = quality.fit(known, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("score") >= LEAST_SCORE).select(*TYPES)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join, the document with the smallest doc_id: shingles of five words, from 0.8."""
    docs = columns(docs, **TYPES)
    with passing(spark):  # the join's tables may be larger than its input; the names of what stays are small
        found = jaccard.joined(docs, jaccard.Join(words=5, over=4, under=5)).withColumn("unnamed", F.col("doc_id").isNull())
        first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("unnamed", "key")).alias("first")).select("first.*")
        stay = materialised(first.unionByName(found.where("n_shingles = 0").select("unnamed", "key")).distinct(), kind="stay")
    rows = docs.withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("unnamed", F.col("doc_id").isNull())
    order = Window.partitionBy("unnamed", "key").orderBy(F.col("text").asc_nulls_last(), *(c for c in TYPES if c not in ("doc_id", "text")))
    kept = rows.join(stay, ["unnamed", "key"], "left_semi").withColumn("nth", F.row_number().over(order))
    return kept.where("nth = 1").select(*TYPES)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start in an earlier document go; where none go, the text is left as it is."""
    out = substring.deduplicated(columns(docs, **TYPES), keep=tuple(TYPES))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*TYPES)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate.contamination(columns(docs, **TYPES), table(spark, sf_dir, "benchmark"), keep=tuple(TYPES))
    return decontaminate.judged(found).where("not contaminated").select(*TYPES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, one blank between), decoded_sha256 (of the bytes that the ids decode to)."""
    out = byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=False)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialised(docs, kind="stages")
    return docs
