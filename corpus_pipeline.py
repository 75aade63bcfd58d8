"""A cleaned and tokenised corpus from ``documents``: five stages, each written and read again.

1. quality classifier -- importance resampling; documents that aren't drawn go
2. near duplicates    -- n-gram Jaccard join over word shingles; the smallest
                         id of each group stays
3. decontamination    -- documents that hold a run of words of a benchmark item go
4. secrets            -- each secret that the scan reports becomes a mark
5. tokens             -- byte-level BPE ids of each text, checked by decoding

Each stage is a function of (spark, docs, sf_dir); all but the last return the
columns of ``documents``.  Clean documents pass the last four; the first is cut so
that it draws 99 % of the held-out good ones.  Rows with a null
text go with the first stage's undrawn ones or stay as they are; the last
stage gives them no tokens.  SQL can express neither the first nor the last
stage, so ``ORACLE_SQL`` is None and tests compare with brute force.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import byte_bpe, decontaminate, importance, jaccard_tree, secret_links
from ledgerlens.session import new_run_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by importance for the labelled good ones."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return importance.Sampler(docs, labels).keep()


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are not among those of ``gone`` (doc_id, text_hash)."""
    gone = gone.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("__hash")]
    return docs.select(F.struct(*docs.columns).alias("__row"), *keys).join(gone, ["__id", "__hash"], "left_anti").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by word shingles, the document of the smallest id (all rows that repeat it)."""
    found = jaccard_tree.join(docs)
    return _without(docs, found.filter(~F.col("component_id").eqNullSafe(F.col("doc_id"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of the benchmark."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    return _without(docs, decontaminate.hits(docs, benchmark).filter("n_hit > 0"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each reported secret is a mark, and n_chars the new length."""
    clean = secret_links.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and the digest of the decoded bytes."""
    import public_tokenizers
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written in the shared folder."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    folder = new_run_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
