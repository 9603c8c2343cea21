"""The corpus pipeline: language, quality, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and is written and read again
before the next. All but the last return the columns of `documents`. Rows with null or empty texts are rejected by the
first stage; an empty table passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from texloom.llm import bpe, common, langid, minhash, mixing, quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what no learned language explains, texts without a letter among them."""
    common.small_batches(spark)
    return langid.accepted_rows(docs, *langid.learn(docs.filter(~langid.held_out())))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or reads unlike the rows labelled good."""
    common.small_batches(spark)
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, by shingles of five words at a similarity of 0.8."""
    common.small_batches(spark)
    return minhash.kept_rows(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources, languages and topics meet their target weights."""
    common.small_batches(spark)
    return mixing.drawn_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    common.small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language ID", language), ("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("mixing", mixture), ("byte-level BPE", tokens)]

#: Not expressible in SQL (learned models, min-wise hashing, merges); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
        if before is not None:
            common.drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
