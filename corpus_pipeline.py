"""A training-corpus pipeline: each stage's rows are written as Parquet and read again as the next stage's documents."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from timberline.llm._shared import delete, free_executors, shared_dir, write
from timberline.llm.defaults import TOKENIZER, held_out


def begins_freed(stage):
    """The stage, begun with executors that hold nothing of earlier stages: these leave a heap as large as they may have."""

    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_executors(spark)
        return stage(spark, docs, sf_dir)

    return begin


@begins_freed
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language_id.keep_identified(docs, language_id.fit(docs, train=~held_out()))


@begins_freed
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; so do documents that had nothing else. n_chars follows the text."""
    cleaned = line_dedup.remove(docs, line_dedup.boilerplate(docs), removed_col="__tl_removed").filter((F.col("__tl_removed") == 0) | (F.trim("text") != ""))
    return cleaned.withColumn("n_chars", F.when(F.col("__tl_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).drop("__tl_removed")


@begins_freed
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return minhash_dedup.keep_one(docs)


@begins_freed
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights: a document stays out, goes in or goes in twice."""
    return mixing.mix(docs)


@begins_freed
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids: one row a piece."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The classifier, the sampled signatures and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table. What a stage wrote is deleted once the next one stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        write(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
