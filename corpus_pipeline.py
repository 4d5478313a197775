"""The corpus pipeline: language, quality, near-duplicates, benchmark passages, packing.

Each stage works on all documents that the one before kept and is stored as Parquet in between. Sequences come
from the last stage; all others return documents with the columns they came with.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate, language, near_dup, packing, rules
from cohortloom.session import configure, materialise

ORACLE_SQL = None  # language models and the packing tokenizer are beyond SQL; tests compare with brute force


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; what looks like none of them goes."""
    configure(spark)
    return language.accepted(docs, language.fit(docs, ~language.held_out(F.col("doc_id"))))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current version of the quality rules."""
    configure(spark)
    return rules.accepted(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near-duplicates: five-word shingles, similarity 0.8."""
    configure(spark)
    return near_dup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark."""
    configure(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    configure(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True,
                        cached_pieces=100_000, slice_bytes=2 << 20)  # the workers still hold what earlier stages took


STAGES = [("language", known_language), ("quality", good_quality), ("near_duplicates", one_of_each),
          ("decontamination", without_benchmark), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
