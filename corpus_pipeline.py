"""Corpus pipeline: toxicity filter, SimHash near-dedup, benchmark
decontamination, packing. Each stage is written as Parquet and read again.

Nulls, empty texts, repeated rows, empty tables and extra columns are treated
as the operators' docstrings say; every stage but the last returns the
columns it was given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontam, simhash, toxicity
from parlance.llm.common import fresh, shared_folder, table
from parlance.llm.queries import packed, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier scores below 0.7; it learns from the
    labels of op3's training rows."""
    (score,) = fresh(docs, "toxicity_score")
    model = toxicity_model(spark, docs, sf_dir)
    return docs.withColumn(score, toxicity.score(F.col("text"), model, spark)).filter(F.col(score) < 0.7).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five words, containment 0.8)."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 1024 tokens."""
    return packed(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("packing", pack_sequences)]

ORACLE_SQL = None  # fingerprints, classifier and tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
