"""Shared plan fragments: participant utterances, tokens, tagged tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import prep
from ..sources.tables import read


def conv_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prep.utterances_from_conversations(conv, roles=("user",))


def doc_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.utterances_from_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def conv_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.token_table(conv_utterances(spark, sf_dir))


def conv_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.tag_tokens(spark, conv_tokens(spark, sf_dir))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.token_table(doc_utterances(spark, sf_dir))


def doc_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.tag_tokens(spark, doc_tokens(spark, sf_dir))
