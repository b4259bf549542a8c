"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import (decontam, hard_negatives, licenses, line_dedup, lm, near_vectors, packing, ranked_search, sharding, simhash,
               token_files, toxicity, urls)
from .common import fold, shared_folder, table
from .tokens import default_tokenizer

LLM_QUERIES: dict = {}
LLM_ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLE[name] = sql
        return fn
    return add


def ids_crc32(ids, width: int = 4):
    """crc32 of token ids as 32-bit little-endian integers, from a binary
    column of ids ``width`` bytes each."""
    if width == 4:
        return F.crc32(ids)

    @pandas_udf("long")
    def widened(x):
        import zlib

        import numpy as np
        import pandas as pd
        return pd.Series([zlib.crc32(np.frombuffer(b, f"<u{width}").astype("<u4")) for b in x], dtype="int64")
    return widened(ids)


@query("op1_nn_descent")
def op1(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op2_token_files")
def op2(spark, sf_dir):
    folder = token_files.new_folder(shared_folder(spark))
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, default_tokenizer(), end_id=2)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", ids_crc32(F.col("ids")).alias("ids_crc32"))


def toxicity_model(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    return toxicity.train(docs, labels)


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, docs, sf_dir)
    return (docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


@query("op4_kd_sharding")
def op4(spark, sf_dir):
    dims = {"length": F.log1p(F.octet_length(F.coalesce("text", F.lit("")))), "lang": sharding.spread(F.col("lang")), "source": sharding.spread(F.col("source"))}
    found = sharding.kd_shards(table(spark, sf_dir, "documents"), dims, n_shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_log_bilinear_lm")
def op5(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 7) == 2, F.lit(False)))


@query("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def packed(docs):
    pieces = packing.pack(docs, default_tokenizer(), end_id=0, window=1024)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op7_packing")
def op7(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


@query("op8_license_scan")
def op8(spark, sf_dir):
    """Documents as files ``source/lang/<block of 1000 ids>/<id>``; a text of
    under 400 characters lies one directory higher and, where it names a
    licence, is that directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    short = F.length(F.coalesce("text", F.lit(""))) < 400
    block = F.when(short, F.lit("")).otherwise(F.concat(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/")))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), block, F.col("doc_id").cast("string"))
    return licenses.scan_licenses(docs, path, short)


@query("op9_decontamination", decontam.ORACLE)
def op9(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op10_url_rules", urls.ORACLE)
def op10(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op11_line_dedup", line_dedup.ORACLE)
def op11(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=5, min_chars=40)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op12_hard_negatives", hard_negatives.ORACLE)
def op12(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op13_ranked_search", ranked_search.ORACLE)
def op13(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
