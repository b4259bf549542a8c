"""The labelled document feature table shared by assembly, folds, adaptation
and evaluation queries (the stand-in for the reference's per-corpus feature
CSVs): documents are transcripts, ``labels.toxic`` is the diagnosis label,
``source`` the participant group and language the domain (English = source
domain, other languages = target domain)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.frames import cut_lineage
from ..operators import assemble as asm
from ..operators import lexical as lex
from ..operators import prep
from ..operators import similarity as sim
from ..sources.tables import read
from . import sqlparts as S

SHARES = [f"share_{t}" for t in lx.UNIVERSAL_TAGS]
FEATURES = (["n_tokens", "n_unique_tokens", "ttr", "mean_token_length"] + SHARES
            + ["maas", "hdd", "avg_cos_dist", "proportion_below_threshold_0_3"])


def doc_features(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The feature families joined on the transcript key. ``only``
    (a ``doc_id`` table) restricts the documents *before* any feature work —
    the join that follows in ``labelled_table`` would drop the rest anyway,
    and Catalyst cannot push a join below the aggregates by itself."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").filter("doc_id IS NOT NULL")  # the joins drop those without a key
    if only is not None:
        docs = cut_lineage(docs.join(only.select("doc_id").distinct(), "doc_id", "left_semi"))
    utts = prep.utterances_from_documents(docs)
    f123 = lex.text_profile(spark, utts)  # C01, C02, D10, C04 and D05, D07 in one pass
    f4 = sim.utterance_distances(spark, utts).select("filename", "avg_cos_dist", "proportion_below_threshold_0_3")
    return asm.join_features([f123, f4]).select("filename", *FEATURES)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels", "doc_id", "toxic", "quality")
    meta = read(spark, sf_dir, "documents", "doc_id", "lang", "source")
    return lab.join(meta, "doc_id").withColumnRenamed("doc_id", "filename")


def labelled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02 + J05–J07 + J10: features ⋈ cohort, label, group, domain, zero fill."""
    labelled = read(spark, sf_dir, "labels", "doc_id")
    t = asm.join_cohort(doc_features(spark, sf_dir, only=labelled), cohort(spark, sf_dir))
    t = t.withColumn("label", F.col("toxic").cast("int"))
    t = asm.group_key(t, "column", column="source")
    t = asm.domain_flag(t, F.col("lang") != "en")
    return cut_lineage(asm.coerce_numeric(t, FEATURES))


def _oracle(name):
    from .registry import ORACLE
    return ORACLE[name].replace(S.UTT_CONV, S.UTT_DOCS)


def features_sql() -> str:
    """Oracle text of ``doc_features`` (built from the per-family oracles)."""
    return (f"SELECT a.filename, a.n_tokens, a.n_unique_tokens, a.ttr, a.mean_token_length, "
            + ", ".join(f"b.{c}" for c in SHARES)
            + ", c.maas, c.hdd, d.avg_cos_dist, d.proportion_below_threshold_0_3 "
            + f"FROM ({_oracle('c01_c02_token_counts')}) a JOIN ({_oracle('c04_pos_shares')}) b ON a.filename = b.filename "
            + f"JOIN ({_oracle('d05_d07_maas_hdd')}) c ON a.filename = c.filename "
            + f"JOIN ({_oracle('h02_h05_distance_features_documents')}) d ON a.filename = d.filename")


def labelled_sql() -> str:
    fill = ", ".join(f"coalesce(CAST(f.{c} AS DOUBLE), 0.0) AS {c}" for c in FEATURES)
    return (f"SELECT f.filename, {fill}, l.toxic, l.quality, m.lang, m.source, CAST(l.toxic AS INTEGER) AS label, "
            "CAST(m.source AS VARCHAR) AS group_id, CASE WHEN m.lang <> 'en' THEN 1 ELSE 0 END AS domain "
            f"FROM ({features_sql()}) f JOIN labels l ON l.doc_id = f.filename JOIN documents m ON m.doc_id = f.filename")
