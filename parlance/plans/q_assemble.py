"""Registered queries for J (feature-table assembly) and A08/A09/A12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as asm
from ..operators import lexical as lex
from ..operators import prep
from ..sources.tables import read
from . import featuretable as FT
from . import sqlparts as S
from . import transcripts as T
from .registry import query

r6 = S.r6
LT = f"lt AS ({FT.labelled_sql()})"


@query("j01_feature_join", FT.features_sql())
def j01(spark, sf_dir):
    return FT.doc_features(spark, sf_dir)


@query("j02_j10_labelled_feature_table", FT.labelled_sql())
def j02(spark, sf_dir):
    return FT.labelled_table(spark, sf_dir)


@query("j03_exclusion_list", """
SELECT d.doc_id AS filename, d.source FROM documents d
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def j03(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "source").withColumnRenamed("doc_id", "filename")
    excl = read(spark, sf_dir, "labels", "doc_id", "quality").filter("quality = 0").withColumnRenamed("doc_id", "filename")
    return asm.drop_listed(docs, excl)


@query("j04_cohort_filters", S.with_(LT) + """
SELECT filename, label, domain FROM lt WHERE label = 1 AND domain = 0""")
def j04(spark, sf_dir):
    t = FT.labelled_table(spark, sf_dir)
    return t.filter((F.col("label") == 1) & (F.col("domain") == 0)).select("filename", "label", "domain")


LABEL_RULES = {"en": "toxic", "fr": "toxic", "de": "quality", "es": "quality"}


@query("j05_label_rule", """
SELECT l.doc_id AS filename, m.lang, CAST(CASE """ + " ".join(
    f"WHEN m.lang = '{k}' THEN l.{v}" for k, v in LABEL_RULES.items()) + """ END AS INTEGER) AS label
FROM labels l JOIN documents m ON l.doc_id = m.doc_id""")
def j05(spark, sf_dir):
    lab = read(spark, sf_dir, "labels", "doc_id", "toxic", "quality")
    meta = read(spark, sf_dir, "documents", "doc_id", "lang")
    t = lab.join(meta, "doc_id").withColumnRenamed("doc_id", "filename")
    return asm.label_rule(t, "lang", LABEL_RULES).select("filename", "lang", "label")


@query("j06_group_key", "SELECT doc_id AS filename, substr(CAST(doc_id AS VARCHAR), 1, 3) AS group_id FROM documents")
def j06(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "filename")
    return asm.group_key(d, "prefix3")


@query("j07_domain_flag", "SELECT doc_id AS filename, CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS domain FROM documents")
def j07(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang").withColumnRenamed("doc_id", "filename")
    return asm.domain_flag(d, F.col("lang") != "en").select("filename", "domain")


@query("j08_prune_columns", S.with_(LT) + "SELECT * EXCLUDE (toxic, quality, lang, source) FROM lt")
def j08(spark, sf_dir):
    return asm.prune_columns(FT.labelled_table(spark, sf_dir), ["toxic", "quality", "lang", "source"])


@query("j12_participant_first", S.with_(LT) + """
SELECT filename, group_id, label FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY filename) AS rn FROM lt)
ORDER BY (rn > 1)::INTEGER, filename LIMIT 30""")
def j12(spark, sf_dir):
    return asm.participant_first(FT.labelled_table(spark, sf_dir), 30).select("filename", "group_id", "label")


@query("j13_biased_cohort", S.with_(LT) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY label, group_id ORDER BY filename) AS rn FROM lt)
(SELECT filename, group_id, label FROM r WHERE label = 1 ORDER BY (rn > 1)::INTEGER, filename LIMIT 20)
UNION ALL
(SELECT filename, group_id, label FROM r WHERE label = 0 ORDER BY (rn > 1)::INTEGER, filename LIMIT 20)""")
def j13(spark, sf_dir):
    return asm.biased_cohort(FT.labelled_table(spark, sf_dir), "label", 20, 20).select("filename", "group_id", "label")


FAMILIES = {"linguistic": FT.FEATURES[:-2], "semantic": FT.FEATURES[-2:]}


def _mix_sql(cond, corpus, domain, pos, neg):
    picks = [f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY filename) AS rn FROM lt WHERE {cond} AND label = {lab}) "
             f"ORDER BY (rn > 1)::INTEGER, filename LIMIT {n})" for lab, n in ((1, pos), (0, neg))]
    return f"SELECT *, {corpus} AS corpus, {domain} AS dom FROM ({' UNION ALL '.join(picks)})"


@query("j18_target_source", S.with_(LT) + ", u AS (" + _mix_sql("domain = 0 AND filename % 2 = 0", 0, 0, 12, 9) + " UNION ALL "
       + _mix_sql("domain = 0 AND filename % 2 = 1", 1, 0, 12, 9) + " UNION ALL " + _mix_sql("domain = 1", 2, 1, 15, 15) + f""")
SELECT filename, group_id, label, corpus, dom AS domain, {len(FAMILIES['linguistic'])} AS n_features,
  {r6(' + '.join(FAMILIES['linguistic']))} AS total FROM u""")
def j18(spark, sf_dir):
    """Two source corpora and a target, linguistic features only, biased
    cohorts of each."""
    t = FT.labelled_table(spark, sf_dir)
    source = F.col("domain") == 0
    even = F.col("filename") % 2 == 0
    got = asm.target_source(t, [source & even, source & ~even], ~source, asm.chosen_features(FAMILIES, (1, 0)), (12, 9), (15, 15))
    return got.select("filename", "group_id", "label", "corpus", "domain", F.size("features").alias("n_features"),
                      F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("j14_two_partitions", S.with_(LT) + """
SELECT 'control' AS part, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM lt WHERE domain = 0
UNION ALL SELECT 'other', count(*), CAST(sum(label) AS BIGINT) FROM lt WHERE NOT (domain = 0)""")
def j14(spark, sf_dir):
    a, b = asm.split_two(FT.labelled_table(spark, sf_dir), F.col("domain") == 0)

    def summ(df, name):
        return df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))
    return summ(a, "control").unionByName(summ(b, "other"))


POLY = ["ttr", "maas", "hdd"]


@query("j15_polynomial_terms", S.with_(LT) + "SELECT filename, " + ", ".join(
    f"{r6(f'{a} * {b}')} AS {('sqr_' if a == b else 'intr_') + a + '_' + b}"
    for i, a in enumerate(POLY) for b in POLY[i:]) + " FROM lt")
def j15(spark, sf_dir):
    t = asm.polynomial_terms(FT.labelled_table(spark, sf_dir).select("filename", *POLY), POLY)
    return t.select("filename", *[F.round(c, 6).alias(c) for c in t.columns if c.startswith(("sqr_", "intr_"))])


@query("j17_concat_a08_union", S.with_(S.UTT_CONV, S.TOK) + """
SELECT 'conversations' AS corpus, filename, count(*) AS n_tokens FROM tok GROUP BY filename
UNION ALL
SELECT 'documents', doc_id, len(regexp_extract_all(text, '""" + S.TOKEN_RE + """')) FROM documents""")
def j17(spark, sf_dir):
    a = T.conv_tokens(spark, sf_dir).groupBy("filename").agg(F.count("*").alias("n_tokens")).withColumn(
        "corpus", F.lit("conversations"))
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    b = d.select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("filename"),
                 F.size(prep.tx.tokens("text")).cast("bigint").alias("n_tokens"))
    return asm.concat(a, b).select("corpus", "filename", "n_tokens")


def _permuted_sql(ranked: str, seed: int) -> str:
    """(id, position) of ``ranked`` (id, r): six rounds on the cells of an
    a × b grid, again while the place lies beyond n."""
    def once(source):
        out = f"SELECT id, x // b AS l, x % b AS r, n, a, b FROM ({source})"
        for k in range(6):
            x, size = ("l", "b") if k % 2 else ("r", "a")
            mixed = f"CAST(('0x' || substr(md5('{seed}:{k}:' || CAST({x} AS VARCHAR)), 1, 13)) AS BIGINT) % {size}"
            new = f"l, (r + {mixed}) % b AS r" if k % 2 else f"(l + {mixed}) % a AS l, r"
            out = f"SELECT id, {new}, n, a, b FROM ({out})"
        return f"SELECT id, l * b + r AS x, n, a, b FROM ({out})"
    return f"""(WITH RECURSIVE s AS (SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS a FROM {ranked}),
    g AS (SELECT k.id, k.r AS x, s.n, s.a, CAST(ceil(s.n / s.a) AS BIGINT) AS b FROM {ranked} k, s),
    walk AS ({once('SELECT * FROM g')} UNION ALL {once('SELECT * FROM walk WHERE x >= n')})
  SELECT id, CASE WHEN n = 1 THEN 0 ELSE x END AS position FROM walk WHERE x < n OR n = 1)"""


@query("j11_seeded_permutation", """WITH k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents)
SELECT id AS filename, position FROM """ + _permuted_sql("k", 20))
def j11(spark, sf_dir):
    """Every document's place in a random order keyed by seed 20."""
    d = read(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "filename")
    return asm.seeded_permutation(d, "filename", 20).select("filename", "position")


@query("j17_concat_and_shuffle", """WITH u AS (SELECT 0 AS part, conv_id AS filename FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT 1, doc_id FROM labels),
k AS (SELECT (part, filename) AS id, row_number() OVER (ORDER BY part, filename) - 1 AS r FROM u)
SELECT id[1] AS part, id[2] AS filename, position FROM """ + _permuted_sql("k", 1))
def j17_shuffle(spark, sf_dir):
    """Transcripts and labelled documents stacked and shuffled as one set."""
    a = read(spark, sf_dir, "conversations", "conv_id").select(F.col("conv_id").alias("filename")).distinct()
    b = read(spark, sf_dir, "labels", "doc_id").select(F.col("doc_id").alias("filename"))
    return asm.concat_and_shuffle([a, b]).select("part", "filename", "position")


@query("a09_dedup_keep_first", """
WITH u AS (SELECT doc_id AS filename, 1 AS src_order, CAST(toxic AS VARCHAR) AS tag FROM labels
           UNION ALL SELECT doc_id, 2, lang FROM documents)
SELECT filename, src_order, tag FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY src_order) AS r FROM u)
WHERE r = 1""")
def a09(spark, sf_dir):
    a = read(spark, sf_dir, "labels", "doc_id", "toxic").select(
        F.col("doc_id").alias("filename"), F.lit(1).alias("src_order"), F.col("toxic").cast("string").alias("tag"))
    b = read(spark, sf_dir, "documents", "doc_id", "lang").select(
        F.col("doc_id").alias("filename"), F.lit(2).alias("src_order"), F.col("lang").alias("tag"))
    return asm.dedup_keep_first(asm.concat(a, b))


@query("a12_coverage_difference", """
SELECT doc_id AS filename FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def a12(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "filename")
    lab = read(spark, sf_dir, "labels", "doc_id").withColumnRenamed("doc_id", "filename")
    return asm.drop_listed(d, lab)


@query("j19_long_to_wide", S.with_(S.UTT_CONV, S.TOK, S.TAGGED) + """
, c AS (SELECT filename, upos, count(*) AS n FROM tagged GROUP BY filename, upos)
SELECT filename, """ + ", ".join(f"max(CASE WHEN upos = '{t}' THEN n END) AS \"{t}\"" for t in lex.lx.UNIVERSAL_TAGS)
       + " FROM c GROUP BY filename")
def j19(spark, sf_dir):
    c = T.conv_tagged(spark, sf_dir).groupBy("filename", "upos").agg(F.count("*").alias("n"))
    return asm.long_to_wide(c, "filename", "upos", "n", lex.lx.UNIVERSAL_TAGS)


@query("j20_composition_shares", S.with_(LT) + f"""
SELECT domain, count(*) AS n, {r6('count(*) / (SELECT count(*) FROM lt)')} AS row_share,
  {r6('avg(label)')} AS positive_share FROM lt GROUP BY domain""")
def j20(spark, sf_dir):
    return asm.composition_shares(FT.labelled_table(spark, sf_dir))


# The 25 timing columns chosen by name (not by position, Quirk 22).
TIMING_COLS = (["Vrate"] + [f"{s}dur{k}" for k in ("voiced", "unvoiced", "pause")
                            for s in ("avg", "std", "skw", "kurtosis", "max", "min")]
               + ["PVU", "PU", "UVU", "VVU", "VP", "UP"])


def _j09_sql():
    from .registry import ORACLE
    return f"SELECT filename, {', '.join(TIMING_COLS)} FROM ({ORACLE['i04_attach_ids']})"


@query("j09_named_column_slice", _j09_sql())
def j09(spark, sf_dir):
    from . import q_timing
    return q_timing.i04(spark, sf_dir).select("filename", *TIMING_COLS)
