"""Registered queries for L (folds) and M (metrics and significance).

Evaluation input: labelled documents (label = toxic, participant group =
source) with two deterministic predictors read from the tables — A flags a
low-quality document, B flags a long one — so every metric has an exact
oracle. Model-based predictions are evaluated in the adaptation queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from ..operators import evaluate as ev
from ..operators import experiment as xp
from ..sources.tables import read
from . import featuretable as FT
from . import pvaluesql as P
from . import sqlparts as S
from .registry import ORACLE, query

r6 = S.r6
K = 5
LONG_DOC = 2000  # predictor B: n_chars above this

EV = f"""ev AS (SELECT l.doc_id AS filename, CAST(l.toxic AS INTEGER) AS label, d.source AS group_id, d.lang,
  d.n_chars, CAST(1 - l.quality AS INTEGER) AS pred_a, CASE WHEN d.n_chars > {LONG_DOC} THEN 1 ELSE 0 END AS pred_b
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def eval_input(spark, sf_dir):
    lab = read(spark, sf_dir, "labels", "doc_id", "toxic", "quality")
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars")
    j = lab.join(docs, "doc_id")
    return j.select(F.col("doc_id").alias("filename"), F.col("toxic").cast("int").alias("label"),
                    F.col("source").alias("group_id"), "lang", "n_chars",
                    (1 - F.col("quality")).cast("int").alias("pred_a"),
                    F.when(F.col("n_chars") > LONG_DOC, 1).otherwise(0).alias("pred_b"))


def _greedy_sql(size_table):
    """Recursive deal of (group_id, size, grank) to the lightest of K folds."""
    return f"""(WITH RECURSIVE deal AS (SELECT CAST(-1 AS BIGINT) AS grank, list_transform(range({K}), lambda x: CAST(0 AS BIGINT)) AS loads, 0 AS fold
  UNION ALL SELECT g.grank, list_transform(d.loads, lambda x, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN x + g.size ELSE x END),
    CAST(list_position(d.loads, list_min(d.loads)) - 1 AS INTEGER) FROM deal d JOIN {size_table} g ON g.grank = d.grank + 1)
  SELECT grank, fold FROM deal WHERE grank >= 0)"""


FOLDS = f"""gs AS (SELECT group_id, count(*) AS size FROM ev GROUP BY group_id),
gr AS (SELECT group_id, size, row_number() OVER (ORDER BY size DESC, group_id) - 1 AS grank FROM gs),
fo AS (SELECT ev.*, d.fold FROM ev JOIN gr ON ev.group_id = gr.group_id JOIN {_greedy_sql('gr')} d ON d.grank = gr.grank)"""


def folded(spark, sf_dir):
    return ev.group_kfold(eval_input(spark, sf_dir), K)


@query("l01_group_kfold", S.with_(EV, FOLDS) + "SELECT filename, group_id, fold FROM fo")
def l01(spark, sf_dir):
    return folded(spark, sf_dir).select("filename", "group_id", "fold")


@query("l02_stratified_group_kfold", S.with_(EV) + f"""
, gs AS (SELECT group_id, count(*) AS size, CASE WHEN count_if(label = 1) > count_if(label = 0) THEN 1 ELSE 0 END AS maj
         FROM ev GROUP BY group_id)
, gr AS (SELECT group_id, size, maj, row_number() OVER (PARTITION BY maj ORDER BY size DESC, group_id) - 1 AS grank FROM gs)
, g0 AS (SELECT * FROM gr WHERE maj = 0), g1 AS (SELECT * FROM gr WHERE maj = 1)
, fd AS (SELECT 0 AS maj, d.* FROM {_greedy_sql('g0')} d UNION ALL SELECT 1, d.* FROM {_greedy_sql('g1')} d)
SELECT ev.filename, ev.group_id, fd.fold FROM ev JOIN gr ON ev.group_id = gr.group_id JOIN fd ON fd.maj = gr.maj AND fd.grank = gr.grank""")
def l02(spark, sf_dir):
    return ev.stratified_group_kfold(eval_input(spark, sf_dir), K).select("filename", "group_id", "fold")


@query("l03_leave_one_out", S.with_(EV) + "SELECT filename, CAST(filename AS VARCHAR) AS fold FROM ev")
def l03(spark, sf_dir):
    return ev.leave_one_out(eval_input(spark, sf_dir)).select("filename", "fold")


@query("l04_holdout", S.with_(EV) + "SELECT filename, CASE WHEN lang <> 'en' THEN 0 ELSE -1 END AS fold FROM ev")
def l04(spark, sf_dir):
    e = eval_input(spark, sf_dir).withColumn("is_test", F.col("lang") != "en")
    return ev.holdout(e, "is_test", True).select("filename", "fold")


def _folds_of(cond):
    return f"""(WITH ev AS (SELECT * FROM ev0 WHERE {cond}), {FOLDS} SELECT filename, group_id, label, fold FROM fo)"""


@query("l05_paired_folds", "WITH " + EV.replace("ev AS (", "ev0 AS (", 1) + f"""
SELECT * FROM {_folds_of('label = 1')} UNION ALL SELECT * FROM {_folds_of('label = 0')}""")
def l05(spark, sf_dir):
    e = eval_input(spark, sf_dir)
    return ev.paired_folds(e.filter("label = 1"), e.filter("label = 0"), K).select(
        "filename", "group_id", "label", "fold")


@query("l06_leave_pairs_out", S.with_(EV) + """
, g AS (SELECT group_id, max(label) AS l FROM ev GROUP BY group_id)
, r AS (SELECT group_id, row_number() OVER (PARTITION BY l ORDER BY group_id) - 1 AS i FROM g)
, p AS (SELECT i FROM r GROUP BY i HAVING count(*) = 2)
SELECT ev.filename, ev.group_id, CAST(r.i AS INTEGER) AS fold FROM ev LEFT JOIN (SELECT * FROM r WHERE i IN (SELECT i FROM p)) r
  ON ev.group_id = r.group_id""")
def l06(spark, sf_dir):
    return ev.leave_pairs_out(eval_input(spark, sf_dir)).select("filename", "group_id", "fold")


MAJ = """fp AS (SELECT fold, group_id, arg_min(label, filename) AS pl FROM fo GROUP BY fold, group_id),
own AS (SELECT fold, count_if(pl = 0) AS o0, count_if(pl = 1) AS o1 FROM fp GROUP BY fold),
tot AS (SELECT count_if(pl = 0) AS t0, count_if(pl = 1) AS t1 FROM fp),
mode AS (SELECT fold, CASE WHEN t0 - o0 >= t1 - o1 THEN 0 ELSE 1 END AS prediction FROM own, tot),
mb AS (SELECT fo.fold, fo.label, mode.prediction FROM fo JOIN mode ON fo.fold = mode.fold)"""


def _scores_sql(src, pred, by="fold"):
    return f"""SELECT {by}, count(*) AS n, {r6('count_if(label = ' + pred + ') / count(*)')} AS acc,
  {r6(f'coalesce(2.0 * count_if(label = 1 AND {pred} = 1) / nullif(2 * count_if(label = 1 AND {pred} = 1) + count_if(label = 0 AND {pred} = 1) + count_if(label = 1 AND {pred} = 0), 0), 0.0)')} AS fms,
  {r6(f'(coalesce(2.0 * count_if(label = 1 AND {pred} = 1) / nullif(2 * count_if(label = 1 AND {pred} = 1) + count_if(label = 0 AND {pred} = 1) + count_if(label = 1 AND {pred} = 0), 0), 0.0) + coalesce(2.0 * count_if(label = 0 AND {pred} = 0) / nullif(2 * count_if(label = 0 AND {pred} = 0) + count_if(label = 1 AND {pred} = 0) + count_if(label = 0 AND {pred} = 1), 0), 0.0)) / 2')} AS macro_f1
FROM {src} GROUP BY {by}"""


@query("l07_majority_baseline", S.with_(EV, FOLDS, MAJ) + _scores_sql("mb", "prediction"))
def l07(spark, sf_dir):
    mb = ev.majority_baseline(folded(spark, sf_dir))
    return ev.binary_scores(mb, by=["fold"])


@query("m01_m03_fold_scores", S.with_(EV, FOLDS) + _scores_sql("fo", "pred_a"))
def m01(spark, sf_dir):
    return ev.binary_scores(folded(spark, sf_dir), pred_col="pred_a", by=["fold"])


def _report_sql():
    per = []
    for k, name in ((0, "non-AD"), (1, "AD")):
        prec = f"coalesce(count_if(label = {k} AND pred_a = {k}) / nullif(count_if(pred_a = {k}), 0), 0.0)"
        rec = f"coalesce(count_if(label = {k} AND pred_a = {k}) / nullif(count_if(label = {k}), 0), 0.0)"
        per.append(f"SELECT '{name}' AS class, {prec} AS precision, {rec} AS recall, "
                   f"coalesce(2 * ({prec}) * ({rec}) / nullif(({prec}) + ({rec}), 0), 0.0) AS f1, "
                   f"count_if(label = {k}) AS support FROM ev")
    return S.with_(EV) + ", per AS (" + " UNION ALL ".join(per) + """),
rep AS (SELECT * FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, count_if(label = pred_a) / count(*), count(*) FROM ev
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM per)
SELECT class, """ + f"{r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, " \
        "CAST(support AS BIGINT) AS support FROM rep"


@query("m04_classification_report", _report_sql())
def m04(spark, sf_dir):
    return ev.classification_report(eval_input(spark, sf_dir), pred_col="pred_a")


@query("m05_regression_scores", S.with_(EV) + """
, rg AS (SELECT ev.lang, ev.n_chars / 1000.0 AS y, len(string_split_regex(trim(text), '\\s+')) * 6 / 1000.0 AS p
  FROM ev JOIN documents d ON d.doc_id = ev.filename)
SELECT lang, """ + f"{r6('avg((y - p) * (y - p))')} AS mse, {r6('sqrt(avg((y - p) * (y - p)))')} AS rmse, "
       f"{r6('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2 FROM rg GROUP BY lang")
def m05(spark, sf_dir):
    """Regression scores of a simple estimate (6 characters per word) of the
    document length, per language."""
    e = eval_input(spark, sf_dir).join(read(spark, sf_dir, "documents", "doc_id", "text")
                                       .withColumnRenamed("doc_id", "filename"), "filename")
    r = e.select("lang", (F.col("n_chars") / 1000.0).alias("label"),
                 (F.size(F.split(F.trim("text"), r"\s+")) * 6 / 1000.0).alias("prediction"))
    return ev.regression_scores(r, by=["lang"])


SCORES2 = (f"sc AS (SELECT 'A' AS method, * FROM ({_scores_sql('fo', 'pred_a')}) UNION ALL "
           f"SELECT 'B', * FROM ({_scores_sql('fo', 'pred_b')}))")


def fold_scores_two(spark, sf_dir):
    f = folded(spark, sf_dir)
    a = ev.binary_scores(f, pred_col="pred_a", by=["fold"]).withColumn("method", F.lit("A"))
    b = ev.binary_scores(f, pred_col="pred_b", by=["fold"]).withColumn("method", F.lit("B"))
    return a.unionByName(b)


@query("m06_fold_summary", S.with_(EV, FOLDS, SCORES2) + f"""
SELECT method, count(*) AS n_folds, {r6('avg(acc)')} AS acc_mean, {r6('stddev_pop(acc)')} AS acc_std,
  {r6('avg(fms)')} AS fms_mean, {r6('stddev_pop(fms)')} AS fms_std FROM sc GROUP BY method""")
def m06(spark, sf_dir):
    return ev.fold_summary(fold_scores_two(spark, sf_dir), ["method"])


@query("m10_paired_t", S.with_(EV, FOLDS, SCORES2) + """
, j AS (SELECT a.fold, a.acc AS a_acc, b.acc AS b_acc, a.fms AS a_fms, b.fms AS b_fms
        FROM sc a JOIN sc b ON a.fold = b.fold AND a.method = 'A' AND b.method = 'B')
, m AS (SELECT 'acc' AS metric, a_acc - b_acc AS d, a_acc AS va, b_acc AS vb FROM j
        UNION ALL SELECT 'fms', a_fms - b_fms, a_fms, b_fms FROM j)
SELECT metric, count(*) AS n, """ + r6("avg(d)") + " AS mean_diff, " + r6("avg(d) / (stddev_samp(d) / sqrt(count(*)))")
       + """ AS t, count(*) - 1 AS df,
  CASE WHEN avg(va) > avg(vb) THEN 'greater' WHEN avg(va) < avg(vb) THEN 'less' ELSE 'two-sided' END AS alternative
FROM m GROUP BY metric""")
def m10(spark, sf_dir):
    return ev.paired_t(fold_scores_two(spark, sf_dir), "A", "B")


@query("m10_paired_t_pvalue", "SELECT *, round(" + P.t_directed("t", "CAST(df AS DOUBLE)", "alternative") + ", 6) AS p_value FROM (" + ORACLE["m10_paired_t"] + ")")
def m10p(spark, sf_dir):
    """M10 with its one-sided p-value (pandas UDF on the two result rows)."""
    return ev.with_t_pvalue(m10(spark, sf_dir), alt_col="alternative").withColumn("p_value", F.round("p_value", 6))


@query("m11_wilcoxon", S.with_(EV, FOLDS, SCORES2) + """
, j AS (SELECT a.acc AS a_acc, b.acc AS b_acc, a.fms AS a_fms, b.fms AS b_fms
        FROM sc a JOIN sc b ON a.fold = b.fold AND a.method = 'A' AND b.method = 'B')
, m AS (SELECT 'acc' AS metric, a_acc - b_acc AS d, a_acc AS va, b_acc AS vb FROM j
        UNION ALL SELECT 'fms', a_fms - b_fms, a_fms, b_fms FROM j)
, r AS (SELECT *, abs(d) AS a, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0 AS rk,
        row_number() OVER (PARTITION BY metric ORDER BY d = 0, abs(d)) - 1 AS bit FROM m)
, ties AS (SELECT metric, sum(c * c * c - c) AS ties FROM (SELECT metric, a, count(*) AS c FROM r GROUP BY metric, a) GROUP BY metric)
, s AS (SELECT metric, count(*) AS n, sum(CASE WHEN d > 0 THEN rk WHEN d = 0 THEN rk / 2 ELSE 0 END) AS w,
          coalesce(sum(CASE WHEN d = 0 THEN rk / 2 END), 0) AS split, count_if(d = 0) AS zeros, count_if(d <> 0) AS k,
          CASE WHEN avg(va) > avg(vb) THEN 'greater' WHEN avg(va) < avg(vb) THEN 'less' ELSE 'two-sided' END AS alternative FROM r GROUP BY metric)
, masks AS (SELECT metric, unnest(range(CAST(power(2, k) AS BIGINT))) AS mask FROM s)
, sums AS (SELECT x.metric, mask, coalesce(sum(CASE WHEN (mask >> bit) & 1 = 1 THEN rk END), 0) AS v FROM masks x LEFT JOIN r ON r.metric = x.metric AND r.d <> 0 GROUP BY x.metric, mask)
, ex AS (SELECT s.metric, avg(CASE WHEN v + split >= w - 1e-9 THEN 1.0 ELSE 0 END) AS g, avg(CASE WHEN v + split <= w + 1e-9 THEN 1.0 ELSE 0 END) AS l
         FROM sums JOIN s ON s.metric = sums.metric GROUP BY s.metric)
, nz AS (SELECT s.metric, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z, ties FROM s JOIN ties ON ties.metric = s.metric)
, ap AS (SELECT metric, """ + P.norm_sf("z") + " AS g, " + P.norm_sf("(-z)") + """ AS l FROM nz)
SELECT s.metric, CAST(n AS BIGINT) AS n, CAST(w AS DOUBLE) AS w, alternative,
  round(CASE WHEN ties = 0 AND zeros = 0 THEN """ + P.one_of("ex.g", "ex.l") + " ELSE " + P.one_of("ap.g", "ap.l") + """ END, 6) AS p_value,
  round(""" + P.one_of("ex.g", "ex.l") + """, 6) AS p_exact
FROM s JOIN ex ON ex.metric = s.metric JOIN ap ON ap.metric = s.metric JOIN ties ON ties.metric = s.metric""")
def m11(spark, sf_dir):
    t = ev.wilcoxon_table(fold_scores_two(spark, sf_dir), "A", "B")
    return t.select("metric", "n", "w", "alternative", F.round("p_value", 6).alias("p_value"), F.round("p_exact", 6).alias("p_exact"))


@query("m12_mcnemar", S.with_(EV) + f"""
SELECT count_if(pred_a = label AND pred_b <> label) AS b, count_if(pred_a <> label AND pred_b = label) AS c,
  {r6('coalesce(power(abs(count_if(pred_a = label AND pred_b <> label) - count_if(pred_a <> label AND pred_b = label)) - 1, 2) / nullif(count_if(pred_a = label AND pred_b <> label) + count_if(pred_a <> label AND pred_b = label), 0), 0.0)')} AS chi2
FROM ev""")
def m12(spark, sf_dir):
    return ev.mcnemar(eval_input(spark, sf_dir), a="pred_a", b="pred_b")


@query("m12_mcnemar_pvalue", "SELECT *, round(2 * (" + P.norm_sf("sqrt(chi2)") + "), 6) AS p_value FROM (" + ORACLE["m12_mcnemar"] + ")")
def m12p(spark, sf_dir):
    return ev.mcnemar_pvalue(m12(spark, sf_dir)).withColumn("p_value", F.round("p_value", 6))


# --- feature weights and Welch tests on the labelled feature table ---------

LT = f"lt AS ({FT.labelled_sql()})"
LONG = "lg AS (UNPIVOT (SELECT filename, label, domain, " + ", ".join(FT.FEATURES) + \
       " FROM lt) ON " + ", ".join(FT.FEATURES) + " INTO NAME feature VALUE value)"


def long_features(spark, sf_dir, table=None, keep=()):
    t = FT.labelled_table(spark, sf_dir) if table is None else table
    stack = "stack({}, {}) AS (feature, value)".format(
        len(FT.FEATURES), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in FT.FEATURES))
    return t.select("filename", "label", "domain", *keep, F.expr(stack))


def _welch_sql(src, where="TRUE"):
    return f"""SELECT feature, {r6('avg(CASE WHEN label = 1 THEN value END)')} AS mean_a,
  {r6('avg(CASE WHEN label = 0 THEN value END)')} AS mean_b,
  {r6('(avg(CASE WHEN label = 1 THEN value END) - avg(CASE WHEN label = 0 THEN value END)) / nullif(sqrt(var_samp(CASE WHEN label = 1 THEN value END) / count(CASE WHEN label = 1 THEN value END) + var_samp(CASE WHEN label = 0 THEN value END) / count(CASE WHEN label = 0 THEN value END)), 0)')} AS t,
  {r6('power(var_samp(CASE WHEN label = 1 THEN value END) / count(CASE WHEN label = 1 THEN value END) + var_samp(CASE WHEN label = 0 THEN value END) / count(CASE WHEN label = 0 THEN value END), 2) / nullif(power(var_samp(CASE WHEN label = 1 THEN value END) / count(CASE WHEN label = 1 THEN value END), 2) / (count(CASE WHEN label = 1 THEN value END) - 1) + power(var_samp(CASE WHEN label = 0 THEN value END) / count(CASE WHEN label = 0 THEN value END), 2) / (count(CASE WHEN label = 0 THEN value END) - 1), 0)')} AS df
FROM {src} WHERE {where} GROUP BY feature"""


@query("m09_welch_table", S.with_(LT, LONG) + _welch_sql("lg"))
def m09(spark, sf_dir):
    return ev.welch_table(long_features(spark, sf_dir), group_col="label")


@query("m09_welch_pvalue", "SELECT *, round(" + P.t_two_sided("t", "df") + ", 6) AS p_value FROM (" + ORACLE["m09_welch_table"] + ")")
def m09p(spark, sf_dir):
    return ev.with_t_pvalue(m09(spark, sf_dir)).withColumn("p_value", F.round("p_value", 6))


BLOCKS = ["joint", "source", "target"]


def block_weights(spark, sf_dir):
    """A coefficient array per corpus mix: Welch t of every feature on all
    rows (joint block), the source rows and the target rows, concatenated in
    block order — the layout of an augmented model's weights."""
    lf = long_features(spark, sf_dir)
    parts = [ev.welch_table(lf, group_col="label").withColumn("block", F.lit("joint")),
             ev.welch_table(lf.filter("domain = 0"), group_col="label").withColumn("block", F.lit("source")),
             ev.welch_table(lf.filter("domain = 1"), group_col="label").withColumn("block", F.lit("target"))]
    w = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = {f: i for i, f in enumerate(FT.FEATURES)}
    idx = F.create_map(*[x for f, i in order.items() for x in (F.lit(f), F.lit(i))])
    bidx = F.when(F.col("block") == "joint", 0).when(F.col("block") == "source", 1).otherwise(2)
    w = w.select((bidx * len(FT.FEATURES) + idx[F.col("feature")]).alias("pos"),
                 F.coalesce("t", F.lit(0.0)).alias("w"))
    return w.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]).alias("coefficients"))


def _block_weight_sql():
    parts = [f"SELECT '{b}' AS block, * FROM ({_welch_sql('lg', cond)})"
             for b, cond in (("joint", "TRUE"), ("source", "domain = 0"), ("target", "domain = 1"))]
    return "bw AS (" + " UNION ALL ".join(parts) + ")"


@query("m07_pivot_features", S.with_(LT, LONG, _block_weight_sql()) + """
, r AS (SELECT block, feature, coalesce(t, 0.0) AS weight,
  row_number() OVER (PARTITION BY block ORDER BY coalesce(t, 0.0) DESC, feature) AS top_rank,
  row_number() OVER (PARTITION BY block ORDER BY coalesce(t, 0.0), feature) AS bottom_rank FROM bw)
SELECT block, feature, """ + r6("weight") + " AS weight, top_rank, bottom_rank FROM r WHERE top_rank <= 5 OR bottom_rank <= 5")
def m07(spark, sf_dir):
    return ev.pivot_features(block_weights(spark, sf_dir), FT.FEATURES, BLOCKS, k=5)


FOLDS_LT = FOLDS.replace("FROM ev GROUP BY group_id", "FROM lt GROUP BY group_id").replace(
    "fo AS (SELECT ev.*", "fo AS (SELECT lt.*").replace("FROM ev JOIN gr ON ev.group_id", "FROM lt JOIN gr ON lt.group_id")


@query("m08_fold_averaged_weights", S.with_(LT, FOLDS_LT) + """
, lg AS (UNPIVOT (SELECT filename, label, fold, """ + ", ".join(FT.FEATURES) + " FROM fo) ON " + ", ".join(FT.FEATURES)
       + """ INTO NAME feature VALUE value)
, folds AS (SELECT DISTINCT fold FROM fo)
, tr AS (SELECT f.fold AS k, lg.* FROM folds f JOIN lg ON lg.fold <> f.fold)
, w AS (SELECT k, feature, (avg(CASE WHEN label = 1 THEN value END) - avg(CASE WHEN label = 0 THEN value END)) /
   nullif(sqrt(var_samp(CASE WHEN label = 1 THEN value END) / count(CASE WHEN label = 1 THEN value END) +
        var_samp(CASE WHEN label = 0 THEN value END) / count(CASE WHEN label = 0 THEN value END)), 0) AS weight
   FROM tr GROUP BY k, feature)
SELECT 'joint' AS block, feature, """ + r6("sum(coalesce(weight, 0.0)) / (SELECT count(*) FROM folds)")
       + " AS avg_weight FROM w GROUP BY feature")
def m08(spark, sf_dir):
    """Per fold k, the Welch t of each feature on the training side (fold != k),
    then averaged over folds. The training sides are expressed as totals
    minus the held-out fold's sums, so rows are never replicated per fold."""
    folded_table = ev.group_kfold(FT.labelled_table(spark, sf_dir), K)
    lf = long_features(spark, sf_dir, folded_table, keep=("fold",))
    weights = ev.training_side_welch(lf, "fold").withColumn("block", F.lit("joint"))
    return ev.averaged_weights(weights.select("fold", "block", "feature", F.coalesce("t", F.lit(0.0)).alias("weight")))


def _fitted_table(spark, sf_dir):
    t = ev.group_kfold(FT.labelled_table(spark, sf_dir), K)
    return cut_lineage(t.withColumn("features", F.array(*[F.col(c) for c in FT.FEATURES])))


def _fitted(spark, t):
    """(fold, coefficients): standardised weights of the augmented logistic
    model, trained on the source and the other target folds."""
    rows = [(k, [float(x) for x in w]) for k, w in xp.fitted_weights(t, len(FT.FEATURES))]
    return spark.createDataFrame(rows, "fold int, coefficients array<double>")


def _named(coefs):
    """(fold, block, feature, weight) of every coefficient."""
    w = ev.pivot_features(coefs, FT.FEATURES, BLOCKS, k=len(FT.FEATURES), by=["fold"])
    return w.select("fold", "block", "feature", "weight")


@query("m07_fitted_pivot_features")
def m07_fitted(spark, sf_dir):
    """Ten highest and lowest weights per block of every fold's augmented
    model."""
    return ev.pivot_features(_fitted(spark, _fitted_table(spark, sf_dir)), FT.FEATURES, BLOCKS, k=10, by=["fold"])


@query("m08_fitted_weights")
def m08_fitted(spark, sf_dir):
    return ev.averaged_weights(_named(_fitted(spark, _fitted_table(spark, sf_dir))))


@query("m13_ranked_significance")
def m13(spark, sf_dir):
    """Joint-block weights of the augmented models, averaged over the folds,
    joined with the features' Welch p-values, by weight."""
    t = _fitted_table(spark, sf_dir)
    w = ev.averaged_weights(_named(_fitted(spark, t))).filter("block = 'joint'").select("feature", F.col("avg_weight").alias("weight"))
    p = ev.with_t_pvalue(ev.welch_table(long_features(spark, sf_dir, t), group_col="label")).select("feature", F.round("p_value", 6).alias("p_value"))
    return ev.ranked_significance(w, p)


@query("j16_top_k_features", "SELECT feature, abs(t) AS weight FROM (" + S.with_(LT, LONG) + _welch_sql("lg")
       + ") WHERE t IS NOT NULL ORDER BY abs(t) DESC, feature LIMIT 10")
def j16(spark, sf_dir):
    """The 10 features with the largest |Welch t| between labels — a
    ranked weight table cut at k (a top-k report)."""
    from ..operators import assemble as asm
    w = m09(spark, sf_dir).filter(F.col("t").isNotNull()).select("feature", F.abs("t").alias("weight"))
    return asm.top_k_features(w, 10)
