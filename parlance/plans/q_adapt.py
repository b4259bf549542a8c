"""Registered queries for K (domain adaptation) and N (dataset distances).

Numeric matrix: ``embeddings`` (64 floats per row), source domain = label < 5.
Classification: the labelled document feature table (source = English,
target = other languages, label = toxic), with the target's group fold 0 held
out for testing.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from ..operators import adapt as ad
from ..operators import distance as dist
from ..operators import evaluate as ev
from ..operators import experiment as xp
from ..operators import linear as lin
from ..sources.tables import read
from . import boostsql as B
from . import distsql as DS
from . import featuretable as FT
from . import sqlparts as S
from .registry import query

r6 = S.r6
D = 64
EMB = ("emb AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features, label, "
       "CASE WHEN label < 5 THEN 0 ELSE 1 END AS domain FROM embeddings)")


def emb(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label",
                    F.when(F.col("label") < 5, 0).otherwise(1).alias("domain"))


def _block_sums(col, blocks):
    return [F.round(F.aggregate(F.slice(col, b * D + 1, D), F.lit(0.0), lambda a, x: a + x), 6).alias(f"s{b}")
            for b in range(blocks)]


def _block_sums_sql(layout):
    """layout: per block, 'x' or '0' for source and target rows."""
    cols = []
    for b, (s, t) in enumerate(layout):
        src = "list_sum(features)" if s == "x" else "0.0"
        tgt = "list_sum(features)" if t == "x" else "0.0"
        cols.append(f"{r6(f'CASE WHEN is_tgt THEN {tgt} ELSE {src} END')} AS s{b}")
    return ", ".join(cols)


@query("k01_joint_training_set", S.with_(f"lt AS ({FT.labelled_sql()})") + """
SELECT filename, domain FROM lt WHERE domain = 0 UNION ALL SELECT filename, domain FROM lt WHERE domain = 1 AND label = 1""")
def k01(spark, sf_dir):
    """Source rows ∪ a target training subset (here: the target positives)."""
    t = FT.labelled_table(spark, sf_dir).select("filename", "domain", "label")
    return ad.joint_training_set(ad.domain_only(t, 0), ad.domain_only(t, 1).filter("label = 1")).select(
        "filename", "domain")


@query("k02_source_target_only", S.with_(EMB) + """
SELECT domain, count(*) AS n FROM emb GROUP BY domain""")
def k02(spark, sf_dir):
    e = emb(spark, sf_dir)
    a = ad.domain_only(e, 0).agg(F.lit(0).alias("domain"), F.count("*").alias("n"))
    b = ad.domain_only(e, 1).agg(F.lit(1).alias("domain"), F.count("*").alias("n"))
    return a.unionByName(b)


@query("k03_feature_augmentation", S.with_(EMB) + ", e2 AS (SELECT *, domain = 1 AS is_tgt FROM emb) "
       f"SELECT vec_id, domain, {3 * D} AS n_aug, " + _block_sums_sql([("x", "x"), ("x", "0"), ("0", "x")])
       + " FROM e2")
def k03(spark, sf_dir):
    a = ad.augment(emb(spark, sf_dir), D)
    return a.select("vec_id", "domain", F.size("aug").alias("n_aug"), *_block_sums(F.col("aug"), 3))


EMB3 = EMB.replace("CASE WHEN label < 5 THEN 0 ELSE 1 END AS domain",
                   "CASE WHEN label < 3 THEN 0 WHEN label < 6 THEN 1 ELSE 2 END AS domain")


def emb3(spark, sf_dir):
    return emb(spark, sf_dir).withColumn(
        "domain", F.when(F.col("label") < 3, 0).when(F.col("label") < 6, 1).otherwise(2))


@query("k04_two_source_augmentation", S.with_(EMB3) + ", e2 AS (SELECT *, domain = 2 AS is_tgt FROM emb) "
       f"SELECT vec_id, domain, {4 * D} AS n_aug, "
       + _block_sums_sql([("x", "0"), ("x", "0"), ("0", "x"), ("x", "x")]) + " FROM e2")
def k04(spark, sf_dir):
    a = ad.augment_two_sources(emb3(spark, sf_dir), D)
    return a.select("vec_id", "domain", F.size("aug").alias("n_aug"), *_block_sums(F.col("aug"), 4))


@query("k05_n_source_augmentation", S.with_(EMB3) + f"""
SELECT vec_id, domain, {4 * D} AS n_aug, """ + ", ".join(
    f"{r6(f'CASE WHEN domain = {b} OR {b} = 3 THEN list_sum(features) ELSE 0.0 END')} AS s{b}" for b in range(4))
       + " FROM emb")
def k05(spark, sf_dir):
    a = ad.augment_n_sources(emb3(spark, sf_dir), D, 2)
    return a.select("vec_id", "domain", F.size("aug").alias("n_aug"), *_block_sums(F.col("aug"), 4))


@query("k24_dense_domains", """
WITH e AS (SELECT vec_id, 'corpus_' || CAST(label AS VARCHAR) AS corpus FROM embeddings)
SELECT vec_id, corpus, CAST(dense_rank() OVER (ORDER BY corpus) - 1 AS INTEGER) AS domain FROM e""")
def k24(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings", "vec_id", "label").select(
        "vec_id", F.concat(F.lit("corpus_"), F.col("label").cast("string")).alias("corpus"))
    return ad.dense_domains(e, "corpus").select("vec_id", "corpus", F.col("domain").cast("int"))


FEATS = [f"e{i}" for i in range(D)]
FMMD_SQL = S.with_(EMB) + f"""
, x AS (SELECT domain, unnest(features) AS v, unnest(range({D})) AS i FROM emb)
, m AS (SELECT i, avg(CASE WHEN domain = 0 THEN v END) - avg(CASE WHEN domain <> 0 THEN v END) AS delta FROM x GROUP BY i)
, nn AS (SELECT sqrt(sum(power(delta, 4))) AS norm FROM m)
SELECT 'e' || CAST(i AS VARCHAR) AS feature, {r6('delta')} AS delta,
  {r6('coalesce(power(delta, 2) / nullif(norm, 0), 0.0)')} AS weight FROM m, nn"""


def _emb_wide(spark, sf_dir):
    e = emb(spark, sf_dir)
    return e.select("domain", *[F.col("features")[i].alias(f) for i, f in enumerate(FEATS)])


@query("k07_fmmd_weights", FMMD_SQL)
def k07(spark, sf_dir):
    return ad.fmmd_weights(_emb_wide(spark, sf_dir), FEATS)


@query("k08_fmmd_threshold", f"""WITH w AS ({FMMD_SQL})
, g AS (SELECT *, lead(weight) OVER (ORDER BY weight, feature) - weight AS gap FROM w)
, cut AS (SELECT weight AS threshold FROM g ORDER BY gap DESC NULLS LAST, weight LIMIT 1)
SELECT feature, delta, weight, threshold, weight <= threshold AS keep FROM w, cut""")
def k08(spark, sf_dir):
    return ad.fmmd_threshold(ad.fmmd_weights(_emb_wide(spark, sf_dir), FEATS))


@query("k16_target_slices", S.with_(EMB) + """
, t AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM emb WHERE domain <> 0)
SELECT e.vec_id, e.domain, CASE WHEN t.r IS NOT NULL THEN CAST(least(floor(t.r / greatest(floor(t.n / 5), 1)), 4) AS INTEGER) END AS slice FROM emb e LEFT JOIN t ON e.vec_id = t.vec_id""")
def k16(spark, sf_dir):
    s = ad.target_slices(emb(spark, sf_dir), 5, key="vec_id")
    return s.select("vec_id", "domain", "slice")


# --- model-based (row-count checks only) -------------------------------------

def _doc_split(spark, sf_dir, vector=True):
    """Labelled documents with features (ML vector or array) and a group
    fold; test = target fold 0."""
    t = FT.labelled_table(spark, sf_dir)
    t = ev.group_kfold(t, 5)
    x = F.array(*[F.col(c) for c in FT.FEATURES])
    t = t.withColumn("features", array_to_vector(x) if vector else x)
    # Written once: every boosting round and every model fit reads it.
    t = cut_lineage(t)
    train = t.filter((F.col("domain") == 0) | (F.col("fold") != 0))
    test = t.filter((F.col("domain") == 1) & (F.col("fold") == 0))
    return train, test


ROUNDS = 45  # boosting rounds of the reference's experiments


@query("k09_k10_tradaboost")
def k09(spark, sf_dir):
    """K09 + K10: transfer boosting with weighted logistic regression, every
    round to convergence; predictions for the held-out target rows."""
    train, test = _doc_split(spark, sf_dir, vector=False)
    return lin.LinearTrAdaBoost(ROUNDS).fit(train).predict(test).select("filename", "label", "prediction")


@query("k17_sample_weights")
def k17(spark, sf_dir):
    train, _ = _doc_split(spark, sf_dir, vector=False)
    return lin.LinearTrAdaBoost(ROUNDS).fit(train).sample_weights(train).select("filename", "domain", F.col("_w").alias("weight"))


def _reg_split(spark, sf_dir):
    lab = F.log1p(F.col("n_tokens"))
    x = F.array(*[F.col(c) for c in FT.SHARES])
    return [t.withColumn("label", lab).withColumn("features", x) for t in _doc_split(spark, sf_dir, vector=False)]


@query("k11_k12_tradaboost_r2")
def k11(spark, sf_dir):
    """K11 + K12: regression transfer boosting (log token count from the POS
    shares), weighted-median prediction."""
    train, test = _reg_split(spark, sf_dir)
    return lin.LinearTrAdaBoost(ROUNDS, regression=True).fit(train).predict(test).select("filename", "label", "prediction")


def _rounds_table(spark, model):
    return spark.createDataFrame([(i, float(e), float(w)) for i, (e, w) in enumerate(zip(model.errors_, model.estimator_weights_))],
                                 "round int, error double, weight double")


@query("k13_adaboost_r2_fixed_source")
def k13(spark, sf_dir):
    train, _ = _reg_split(spark, sf_dir)
    return _rounds_table(spark, lin.LinearR2FixedSource(10).fit(train))


@query("k14_k15_two_stage_tradaboost_r2")
def k14(spark, sf_dir):
    """K14 with K15 (β search) and K16 (target-slice CV): 10 steps of 10
    rounds, 5 slices."""
    train, test = _reg_split(spark, sf_dir)
    return lin.LinearTwoStage(10, 10, cv=5).fit(train).predict(test).select("filename", "label", "prediction")


# The same operators on one feature of the embeddings, where every fit has a
# closed form or few enough Newton steps for SQL.

def _one_feature(spark, sf_dir, binary):
    y = F.col("features")[0] + F.col("features")[1]
    return emb(spark, sf_dir).select("vec_id", "domain", F.array(F.col("features")[0]).alias("features"),
                                     ((y > 0).cast("double") if binary else y).alias("label"))


@query("k09_k10_tradaboost_one_feature", B.tradaboost_sql(binary=True) + ", " + B.vote_sql() + "SELECT vec_id, prediction FROM vote")
def k09_one(spark, sf_dir):
    t = cut_lineage(_one_feature(spark, sf_dir, True))
    return lin.LinearTrAdaBoost(B.ROUNDS).fit(t).predict(t).select("vec_id", "prediction")


@query("k17_sample_weights_one_feature", B.tradaboost_sql(binary=True) + B.weights_sql())
def k17_one(spark, sf_dir):
    """Weights relative to their mean."""
    t = cut_lineage(_one_feature(spark, sf_dir, True))
    w = lin.LinearTrAdaBoost(B.ROUNDS).fit(t).sample_weights(t)
    n = t.count()
    return w.select("vec_id", "domain", F.round(F.col("_w") * n, 6).alias("weight"))


@query("k11_k12_r2_one_feature", B.tradaboost_sql(binary=False) + ", " + B.median_sql() + "SELECT vec_id, round(prediction, 6) AS prediction FROM med")
def k11_one(spark, sf_dir):
    t = cut_lineage(_one_feature(spark, sf_dir, False))
    p = lin.LinearTrAdaBoost(B.ROUNDS, regression=True).fit(t).predict(t)
    return p.select("vec_id", F.round("prediction", 6).alias("prediction"))


@query("k13_fixed_source_one_feature", B.fixed_source_sql() + "SELECT round, round(error, 6) AS error, round(weight, 6) AS weight FROM rounds")
def k13_one(spark, sf_dir):
    t = _rounds_table(spark, lin.LinearR2FixedSource(B.ROUNDS).fit(cut_lineage(_one_feature(spark, sf_dir, False))))
    return t.select("round", F.round("error", 6).alias("error"), F.round("weight", 6).alias("weight"))


@query("k21_logistic_one_feature", B.logistic_sql() + "SELECT vec_id, round(p, 6) AS probability FROM prob")
def k21_one(spark, sf_dir):
    t = cut_lineage(_one_feature(spark, sf_dir, True))
    model = lin.logistic_newton(t)
    return lin.with_values(t, model.probability, "p").select("vec_id", F.round("p", 6).alias("probability"))


K18_SEED = 7
BALANCED = """ev AS (SELECT doc_id AS filename, CAST(toxic AS INTEGER) AS label FROM labels),
cw AS (SELECT *, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)) AS w FROM ev),
placed AS (SELECT *, coalesce(sum(w) OVER (ORDER BY filename ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM cw)"""


@query("k18_weighted_bootstrap", S.with_(BALANCED) + f"""
, draws AS (SELECT i, CAST(('0x' || substr(md5('{K18_SEED}:' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0
    * (SELECT sum(w) FROM cw) AS u FROM (SELECT unnest(range((SELECT count(*) FROM cw))) AS i))
SELECT p.filename, p.label, count(*) AS n_drawn FROM draws ASOF JOIN placed p ON draws.u >= p.lo GROUP BY ALL""")
def k18(spark, sf_dir):
    """K18 with class-balance weights: rows drawn ∝ weight, exactly as many as
    there are; times each row was drawn."""
    t = ad.class_balance_weights(read(spark, sf_dir, "labels", "doc_id", "toxic").select(
        F.col("doc_id").alias("filename"), F.col("toxic").cast("int").alias("label")))
    return ad.bootstrap(t, "cw", "filename", seed=K18_SEED).groupBy("filename", "label").agg(F.count("*").alias("n_drawn"))


@query("k20_bootstrap_dispatch")
def k20_bootstrap(spark, sf_dir):
    """K20's branch for estimators without weights: target-like source rows
    (the final weights of K09) by bootstrap, then a plain logistic fit;
    predictions for the target."""
    t = FT.labelled_table(spark, sf_dir).withColumn("features", F.array(*[F.col(c) for c in FT.FEATURES]))
    t = cut_lineage(t.select("filename", "label", "domain", "features"))
    weighter = lambda d: lin.LinearTrAdaBoost(10).fit(d).sample_weights(d)
    est = ad.AdaptedEstimator(lambda n, w: ad.logistic(1.0, n), weighter=weighter, train_domains=(0, 1), bootstrap_key="filename", seed=K18_SEED)
    return est.fit(t).predict(t.filter("domain = 1")).select("filename", "label", "prediction")


@query("k19_check_sample_weight", "SELECT label, sum(w) AS weight_sum, count(*) AS n FROM (SELECT label, "
       "count(*) OVER () / (count(DISTINCT label) OVER () * count(*) OVER (PARTITION BY label)) AS w FROM ("
       + FT.labelled_sql() + ")) GROUP BY label")
def k19(spark, sf_dir):
    t = ad.class_balance_weights(FT.labelled_table(spark, sf_dir).select("filename", "label"))
    t = ad.check_sample_weight(t, "cw")
    return t.groupBy("label").agg(F.sum("cw").alias("weight_sum"), F.count("*").alias("n"))


@query("k06_k20_coral_dispatch")
def k06(spark, sf_dir):
    """K06 + K20: the dispatcher with a CORAL transform — fit a logistic
    regression on the aligned source, predict the standardised target."""
    t = FT.labelled_table(spark, sf_dir).withColumn("features", F.array(*[F.col(c) for c in FT.FEATURES]))
    t = t.select("filename", "label", "domain", "features")
    est = ad.AdaptedEstimator(lambda n, w: ad.logistic(1.0, n, weight_col=w), adapter=ad.Coral())
    return est.fit(t).predict(t.filter("domain = 1")).select("filename", "label", "prediction")


@query("k21_logistic_target_only")
def k21(spark, sf_dir):
    train, test = _doc_split(spark, sf_dir, vector=False)
    return lin.logistic_newton(ad.domain_only(train, 1)).transform(test).select("filename", "label", "prediction")


@query("k22_balanced_linear_svm")
def k22(spark, sf_dir):
    train, test = _doc_split(spark, sf_dir)
    tr = ad.class_balance_weights(train)
    return ad.margin_classifier(1.0, tr.count(), weight_col="cw").fit(tr).transform(test).select(
        "filename", "label", "prediction")


@query("k23_coral_regression")
def k23(spark, sf_dir):
    t = FT.labelled_table(spark, sf_dir).withColumn("features", F.array(*[F.col(c) for c in FT.SHARES]))
    t = t.withColumn("label", F.log1p("n_tokens"))
    moved = ad.Coral().fit(t).transform(t.select("filename", "label", "domain", "features"))
    v = moved.withColumn("features", array_to_vector("features"))
    model = ad.linear_regression().fit(v.filter("domain = 0"))
    pred = model.transform(v.filter("domain = 1"))
    return ev.regression_scores(pred)


# --- N ----------------------------------------------------------------------

@query("n01_cov_distance", S.with_(EMB) + f"""
, x AS (SELECT vec_id, domain, unnest(features) AS v, unnest(range({D})) AS i FROM emb)
, c AS (SELECT a.domain, a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id
        GROUP BY a.domain, a.i, b.i)
SELECT {r6('avg(abs(s.c - t.c))')} AS cov_distance FROM c s JOIN c t ON s.i = t.i AND s.j = t.j
WHERE s.domain = 0 AND t.domain = 1""")
def n01(spark, sf_dir):
    return spark.createDataFrame([(round(dist.cov_distance(emb(spark, sf_dir)), 6),)], "cov_distance double")


def _scalar(spark, name, value):
    return spark.createDataFrame([(float(value),)], f"{name} double")


def _six(value, name):
    return f"SELECT round(value, 6) AS {name} FROM ({value})"


@query("n02_frechet_distance", _six(DS.frechet(EMB, False), "frechet_distance"))
def n02(spark, sf_dir):
    return _scalar(spark, "frechet_distance", round(dist.frechet_distance(emb(spark, sf_dir)), 6))


@query("n03_linear_discrepancy")
def n03(spark, sf_dir):
    e = emb(spark, sf_dir)
    return spark.createDataFrame([(dist.linear_discrepancy(e), dist.linear_discrepancy(e, power_method=True))],
                                 "eigen double, power_method double")


@query("n03_power_method", _six(DS.power(EMB, False), "linear_discrepancy"))
def n03_power(spark, sf_dir):
    return _scalar(spark, "linear_discrepancy", round(dist.linear_discrepancy(emb(spark, sf_dir), power_method=True), 6))


@query("n04_normalized_linear_discrepancy")
def n04(spark, sf_dir):
    return _scalar(spark, "normalized_linear_discrepancy", dist.normalized_linear_discrepancy(emb(spark, sf_dir)))


@query("n04_normalized_power_method", _six(DS.power(EMB, True), "normalized_linear_discrepancy"))
def n04_power(spark, sf_dir):
    v = dist.normalized_linear_discrepancy(emb(spark, sf_dir), power_method=True)
    return _scalar(spark, "normalized_linear_discrepancy", round(v, 6))


@query("n05_normalized_frechet_distance", _six(DS.frechet(EMB, True), "normalized_frechet_distance"))
def n05(spark, sf_dir):
    return _scalar(spark, "normalized_frechet_distance", round(dist.normalized_frechet_distance(emb(spark, sf_dir)), 6))


@query("n06_neg_j_score")
def n06(spark, sf_dir):
    return _scalar(spark, "neg_j_score", dist.neg_j_score(emb(spark, sf_dir)))


@query("n07_domain_classifier")
def n07(spark, sf_dir):
    return _scalar(spark, "domain_classifier", dist.domain_classifier(emb(spark, sf_dir)))


@query("n08_reverse_validation")
def n08(spark, sf_dir):
    # class label: sign of the first embedding coordinate
    e = emb(spark, sf_dir).withColumn("label", (F.col("features")[0] > 0).cast("double"))
    return _scalar(spark, "reverse_validation", dist.reverse_validation(e))


@query("n09_adapted_distance")
def n09(spark, sf_dir):
    """Fréchet distance after CORAL alignment, sign-flipped."""
    e = emb(spark, sf_dir)
    return _scalar(spark, "score", dist.adapted_score(ad.Coral(), dist.frechet_distance, e))


# --- L08–L10: experiment grid ----------------------------------------------

def _grid_table(spark, sf_dir):
    """The labelled table with folds; two source corpora by participant group
    (a stand-in for two recording sites), the target is corpus 2."""
    t = ev.group_kfold(FT.labelled_table(spark, sf_dir), 5)
    corpus = F.when(F.col("domain") == 1, 2).otherwise(F.crc32(F.col("group_id").cast("binary")) % 2)
    return cut_lineage(t.withColumn("features", F.array(*[F.col(c) for c in FT.FEATURES])).withColumn("corpus", corpus.cast("int")))


@query("l08_l09_cv_grid")
def l08(spark, sf_dir):
    """Eight methods × logistic regression and four × balanced linear SVM,
    × 5 target folds."""
    return xp.run_grid(spark, _grid_table(spark, sf_dir), len(FT.FEATURES), methods=xp.ALL_METHODS, models=("lr", "svm"), parallelism=8, corpora=2)


# (positive, negative) participants of the source and of the target: equal
# classes, and the consistent shares of the reference's bias experiments.
# Fixed values.
SOURCE_MIXES = {"equal": (48, 48), "consistent_1": (72, 28), "consistent_2": (57, 43), "consistent_3": (42, 58), "consistent_4": (28, 72)}
TARGET_MIXES = {"equal": None, "consistent_1": (90, 35), "consistent_2": (75, 50), "consistent_3": (60, 65), "consistent_4": (35, 90)}


@query("l10_bias_settings")
def l10(spark, sf_dir):
    """Every logistic method under the equal and the four consistent cohort
    mixes (J13) of source and target, summarised across folds. All settings
    are flags of one table, so their fits share passes."""
    from ..operators import assemble as asm
    t = table = _grid_table(spark, sf_dir)
    src, tgt = [table.filter(F.col("domain") == k).select("filename", "group_id", "label") for k in (0, 1)]
    for name in SOURCE_MIXES:
        mix = asm.biased_cohort(src, "label", *SOURCE_MIXES[name]).unionByName(
            asm.biased_cohort(tgt, "label", *TARGET_MIXES[name]) if TARGET_MIXES[name] else tgt)
        flag = mix.select("filename", F.lit(1).alias(name)).distinct()
        t = t.join(flag, "filename", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    grid = xp.run_grid(spark, t, len(FT.FEATURES), methods=xp.ALL_METHODS, corpora=2, settings=tuple(SOURCE_MIXES))
    return xp.bias_summary(grid)
