"""Invariants of folds, augmentation, boosting and distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import adapt as ad
from parlance.operators import distance as dist
from parlance.operators import evaluate as ev

from .conftest import SF_SMALL


def _emb(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label",
                    F.when(F.col("label") < 5, 0).otherwise(1).alias("domain"))


def test_group_folds_disjoint(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}", i % 2) for i in range(60)], "filename int, group_id string, label int")
    for f in (ev.group_kfold(df, 5), ev.stratified_group_kfold(df, 5)):
        per_group = f.groupBy("group_id").agg(F.count_distinct("fold").alias("k")).collect()
        assert all(r["k"] == 1 for r in per_group)
        assert f.count() == 60


def test_k05_one_source_equals_k03_up_to_block_order(spark):
    e = _emb(spark).limit(50)
    a = {r["vec_id"]: r["aug"] for r in ad.augment(e, 64).collect()}
    b = {r["vec_id"]: r["aug"] for r in ad.augment_n_sources(e, 64, 1).collect()}
    for k, v in a.items():
        joint, src, tgt = v[:64], v[64:128], v[128:]
        w = b[k]
        assert w[:64] == src and w[64:128] == tgt and w[128:] == joint


def test_distances_zero_for_identical_domains(spark):
    e = _emb(spark).filter("domain = 0")
    both = e.unionByName(e.withColumn("domain", F.lit(1)))
    assert dist.cov_distance(both) == pytest.approx(0.0, abs=1e-12)
    assert dist.frechet_distance(both) == pytest.approx(0.0, abs=1e-6)
    assert dist.linear_discrepancy(both) == pytest.approx(0.0, abs=1e-9)


def test_frechet_matches_numpy(spark):
    e = _emb(spark)
    rows = e.collect()
    xs = np.array([r["features"] for r in rows if r["domain"] == 0])
    xt = np.array([r["features"] for r in rows if r["domain"] == 1])
    cs, ct = np.cov(xs, rowvar=False), np.cov(xt, rowvar=False)
    w, v = np.linalg.eigh(cs)
    r = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
    w2, v2 = np.linalg.eigh(r @ ct @ r)
    want = np.sum((xs.mean(0) - xt.mean(0)) ** 2) + np.trace(cs + ct) - 2 * np.sum(np.sqrt(np.clip(w2, 0, None)))
    assert dist.frechet_distance(e) == pytest.approx(want, rel=1e-6)


def test_tradaboost_weights_normalised(spark):
    from pyspark.ml.functions import array_to_vector
    e = _emb(spark).withColumn("label", (F.col("features")[0] > 0).cast("double"))
    e = e.withColumn("filename", F.col("vec_id")).withColumn("features", array_to_vector("features"))
    m = ad.TrAdaBoost(lambda n, w: ad.logistic(1.0, n, max_iter=20, weight_col=w), n_estimators=3).fit(e)
    assert m.sample_weights().agg(F.sum("_w")).first()[0] == pytest.approx(1.0)
    assert len(m.errors_) == 3
    pred = m.predict(e)
    assert pred.count() == e.count()


def test_fmmd_weights_unit_norm(spark):
    e = _emb(spark)
    wide = e.select("domain", *[F.col("features")[i].alias(f"e{i}") for i in range(64)])
    w = np.array([r["weight"] for r in ad.fmmd_weights(wide, [f"e{i}" for i in range(64)]).collect()])
    assert np.linalg.norm(w) == pytest.approx(1.0, abs=1e-4)
    kept = ad.fmmd_threshold(ad.fmmd_weights(wide, [f"e{i}" for i in range(64)])).filter("keep").count()
    assert 0 < kept <= 64


def test_coral_aligns_covariance(spark):
    e = _emb(spark)
    c = ad.Coral(lambda_=1e-6).fit(e)
    moved = c.transform(e)
    xs = np.array([r["features"] for r in moved.filter("domain = 0").collect()])
    xt = np.array([r["features"] for r in moved.filter("domain = 1").collect()])
    assert np.abs(np.cov(xs, rowvar=False) - np.cov(xt, rowvar=False)).mean() < 0.05


def test_adapted_estimator_dispatch(spark):
    e = _emb(spark).withColumn("label", (F.col("features")[0] > 0).cast("double"))
    make = lambda n, w: ad.logistic(1.0, n, max_iter=20, weight_col=w)
    by_transform = ad.AdaptedEstimator(make, adapter=ad.Coral()).fit(e)
    assert by_transform.predict(e.filter("domain = 1")).count() == e.filter("domain = 1").count()
    by_weight = ad.AdaptedEstimator(make, weighter=lambda d: d.withColumn("_w", F.lit(1.0))).fit(e)
    assert by_weight.predict(e).select("prediction").distinct().count() >= 1
    with pytest.raises(ValueError):
        ad.AdaptedEstimator(make)


def test_global_rank_and_prefix_sum_match_pandas(spark):
    import pandas as pd
    from parlance.functions.frames import global_rank, grouped_prefix_sum
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 500), "k": rng.permutation(500), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = {r["k"]: r["rank"] for r in global_rank(df, "k", partitions=5).collect()}
    assert got == {k: i for i, k in enumerate(sorted(pdf["k"]))}
    ranked = global_rank(df, ["g", "k"], partitions=6).toPandas().sort_values(["g", "k"])
    assert list(ranked["rank"]) == list(range(500))
    ps = grouped_prefix_sum(df, "g", "k", "v", partitions=6).toPandas().sort_values(["g", "k"])
    want = pdf.sort_values(["g", "k"]).groupby("g")["v"].transform(lambda s: s.cumsum() - s)
    assert list(ps["before"]) == list(want)
