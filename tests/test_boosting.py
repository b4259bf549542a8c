"""Transfer boosting against plain numpy, with a closed-form base
learner (a weighted mean per value of one integer feature)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import adapt

EPS = np.finfo(float).eps


class CellMean:
    """Base learner: predicts the weighted mean label of the row's cell."""

    def __init__(self, weight):
        self.weight = weight

    def fit(self, df):
        rows = df.groupBy("x").agg((F.sum(F.col(self.weight) * F.col("label")) / F.sum(self.weight)).alias("m")).collect()
        means = {r["x"]: r["m"] for r in rows}

        class Fitted:
            def transform(self, d):
                e = F.lit(0.0)
                for x, m in means.items():
                    e = F.when(F.col("x") == x, m).otherwise(e)
                return d.withColumn("prediction", e)
        return Fitted()


def make(n, weight):
    return CellMean(weight)


def cell_mean(x, y, w):
    means = {v: np.sum(w[x == v] * y[x == v]) / np.sum(w[x == v]) for v in set(x)}
    return lambda z: np.array([means.get(v, 0.0) for v in z])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 24
    x, dom = rng.integers(0, 3, n), (np.arange(n) >= 14).astype(int)
    y = np.round(x * 0.4 + dom * 0.3 + rng.random(n), 3)
    rows = [(i, int(dom[i]), int(x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "filename int, domain int, x int, label double"), x, dom, y


def median(preds, weights):
    start = len(preds) // 2
    p, w = np.array(preds[start:]), np.array(weights[start:])
    out = []
    for col in p.T:
        o = np.argsort(col, kind="stable")
        out.append(col[o][np.searchsorted(np.cumsum(w[o]), 0.5 * w.sum() - 1e-12)])
    return np.array(out)


def model_weights(errors):
    return [-np.log(e / (2 - e) + EPS) + 2 * EPS for e in errors]


def tradaboost(x, dom, y, rounds, regression):
    n, src = len(y), dom == 0
    w = np.full(n, 1 / n)
    beta_s = 1 / (1 + np.sqrt(2 * np.log(src.sum()) / rounds))
    errors, preds = [], []
    for i in range(rounds):
        p = cell_mean(x, y, w)(x)
        err = np.abs(p - y)
        if regression:
            err = err / (err.max() + EPS)
        e = np.sum(w[~src] * err[~src]) / np.sum(w[~src])
        errors.append(e)
        preds.append(p)
        if i < rounds - 1:
            w = np.where(src, w * beta_s ** err, w * (e / (2 - e)) ** -err)
            w = w / w.sum()
    return w, errors, preds


def by_key(df, col):
    return np.array([r[col] for r in df.orderBy("filename").select(col).collect()])


def test_tradaboost_matches_numpy(data):
    df, x, dom, y = data
    y01 = (y > 0.9).astype(float)
    d01 = df.withColumn("label", (F.col("label") > 0.9).cast("double"))
    m = adapt.TrAdaBoost(make, n_estimators=7).fit(d01)
    w, errors, preds = tradaboost(x, dom, y01, 7, False)
    assert np.allclose(m.errors_, errors) and np.allclose(by_key(m.sample_weights(), "_w"), w)
    a = np.array(model_weights(errors)[3:])
    p = np.array(preds[3:])
    vote = (a @ p > a @ (1 - p)).astype(int)
    assert (by_key(m.predict(d01), "prediction") == vote).all()


def test_tradaboost_r2_matches_numpy(data):
    df, x, dom, y = data
    m = adapt.TrAdaBoost(make, n_estimators=7, regression=True).fit(df)
    w, errors, preds = tradaboost(x, dom, y, 7, True)
    assert np.allclose(m.errors_, errors) and np.allclose(by_key(m.sample_weights(), "_w"), w)
    assert np.allclose(by_key(m.predict(df), "prediction"), median(preds, model_weights(errors)))


def test_prediction_keeps_repeated_keys(data):
    df, *_ = data
    m = adapt.TrAdaBoost(make, n_estimators=4, regression=True).fit(df)
    assert m.predict(df.unionByName(df)).count() == 2 * df.count()


def fixed_source(x, dom, y, w, rounds):
    src, w = dom == 0, w / w.sum()
    held, errors, preds = w[src].sum(), [], []
    for i in range(rounds):
        p = cell_mean(x, y, w)(x)
        err = np.abs(p - y)
        err = err / (err.max() + EPS)
        e = np.sum(w * err)
        errors.append(e)
        preds.append(p)
        if i < rounds - 1:
            t = w * (e / (2 - e)) ** (1 - err)
            w = np.where(src, w, t * (1 - held) / t[~src].sum())
    return errors, preds


def test_fixed_source_r2_matches_numpy(data):
    df, x, dom, y = data
    n = len(y)
    m = adapt.AdaBoostR2FixedSource(make, n_estimators=7).fit(df.withColumn("_w", F.lit(1.0 / n)), checkpoint_every=3)
    errors, preds = fixed_source(x, dom, y, np.full(n, 1 / n), 7)
    assert np.allclose(m.errors_, errors)
    assert np.allclose(by_key(m.predict(df), "prediction"), median(preds, model_weights(errors)))


def slices(n, cv):
    cv = min(cv, n)
    each = n // cv
    return [np.arange(i * each, n if i == cv - 1 else (i + 1) * each) for i in range(cv)]


def two_stage(x, dom, y, steps, rounds, cv):
    n, src = len(y), dom == 0
    at, nt = np.flatnonzero(~src), int((~src).sum())
    w, scores, weights, stages = np.full(n, 1 / n), [], [], []
    for step in range(steps):
        weights.append(w)
        errs = []
        for s in slices(nt, cv):
            out = np.zeros(n, bool)
            out[at[s]] = True
            v = w.copy()
            v[~src] *= w[~src].sum() / w[~src & ~out].sum()
            errs.append(np.abs(cell_mean(x[~out], y[~out], v[~out])(x[out]) - y[out]).mean())
        scores.append(np.mean(errs))
        errors, preds = fixed_source(x, dom, y, w, rounds)
        final = median(preds, model_weights(errors))
        stages.append(final)
        if step == steps - 1:
            break
        err = np.abs(final - y)
        err = err / (err.max() + EPS)
        k = nt / n + step / (steps - 1) * (1 - nt / n)
        goal, lo, hi = w[~src].sum() * (1 - k) / k, 0.0, 1.0
        if np.sum(w[src]) < goal:
            lo = 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.sum(w[src] * mid ** err[src]) < goal else (lo, mid)
        w = np.where(src, w * hi ** err, w)
        w = w / w.sum()
    best = int(np.argmin(scores))
    return scores, weights[best], stages[best]


@pytest.mark.parametrize("cv", [3, 20])
def test_two_stage_matches_numpy(data, cv):
    """cv = 20 exceeds the ten target rows: one slice a row."""
    df, x, dom, y = data
    m = adapt.TwoStageTrAdaBoostR2(make, n_estimators=3, n_estimators_fs=3, cv=cv).fit(df)
    scores, weights, final = two_stage(x, dom, y, 3, 3, cv)
    assert np.allclose(m.scores_, scores, atol=1e-5)
    assert np.allclose(by_key(m.sample_weights(), "_w"), weights, atol=1e-5)
    assert np.allclose(by_key(m.predict(df), "prediction"), final, atol=1e-4)
