"""Linear learners by weighted sums (K09-K17, K21, L08) against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import adapt, linear

from . import test_boosting as plain


def ols(x, y, w):
    a = np.column_stack([x, np.ones(len(x))]) * np.sqrt(w)[:, None]
    b = np.linalg.lstsq(a, y * np.sqrt(w), rcond=1e-10)[0]
    return lambda z: np.column_stack([z, np.ones(len(z))]) @ b


def irls(x, y, w, C=1.0, steps=60):
    """Plain Newton steps on standardised columns, weights of mean 1."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1)
    a = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w, b = w / w.mean(), np.zeros(a.shape[1])
    ridge = np.append(np.full(x.shape[1], 1 / C), 0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a.T * (w * p * (1 - p))) @ a + np.diag(ridge), a.T @ (w * (p - y)) + ridge * b)
    return lambda z: 1 / (1 + np.exp(-np.column_stack([(z - mean) / sd, np.ones(len(z))]) @ b))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 90
    dom = (np.arange(n) >= 50).astype(int)
    x = rng.normal(size=(n, 4)) * [1, 100, 0.01, 1] + [0, 5000, 1, 0]
    x[:, 3] = 3.0  # a constant column
    y = np.round(x[:, 0] * 0.5 + (x[:, 1] - 5000) / 200 + dom * 0.4 + rng.normal(size=n) * 0.3, 4)
    rows = [(i, int(dom[i]), [float(v) for v in x[i]], float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "filename int, domain int, features array<double>, label double").repartition(7), x, dom, y


def binary(df):
    return df.withColumn("label", (F.col("label") > 0.2).cast("double"))


@pytest.mark.parametrize("rounds", [1, 12])
def test_logistic_tradaboost_matches_numpy(data, monkeypatch, rounds):
    df, x, dom, y = data
    monkeypatch.setattr(plain, "cell_mean", irls)
    y01 = (y > 0.2).astype(float)
    w, errors, preds = plain.tradaboost(x, dom, y01, rounds, False)
    m = linear.LinearTrAdaBoost(rounds).fit(binary(df))
    assert np.allclose(m.errors_, errors, atol=1e-7)
    got = m.sample_weights(binary(df))
    assert np.allclose(plain.by_key(got, "_w"), w, rtol=1e-6) and abs(sum(plain.by_key(got, "_w")) - 1) < 1e-9
    a, p = np.array(plain.model_weights(errors)[rounds // 2:]), np.array(preds[rounds // 2:])
    assert (plain.by_key(m.predict(binary(df)), "prediction") == (a @ p > a @ (1 - p)).astype(int)).all()
    assert m.steps_ < 8 * rounds + 4


def test_r2_tradaboost_matches_numpy(data, monkeypatch):
    df, x, dom, y = data
    monkeypatch.setattr(plain, "cell_mean", ols)
    w, errors, preds = plain.tradaboost(x, dom, y, 9, True)
    m = linear.LinearTrAdaBoost(9, regression=True).fit(df)
    assert np.allclose(m.errors_, errors, atol=1e-8)
    assert np.allclose(plain.by_key(m.sample_weights(df), "_w"), w, rtol=1e-6)
    assert np.allclose(plain.by_key(m.predict(df), "prediction"), plain.median(preds, plain.model_weights(errors)), atol=1e-6)


def test_fixed_source_matches_numpy(data, monkeypatch):
    df, x, dom, y = data
    monkeypatch.setattr(plain, "cell_mean", ols)
    errors, preds = plain.fixed_source(x, dom, y, np.full(len(y), 1 / len(y)), 8)
    m = linear.LinearR2FixedSource(8).fit(df)
    assert np.allclose(m.errors_, errors, atol=1e-8)
    assert np.allclose(plain.by_key(m.predict(df), "prediction"), plain.median(preds, plain.model_weights(errors)), atol=1e-6)


@pytest.mark.parametrize("cv", [4, 60])
def test_two_stage_matches_numpy(data, monkeypatch, cv):
    """cv = 60 exceeds the forty target rows: one slice a row."""
    df, x, dom, y = data
    monkeypatch.setattr(plain, "cell_mean", ols)
    scores, weights, final = plain.two_stage(x, dom, y, 4, 5, cv)
    m = linear.LinearTwoStage(4, 5, cv=cv).fit(df)
    assert np.allclose(m.scores_, scores, atol=1e-5)
    assert np.allclose(plain.by_key(m.sample_weights(df), "_w"), weights, atol=1e-6)
    assert np.allclose(plain.by_key(m.predict(df), "prediction"), final, atol=1e-4)
    # Two passes a cross-validation, whatever the slices.
    assert m.steps_ <= 4 * (2 + 2 * 5) + 3 * (1 + linear.LinearTwoStage.PASSES) + 1


def test_logistic_fit_and_collinear_columns(data, monkeypatch):
    df, x, dom, y = data
    y01 = (y > 0.2).astype(float)
    m = linear.logistic_newton(binary(df), C=0.3)
    p = irls(x, y01, np.ones(len(y)), C=0.3)(x)
    rows = {"features": x}
    assert np.allclose(m.probability(rows), p, atol=1e-8)
    assert (plain.by_key(m.transform(binary(df)), "prediction") == (p > 0.5)).all()
    # Shares that sum to one: the fit is the least-norm one and predicts like any other.
    share = np.abs(x[:, [0, 0, 0]] * [1, 2, 0.5] + np.arange(len(y))[:, None] % [3, 4, 5])
    share = share / share.sum(1, keepdims=True)
    share = (share - share.mean(0)) / share.std(0)
    sums = linear.gram_sums(linear.ones(share), y, np.ones(len(y)))
    assert np.allclose(linear.ones(share) @ linear.solve_gram(sums), ols(share, y, np.ones(len(y)))(share), atol=1e-6)
    with pytest.raises(ValueError, match="same"):
        linear.logistic_newton(df.withColumn("label", F.lit(1.0)))
    with pytest.raises(ValueError, match="no training rows"):
        linear.logistic_newton(df.limit(0))


def test_cells_share_passes_and_match_single_fits(data):
    """Folds, strengths and the augmented layout of a grid in shared passes."""
    df, x, dom, y = data
    y01, fold = (y > 0.2).astype(float), np.arange(len(y)) % 3
    rows = binary(df).withColumn("fold", F.col("filename") % 3)

    def side(k):
        return lambda r: (r["domain"] == 0) | (r["fold"] != k)

    def spread(r, z):
        t = (r["domain"] == 1)[:, None]
        return np.column_stack([z, z * ~t, z * t])
    cells = [linear.Cell(C, side(k), layout, layout and 12) for C in (0.1, 1.0) for k in range(3) for layout in (None, spread)]
    cells.append(linear.Cell(1.0, lambda r: r["label"] == 1))  # one class only
    with linear.Rows(rows, "fold") as held:
        passes = []
        count = held.sums
        held.sums = lambda *a, **k: passes.append(1) or count(*a, **k)
        boost = linear.LinearTrAdaBoost(5)
        *models, _ = linear.together(held, [*[linear.fit_logistic(c, 4) for c in cells], boost.run(linear.Cell(rows=side(1)), 4)])
    assert models[-1] is None and len(passes) < 60
    alone = linear.LinearTrAdaBoost(5).fit(rows.filter("domain = 0 OR fold <> 1"))
    assert np.allclose(alone.errors_, boost.errors_, atol=1e-9)
    at = 0
    for C in (0.1, 1.0):
        for k in range(3):
            keep = (dom == 0) | (fold != k)
            for wide in (False, True):
                z = spread({"domain": dom}, x) if wide else x
                want = irls(z[keep], y01[keep], np.ones(keep.sum()), C)(z)
                assert np.allclose(models[at].probability({"features": x, "domain": dom}), want, atol=1e-7)
                at += 1


def test_sums_add_in_levels(data, monkeypatch):
    df, x, *_ = data
    monkeypatch.setattr(linear, "FAN", 2)
    monkeypatch.setattr(linear, "ROWS_PER_TASK", 5)
    with linear.Rows(df) as rows:
        assert rows.parts == 7
        got = rows.sums(lambda r: np.append(r["features"].sum(0), r["label"].max()), 5, 1)
    assert np.allclose(got[:4], x.sum(0)) and got[4] == data[3].max()


def test_newton_reports_a_fit_that_does_not_settle():
    def runaway(b):
        return np.array([-1.0]), np.array([[1.0]]), -b[0], None
        yield
    with pytest.raises(RuntimeError, match="settle"):
        list(linear.newton(runaway, np.zeros(1), np.zeros(1)))


def test_wide_sums_reach_the_driver_as_one(data, monkeypatch):
    """Many partial sums are added by tasks once they are wide together."""
    df, x, *_ = data
    monkeypatch.setattr(linear, "ROWS_PER_TASK", 5)
    monkeypatch.setattr(linear, "AT_ONCE", 100)
    merged = []
    whole = linear._merge
    with linear.Rows(df) as rows:
        assert rows.parts == 7
        monkeypatch.setattr(linear, "_merge", lambda *a: merged.append(1) or whole(*a))
        assert np.allclose(rows.sums(lambda r: r["features"].sum(0), x.shape[1]), x.sum(0))
    assert len(merged) == 1
