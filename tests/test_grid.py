"""L08-L10 and the fitted weights of M07, M08 and M13 against plain numpy."""

import numpy as np
import pytest

from parlance.operators import adapt as ad
from parlance.operators import evaluate as ev
from parlance.operators import experiment as xp

from . import test_boosting as plain
from .test_linear import irls

D, FOLDS = 3, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 120
    dom = (np.arange(n) >= 70).astype(int)
    x = rng.normal(size=(n, D)) * [1, 10, 0.1] + dom[:, None] * [0.5, 0, 0.3]
    y = (x[:, 0] + x[:, 1] / 10 + rng.normal(size=n) * 0.7 > 0.2).astype(float)
    fold, corpus = np.arange(n) % FOLDS, np.where(dom == 1, 2, np.arange(n) % 2)
    flag = (rng.random(n) < 0.8).astype(int)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), int(dom[i]), int(fold[i]), int(corpus[i]), int(flag[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "filename int, features array<double>, label double, domain int, fold int, corpus int, few int")
    return df, x, y, dom, fold, corpus, flag == 1


def blocks(x, dom, corpus, method):
    if method == "augment":
        return np.column_stack([x, x * (dom == 0)[:, None], x * (dom == 1)[:, None]])
    return np.column_stack([*[x * (corpus == c)[:, None] for c in range(3)], x])


def predicted(method, x, y, dom, fold, corpus, k):
    src, train = dom == 0, (dom == 1) & (fold != k)
    rows = {"target_only": train, "source_only": src, "coral": src, "fmmd": src}.get(method, src | train)
    z = x
    if method in ("augment", "multiaugment"):
        z = blocks(x, dom, corpus, method)
    if method == "coral":
        def parts(m):
            return m.sum(), x[m].mean(0), np.cov(x[m].T)
        (ns, ms, cs), (nt, mt, ct) = parts(src), parts(train)
        matrix, ss, st = ad.coral_matrix(ns, cs, nt, ct)
        z = np.where(src[:, None], ((x - ms) / ss) @ matrix, (x - mt) / st)
    if method == "fmmd":
        w = (x[src].mean(0) - x[train].mean(0)) ** 2
        w = w / np.sqrt(np.sum(w ** 2))
        order = np.argsort(w)
        z = x[:, w <= w[order][np.argmax(np.diff(w[order]))]]
    if method == "tradaboost":
        learner, plain.cell_mean = plain.cell_mean, irls
        try:
            _, errors, _ = plain.tradaboost(x[rows], dom[rows], y[rows], 4, False)
            models, w = [], np.full(rows.sum(), 1 / rows.sum())
            beta = 1 / (1 + np.sqrt(2 * np.log(src.sum()) / 4))
            for e in errors:
                f = irls(x[rows], y[rows], w)
                models.append(f)
                err = np.abs(f(x[rows]) - y[rows])
                w = np.where(dom[rows] == 0, w * beta ** err, w * (e / (2 - e)) ** -err)
            a = np.array(plain.model_weights(errors)[2:])
            p = np.array([f(x) for f in models[2:]])
            return a @ p > a @ (1 - p)
        finally:
            plain.cell_mean = learner
    return irls(z[rows], y[rows], np.ones(rows.sum()))(z) > 0.5


def test_every_cell_of_the_grid_matches_numpy(spark, data):
    df, x, y, dom, fold, corpus, few = data
    got = xp.run_grid(spark, df, D, methods=xp.ALL_METHODS, rounds=(4,), corpora=2, settings=("few",)).collect()
    got += xp.run_grid(spark, df, D, methods=xp.ALL_METHODS, rounds=(4,), corpora=2).collect()
    assert len(got) == 2 * len(xp.ALL_METHODS) * FOLDS
    for r in got:
        keep = few if "setting" in r and r["setting"] else np.ones(len(y), bool)
        p = predicted(r["method"], x[keep], y[keep], dom[keep], fold[keep], corpus[keep], r["fold"])
        test = (dom[keep] == 1) & (fold[keep] == r["fold"])
        t, p = y[keep][test] == 1, p[test]
        f1 = 2 * np.sum(t & p) / max(2 * np.sum(t & p) + np.sum(t != p), 1)
        assert (r["n"], r["acc"], r["fms"]) == (test.sum(), pytest.approx(np.mean(t == p), abs=1e-6), pytest.approx(f1, abs=1e-6)), r


def test_cells_without_two_labels_and_too_many_folds(spark, data, monkeypatch):
    df = data[0]
    one = df.withColumn("label", df["domain"].cast("double"))
    got = {r["method"]: r for r in xp.run_grid(spark, one, D, methods=["target_only", "source_only", "joint", "tradaboost"], rounds=(2,), folds=[0]).collect()}
    assert got["target_only"]["acc"] is None and got["source_only"]["n"] == 0 and got["joint"]["n"] > 0
    monkeypatch.setattr(xp, "MOST_FOLDS", 2)
    with pytest.raises(ValueError, match="folds"):
        xp.run_grid(spark, df, D)


def test_fitted_weights_per_block(spark, data):
    df, x, y, dom, fold, corpus, _ = data
    got = dict(xp.fitted_weights(df, D))
    z = blocks(x, dom, corpus, "augment")
    for k in range(FOLDS):
        rows = (dom == 0) | (fold != k)
        mean, sd = z[rows].mean(0), z[rows].std(0)
        p = irls(z[rows], y[rows], np.ones(rows.sum()))
        # Each coefficient is the logit's change over one deviation.
        base = np.log(p(mean[None]) / (1 - p(mean[None])))
        for j in range(3 * D):
            at = mean.copy()
            at[j] += sd[j]
            q = p(at[None])
            assert got[k][j] == pytest.approx(float((np.log(q / (1 - q)) - base)[0]), abs=1e-6)
    coefs = spark.createDataFrame([(k, [float(v) for v in w]) for k, w in got.items()], "fold int, coefficients array<double>")
    named = ev.pivot_features(coefs, ["a", "b", "c"], ["joint", "source", "target"], k=1, by=["fold"])
    top = {(r["fold"], r["block"]): r["feature"] for r in named.filter("top_rank = 1").collect()}
    assert top == {(k, b): "abc"[int(np.argmax(got[k][i * D:(i + 1) * D]))] for k in got for i, b in enumerate(["joint", "source", "target"])}
