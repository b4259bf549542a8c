"""Cases that were wrong once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions.stats import wilcoxon_zsplit
from parlance.operators import adapt, assemble, distance, evaluate, prep


def test_find_beta_is_exact(spark):
    df = spark.createDataFrame([(0.2, 0.0), (0.5, 0.5), (0.3, 1.0)], "w double, e double")
    b = adapt.find_beta(df, "w", "e", 0.6)
    assert 0.2 + 0.5 * b ** 0.5 + 0.3 * b == pytest.approx(0.6, abs=1e-6)
    assert adapt.find_beta(df, "w", "e", 0.1) == 0.0
    assert adapt.find_beta(df, "w", "e", 2.0) == 1.0


def test_bootstrap_draws_large_rates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, w double")
    got = {r["k"]: r["count"] for r in adapt.weighted_bootstrap(df, "w", n=5001, seed=3).groupBy("k").count().collect()}
    assert all(abs(got[k] - 2500.5) < 300 for k in (1, 2)) and got[1] != got[2]


def test_wilcoxon_is_exact_for_any_n():
    d = np.arange(1, 31) * np.where(np.arange(30) % 3 == 0, -1, 1)
    w, p = wilcoxon_zsplit(d, "greater")
    # Subset sums of the ranks, counted with whole numbers.
    ways = [1] + [0] * 465
    for r in range(1, 31):
        for k in range(465, r - 1, -1):
            ways[k] += ways[k - r]
    assert w == d[d > 0].sum() and p == pytest.approx(sum(ways[int(w):]) / 2 ** 30)
    assert wilcoxon_zsplit(np.array([1.0, 2, 3, 4, 5]), "greater") == (15.0, 1 / 32)


def test_fold_welch_keeps_digits(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 2), "f", int(i % 4 < 2), float(1e9 + rng.standard_normal() + (i % 4 < 2))) for i in range(200)]
    df = spark.createDataFrame(rows, "fold int, feature string, label int, value double")
    got = {r[0]: r["t"] for r in evaluate.training_side_welch(df, fold_col="fold", feature_col="feature", label_col="label", value_col="value").collect()}
    for f in (0, 1):
        a = np.array([v - 1e9 for k, _, y, v in rows if k != f and y == 1])
        b = np.array([v - 1e9 for k, _, y, v in rows if k != f and y == 0])
        want = (a.mean() - b.mean()) / np.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))
        assert got[f] == pytest.approx(want, rel=1e-5)


def test_seeded_shuffle_keeps_rows(spark):
    df = spark.range(200).coalesce(1)
    a, b, c = ([r[0] for r in assemble.seeded_shuffle(df, s).collect()] for s in (20, 20, 21))
    assert a == b and a != c and a != sorted(a) and sorted(a) == sorted(c) == list(range(200))


def test_discrepancies_match_numpy(spark):
    rng = np.random.default_rng(2)
    xs, xt = rng.normal(1, 2, (30, 4)), rng.normal(0, 1, (25, 4))
    df = spark.createDataFrame([(0, r.tolist()) for r in xs] + [(1, r.tolist()) for r in xt], "domain int, features array<double>")

    def gap(a, b):
        return a.T @ a / len(a) - b.T @ b / len(b)
    m = gap(xs, xt)
    want, v = np.abs(np.linalg.eigvalsh(m)).max(), np.ones(4)
    for _ in range(20):
        v = m @ v
        top = np.abs(v).max()
        v = v / top
    assert distance.linear_discrepancy(df) == pytest.approx(want)
    assert distance.linear_discrepancy(df, power_method=True) == pytest.approx(top)
    cells = np.concatenate([xs, xt])
    a, b = ((x - cells.mean()) / cells.std() for x in (xs, xt))
    assert distance.normalized_linear_discrepancy(df) == pytest.approx(np.abs(np.linalg.eigvalsh(gap(a, b))).max() / 4)
    ca, cb = np.cov(a.T), np.cov(b.T)
    root = np.sqrt(np.linalg.eigvals(ca @ cb).astype(complex)).real.sum()  # trace of (ca cb)^1/2
    frechet = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * root
    assert distance.normalized_frechet_distance(df) == pytest.approx(frechet / 4)


def test_dropped_entity_covers_nothing(spark):
    toks = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate("a b c x a b".split())], "filename long, utt_idx int, tok_idx int, token string")
    gaz = spark.createDataFrame([("a b", "GPE"), ("b c", "ORG"), ("c", "LOC")], "gram string, label string")
    got = sorted((r["tok_idx"], r["entity"]) for r in prep.entity_mentions(spark, toks, gaz).collect())
    assert got == [(0, "a b"), (2, "c"), (4, "a b")]
