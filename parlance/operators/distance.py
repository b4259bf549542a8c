"""N: distances between a source and a target dataset.

Moment-based distances (N01–N05) need per-domain means and covariances —
distributed tree aggregates returning d and d×d arrays — then small dense
linear algebra on the driver (d×d, bounded by the feature count). N06 keeps
the kernel rows in a DataFrame and runs one aggregate per ascent step over a
≤ max_centers vector. N07/N08 are Spark ML fits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.frames import cut_lineage
from .adapt import _sym_pow, domain_moments, logistic

EPS = np.finfo(float).eps
PARTIALS = 512


def cov_distance(df: DataFrame, features_col="features", domain_col="domain") -> float:
    """Mean absolute difference of the two sample covariance matrices."""
    _, _, cs = domain_moments(df, features_col, 0, domain_col)
    _, _, ct = domain_moments(df, features_col, 1, domain_col)
    return float(np.mean(np.abs(cs - ct)))


def frechet_distance(df: DataFrame, features_col="features", domain_col="domain") -> float:
    """‖μs − μt‖² + tr(Σs + Σt − 2(Σs^½ Σt Σs^½)^½)."""
    _, ms, cs = domain_moments(df, features_col, 0, domain_col)
    _, mt, ct = domain_moments(df, features_col, 1, domain_col)
    r = _sym_pow(cs, 0.5)
    covmean = _sym_pow(r @ ct @ r, 0.5)
    return float(np.sum((ms - mt) ** 2) + np.trace(cs + ct - 2 * covmean))


def _gram(df, features_col, domain, domain_col):
    n, m, c = domain_moments(df, features_col, domain, domain_col)
    return c * (n - 1) / n + np.outer(m, m)


def linear_discrepancy(df: DataFrame, features_col="features", domain_col="domain",
                       power_method: bool = False, n_iter: int = 20) -> float:
    """Largest absolute eigenvalue of XsᵀXs/ns − XtᵀXt/nt (Gramians from
    the moments), optionally estimated by ``n_iter`` power steps from the
    vector of ones: the estimate is the last step's growth in the largest
    absolute component."""
    m = _gram(df, features_col, 0, domain_col) - _gram(df, features_col, 1, domain_col)
    if power_method:
        v, growth = np.ones(m.shape[0]), 0.0
        for _ in range(n_iter):
            v = m @ v
            growth = np.abs(v).max()
            v = v / (growth + EPS)
        return float(growth)
    return float(np.max(np.abs(np.linalg.eigvalsh((m + m.T) / 2))))


def global_standardise(df: DataFrame, features_col="features") -> DataFrame:
    """Centre and scale by the mean and population std over every cell of
    both domains (one aggregate)."""
    cells = df.select(F.explode(features_col).alias("v"))
    s = cells.agg(F.avg("v").alias("_mu"), F.stddev_pop("v").alias("_sd"))
    t = tx.attach_scalar(df, s)
    return t.withColumn(features_col, F.transform(features_col, lambda v: (v - F.col("_mu")) / F.col("_sd"))).drop(
        "_mu", "_sd")


def normalized_linear_discrepancy(df, features_col="features", domain_col="domain", **kw) -> float:
    """N03 after global standardisation, ÷ d."""
    d = df.select(F.size(features_col)).first()[0]
    return linear_discrepancy(global_standardise(df, features_col), features_col, domain_col, **kw) / d


def normalized_frechet_distance(df, features_col="features", domain_col="domain") -> float:
    """N02 after global standardisation, ÷ d."""
    d = df.select(F.size(features_col)).first()[0]
    return frechet_distance(global_standardise(df, features_col), features_col, domain_col) / d


def neg_j_score(df: DataFrame, features_col="features", domain_col="domain", key="vec_id",
                max_centers: int = 100, gamma: float | None = None, max_iter: int = 5000,
                tol: float = 1e-6, seed: int = 0) -> float:
    """−mean ln of the fitted density ratio at the target rows.

    Centres = the ``max_centers`` target rows with the smallest seeded hash
    of their key (a repeatable random draw). Kernel exp(−γ‖x − c‖²); by default γ = 1 / the mean
    squared target distance (computed from moments, no pair enumeration).
    The kernel rows (≤ max_centers wide) are checkpointed once; each ascent
    step is one aggregate over them.
    """
    tgt = df.filter(F.col(domain_col) != 0)
    centers = [np.asarray(r[0], dtype=float) for r in
               tgt.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(max_centers).select(features_col).collect()]
    C = np.vstack(centers)
    if gamma is None:
        n, m, c = domain_moments(df, features_col, 1, domain_col)
        msd = 2 * np.trace(c)  # E‖x − y‖² for two independent target rows
        gamma = 1.0 / msd if msd > 0 else 1.0
    x = F.col(features_col)
    cs = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in C])
    kern = F.transform(cs, lambda c: F.exp(-F.lit(gamma) * F.aggregate(
        F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    rows = cut_lineage(df.select(domain_col, kern.alias("k")))
    b = np.asarray(rows.filter(F.col(domain_col) == 0).select(
        Summarizer.mean(array_to_vector("k")).alias("m")).first()["m"].toArray())
    # At most PARTIALS tasks a step, so what a step sends back is bounded.
    A = rows.filter(F.col(domain_col) != 0).select("k").coalesce(PARTIALS)
    m = len(C)

    def step(alpha):
        # One pass over the target kernel rows per step: each Arrow batch
        # returns its partial gradient and log-sum; the plan is the same
        # every step (alpha travels in the closure), so nothing recompiles.
        a = np.asarray(alpha, dtype=float)

        def partial(batches):
            g, o, n = np.zeros(m), 0.0, 0
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                K = np.vstack(pdf["k"].to_numpy())
                dot = K @ a + EPS
                g += (K / dot[:, None]).sum(axis=0)
                o += float(np.log(dot).sum())
                n += len(pdf)
            yield pd.DataFrame({"g": [g.tolist()], "o": [o], "n": [n]})

        parts = A.mapInPandas(partial, "g array<double>, o double, n long").collect()
        n = sum(r["n"] for r in parts)
        return np.sum([np.asarray(r["g"]) for r in parts], axis=0), sum(r["o"] for r in parts) / n

    alpha = np.ones(m) / m
    grad, objective = step(alpha)
    prev = -np.inf
    k = 0
    while k < max_iter and objective - prev > tol:
        prev = objective
        alpha = alpha + 1e-4 * grad
        alpha = alpha + b * ((1 - b @ alpha) / (b @ b + EPS))
        alpha = np.maximum(0, alpha)
        alpha = alpha / (b @ alpha + EPS)
        grad, objective = step(alpha)
        k += 1
    return -objective


def domain_classifier(df: DataFrame, features_col="features", domain_col="domain", seed: int = 0) -> float:
    """Train a classifier to tell the domains apart on 80 % of the rows;
    score = 1 − mean squared error of its probability on the other 20 %. Each
    domain is split on its own."""
    data = df.select(array_to_vector(features_col).alias("features"),
                     (F.col(domain_col) != 0).cast("double").alias("label"))
    (a, b), (c, d) = (data.filter(F.col("label") == y).randomSplit([0.8, 0.2], seed + int(y)) for y in (0.0, 1.0))
    train, test = a.unionByName(c), b.unionByName(d)
    n = train.count()
    model = logistic(1.0, n).fit(train)
    p = model.transform(test).select((vector_to_array("probability")[1] - F.col("label")).alias("e"))
    mse = p.agg(F.avg(F.col("e") * F.col("e"))).first()[0]
    return 1.0 - float(mse)


def reverse_validation(df: DataFrame, features_col="features", domain_col="domain", C: float = 1.0) -> float:
    """Fit on labelled source, pseudo-label the target, fit on the
    pseudo-labelled target, report accuracy back on the source."""
    data = df.select(array_to_vector(features_col).alias("features"), "label", domain_col)
    src = data.filter(F.col(domain_col) == 0)
    tgt = data.filter(F.col(domain_col) != 0)
    m1 = logistic(C, src.count()).fit(src)
    pseudo = m1.transform(tgt).select("features", F.col("prediction").alias("label"))
    m2 = logistic(C, pseudo.count()).fit(pseudo)
    back = m2.transform(src).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return float(back)


def adapted_score(transform, distance, df: DataFrame, greater_is_better: bool = False, **kw) -> float:
    """A distance measured after an adaptation transform (any object with
    ``fit(df).transform(df)``), sign-flipped so that greater is better."""
    moved = transform.fit(df).transform(df) if transform is not None else df
    v = distance(moved, **kw)
    return v if greater_is_better else -v
