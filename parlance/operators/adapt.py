"""K: domain adaptation on Spark ML — training-set construction, feature
augmentation, covariance alignment, discrepancy feature selection and
transfer boosting.

Conventions: ``domain`` 0 = source, 1 = target (J07); for several sources the
``domain`` column holds dense ids 0..n-1 for the sources and n for the target
(K24). Features are ``array<double>`` for the block layouts and an ML vector
for model fits (``array_to_vector``).

Only d-sized or d×d results ever reach the driver (means, covariances, a few
scalars per boosting round); rows never do.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.frames import carry_last, cut_lineage, global_rank, grouped_prefix_sum

EPS = np.finfo(float).eps
# A fit runs many short jobs: smaller partitions than this are merged first.
ROWS_PER_TASK = 2000


def _merged(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows in at most a task per ROWS_PER_TASK rows."""
    return df.coalesce(max(1, math.ceil(n / ROWS_PER_TASK)))


# --- K01, K02, K24: training sets and domain ids -----------------------------

def joint_training_set(source: DataFrame, target_train: DataFrame) -> DataFrame:
    """K01 "baseline": source ∪ target-train (order is irrelevant to Spark ML)."""
    return source.unionByName(target_train, allowMissingColumns=True)


def domain_only(df: DataFrame, domain: int, domain_col: str = "domain") -> DataFrame:
    """source_only / target_only training sets."""
    return df.filter(F.col(domain_col) == domain)


def dense_domains(df: DataFrame, raw_col: str, out_col: str = "domain") -> DataFrame:
    """Arbitrary domain ids → 0..n-1 in sorted order (a distributed rank
    of the distinct ids)."""
    ids = global_rank(df.select(raw_col).distinct(), raw_col, out_col=out_col)
    return df.join(ids, raw_col)


# --- K03–K05: feature augmentation ------------------------------------------

def _zeros(d: int):
    return F.array_repeat(F.lit(0.0), d)


def augment(df: DataFrame, d: int, features_col: str = "features", domain_col: str = "domain",
            out_col: str = "aug") -> DataFrame:
    """Source → [x, x, 0], target → [x, 0, x] (joint, source, target)."""
    x = F.col(features_col)
    src = F.concat(x, x, _zeros(d))
    tgt = F.concat(x, _zeros(d), x)
    return df.withColumn(out_col, F.when(F.col(domain_col) == 1, tgt).otherwise(src))


def augment_two_sources(df: DataFrame, d: int, features_col: str = "features", domain_col: str = "domain",
                        out_col: str = "aug") -> DataFrame:
    """K04 (kept as a named variant, Quirk 24): both sources → [x, x, 0, x],
    target (domain 2) → [0, 0, x, x]."""
    x = F.col(features_col)
    return df.withColumn(out_col, F.when(F.col(domain_col) == 2, F.concat(_zeros(d), _zeros(d), x, x))
                         .otherwise(F.concat(x, x, _zeros(d), x)))


def augment_n_sources(df: DataFrame, d: int, n_sources: int, features_col: str = "features",
                      domain_col: str = "domain", out_col: str = "aug") -> DataFrame:
    """With blocks j = 0..n+1, source i has x in blocks i and n+1, the
    target (domain n) in blocks n and n+1; ((n+2)·d wide)."""
    x = F.col(features_col)
    dom = F.col(domain_col)
    blocks = F.transform(F.sequence(F.lit(0), F.lit(n_sources + 1)),
                         lambda j: F.when((j == dom) | (j == n_sources + 1), x).otherwise(_zeros(d)))
    return df.withColumn(out_col, F.flatten(blocks))


# --- moments shared by K06, K07 and the N distances --------------------------

def domain_moments(df: DataFrame, features_col: str, domain: int | None = None, domain_col: str = "domain"):
    """(n, mean, sample covariance) of one domain as NumPy (d and d×d).

    Means and variances come from ``Summarizer``, the correlation matrix from
    ``Correlation.corr`` (both distributed tree aggregates); covariance =
    corr ⊙ σσᵀ with zero-variance columns set to 0.
    """
    part = df if domain is None else df.filter(F.col(domain_col) == domain)
    v = part.select(array_to_vector(F.col(features_col)).alias("v"))
    row = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
    n = int(row["count"])
    mean = np.asarray(row["mean"].toArray())
    var = np.asarray(row["variance"].toArray())
    corr = np.asarray(Correlation.corr(v, "v").first()[0].toArray())
    sd = np.sqrt(var)
    cov = np.nan_to_num(corr * np.outer(sd, sd))
    np.fill_diagonal(cov, var)
    return n, mean, cov


def _sym_pow(m: np.ndarray, p: float) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    w = np.clip(w, 0, None)
    with np.errstate(divide="ignore"):
        wp = np.where(w > 0, w ** p, 0.0)
    return (v * wp) @ v.T


def apply_matrix(df: DataFrame, features_col: str, mat: np.ndarray, shift: np.ndarray | None = None,
                 scale: np.ndarray | None = None, out_col: str | None = None) -> DataFrame:
    """x' = ((x - shift) / scale) · M for every row, in Arrow batches
    (``mapInPandas``); M is d×d (its size is bounded by d², not by rows)."""
    out_col = out_col or features_col
    d = mat.shape[0]
    shift = np.zeros(d) if shift is None else shift
    scale = np.ones(d) if scale is None else np.where(scale > 0, scale, 1.0)
    schema = df.schema
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    fields = [f for f in schema.fields if f.name != out_col] + [StructField(out_col, ArrayType(DoubleType()))]
    out_schema = StructType(fields)

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(**{out_col: []})[[f.name for f in fields]]
                continue
            x = np.vstack(pdf[features_col].map(lambda a: np.asarray(a, dtype=float)).to_numpy())
            y = ((x - shift) / scale) @ mat
            pdf = pdf.copy()
            pdf[out_col] = list(y)
            yield pdf[[f.name for f in fields]]

    return df.mapInPandas(run, out_schema)


# --- K06: CORAL ---------------------------------------------------------------

def coral_matrix(ns: int, cs: np.ndarray, nt: int, ct: np.ndarray, lambda_: float = 1.0):
    """(matrix, source deviations, target deviations) from the domains' sizes
    and covariances. Scaled by population deviations; covariances keep n - 1."""
    std_s, std_t = np.sqrt(np.diag(cs) * (ns - 1) / max(ns, 1)), np.sqrt(np.diag(ct) * (nt - 1) / max(nt, 1))
    unit_s, unit_t = np.where(std_s > 0, std_s, 1), np.where(std_t > 0, std_t, 1)
    eye = lambda_ * np.eye(cs.shape[0])
    matrix = _sym_pow(cs / np.outer(unit_s, unit_s) + eye, -0.5) @ _sym_pow(ct / np.outer(unit_t, unit_t) + eye, 0.5)
    return matrix, std_s, std_t


class Coral:
    """Standardise each domain by its own mean / std, then map the source
    with Cs^(-1/2) · Ct^(1/2) where C = cov + λI (λ = 1 as in the reference)."""

    def __init__(self, lambda_: float = 1.0, features_col: str = "features", domain_col: str = "domain"):
        self.lambda_, self.features_col, self.domain_col = lambda_, features_col, domain_col

    def fit(self, df: DataFrame) -> "Coral":
        ns, self.mean_s, cs = domain_moments(df, self.features_col, 0, self.domain_col)
        nt, self.mean_t, ct = domain_moments(df, self.features_col, 1, self.domain_col)
        self.matrix, self.std_s, self.std_t = coral_matrix(ns, cs, nt, ct, self.lambda_)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Source rows mapped; target rows standardised by the target moments."""
        src = apply_matrix(df.filter(F.col(self.domain_col) == 0), self.features_col, self.matrix,
                           self.mean_s, self.std_s)
        tgt = apply_matrix(df.filter(F.col(self.domain_col) != 0), self.features_col,
                           np.eye(len(self.mean_t)), self.mean_t, self.std_t)
        return src.unionByName(tgt)


# --- K07, K08: discrepancy feature selection --------------------------------

def fmmd_weights(df: DataFrame, feature_cols: list[str], domain_col: str = "domain") -> DataFrame:
    """K07, linear kernel: w_j = Δ_j² / ‖Δ²‖₂ with Δ = mean_source − mean_target,
    the closed-form maximiser of Σ w Δ² under w ≥ 0, ‖w‖₂ ≤ 1. One grouped
    aggregate; returns (feature, delta, weight)."""
    g = df.groupBy().agg(*[F.avg(F.when(F.col(domain_col) == 0, F.col(c))).alias(f"s_{i}")
                           for i, c in enumerate(feature_cols)],
                         *[F.avg(F.when(F.col(domain_col) != 0, F.col(c))).alias(f"t_{i}")
                           for i, c in enumerate(feature_cols)])
    stack = "stack({}, {}) AS (feature, delta)".format(
        len(feature_cols), ", ".join(f"'{c}', s_{i} - t_{i}" for i, c in enumerate(feature_cols)))
    long = g.select(F.expr(stack))
    norm = long.agg(F.sqrt(F.sum(F.pow(F.col("delta"), 4))).alias("norm"))
    return tx.attach_scalar(long, norm).select(
        "feature", tx.round6("delta").alias("delta"),
        tx.round6(F.coalesce(F.try_divide(F.col("delta") ** 2, F.col("norm")), F.lit(0.0))).alias("weight"))


def fmmd_threshold(weights: DataFrame) -> DataFrame:
    """Sort the weights, put the threshold just below the largest gap,
    keep features with w <= threshold (an error if none remain). The weight
    table has one row per feature."""
    w = Window.orderBy("weight", "feature")
    g = weights.withColumn("gap", F.lead("weight").over(w) - F.col("weight"))
    cut = g.orderBy(F.desc_nulls_last("gap"), "weight").limit(1).select(F.col("weight").alias("threshold"))
    return tx.attach_scalar(weights, cut).withColumn("keep", F.col("weight") <= F.col("threshold"))


# --- K21, K22: base models -------------------------------------------------

def logistic(C: float, n: int, max_iter: int = 3000, features_col="features", weight_col: str | None = None):
    """Standardise + L2 logistic regression. The reference sums the loss
    and Spark averages it, hence regParam = 1 / (C·n)."""
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1.0 / (C * max(n, 1)),
                            elasticNetParam=0.0, maxIter=max_iter, standardization=False)
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[StandardScaler(inputCol=features_col, outputCol="scaled", withMean=True,
                                           withStd=True), lr])


def margin_classifier(C: float, n: int, features_col="features", weight_col: str | None = None, max_iter=100):
    """K22 (re-aimed): standardise + linear SVM; class balance comes from the
    weight column (n / (2·n_class) per row, see ``class_balance_weights``)."""
    svc = LinearSVC(featuresCol="scaled", labelCol="label", regParam=1.0 / (C * max(n, 1)), maxIter=max_iter,
                    standardization=False)
    if weight_col:
        svc.setWeightCol(weight_col)
    return Pipeline(stages=[StandardScaler(inputCol=features_col, outputCol="scaled", withMean=True,
                                           withStd=True), svc])


def class_balance_weights(df: DataFrame, label_col="label", out_col="cw") -> DataFrame:
    """n / (2 · n_class) per row (the 'balanced' class weight)."""
    c = df.groupBy(label_col).agg(F.count("*").alias("_nc"))
    tot = c.agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k"))
    c = tx.attach_scalar(c, tot).select(label_col, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out_col))
    return df.join(c, label_col)


def linear_regression(C: float = 1.0, features_col="features", weight_col: str | None = None):
    """K23 regressor (used after CORAL for the MMSE-style target)."""
    lr = LinearRegression(featuresCol="scaled", labelCol="label", regParam=0.0)
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[StandardScaler(inputCol=features_col, outputCol="scaled", withMean=True,
                                           withStd=True), lr])


# --- K09–K19: transfer boosting ---------------------------------------------

def _p1(col="probability"):
    return vector_to_array(F.col(col))[1]


def check_sample_weight(df: DataFrame, weight_col: str) -> DataFrame:
    """Weights must be non-negative; all-zero weights become ones."""
    r = df.agg(F.min(weight_col).alias("mn"), F.sum(weight_col).alias("s")).first()
    if r["mn"] is not None and r["mn"] < 0:
        raise ValueError("sample weights must be non-negative")
    if not r["s"]:
        return df.withColumn(weight_col, F.lit(1.0))
    return df


class TrAdaBoost:
    """Transfer AdaBoost for binary classification.

    Each round fits the base estimator on both domains with the current
    weights (rescaled to mean 1), measures the error |p(1) − y| per row, sets
    E = weighted target error, β_t = E / (2 − E) (Quirk 25: the code form),
    β_s = 1 / (1 + √(2 ln n_s / N)), then multiplies source weights by
    β_s^(lr·err) and target weights by β_t^(−lr·err) and renormalises (no
    update after the last round). Per round the driver receives three
    scalars; the weight column lives in the DataFrame and lineage is cut by a
    reliable checkpoint every ``checkpoint_every`` rounds.
    """

    def __init__(self, make_estimator, n_estimators: int = 10, lr: float = 1.0, checkpoint_every: int = 5,
                 features_col: str = "features", domain_col: str = "domain", regression: bool = False):
        self.make_estimator, self.n_estimators, self.lr = make_estimator, n_estimators, lr
        self.checkpoint_every, self.features_col, self.domain_col = checkpoint_every, features_col, domain_col
        self.regression = regression

    def _errors(self, pred: DataFrame) -> DataFrame:
        if self.regression:
            return pred.withColumn("_err", F.abs(F.col("_pred") - F.col("label")))
        if "probability" in pred.columns:
            return pred.withColumn("_err", F.abs(_p1() - F.col("label")))
        return pred.withColumn("_err", F.abs(F.col("prediction") - F.col("label")))

    def fit(self, df: DataFrame) -> "TrAdaBoost":
        dom = F.col(self.domain_col)
        c = df.agg(F.count_if(dom == 0).alias("ns"), F.count_if(dom != 0).alias("nt")).first()
        ns, nt = int(c["ns"]), int(c["nt"])
        n = ns + nt
        cur = _merged(df, n).withColumn("_w", F.lit(1.0 / n))
        beta_s = 1.0 / (1.0 + math.sqrt(2.0 * math.log(max(ns, 1)) / self.n_estimators))
        self.models_, self.errors_ = [], []
        held = []
        for i in range(self.n_estimators):
            # Weights sum to 1 after every round, so their mean is 1/n: the
            # rescaled weights are w·n (no extra pass).
            train = cur.withColumn("_sw", F.col("_w") * n).persist(StorageLevel.MEMORY_AND_DISK)
            model = self.make_estimator(n, "_sw").fit(train)
            pred = model.transform(train)
            if self.regression:
                pred = pred.withColumnRenamed("prediction", "_pred")
            pred = kept = self._errors(pred).select(*df.columns, "_w", "_err").persist(StorageLevel.MEMORY_AND_DISK)
            # One pass: the largest error and the weighted target error.
            e = pred.agg(F.max("_err").alias("top"), F.sum(F.when(dom != 0, F.col("_w") * F.col("_err"))).alias("num"),
                         F.sum(F.when(dom != 0, F.col("_w"))).alias("den")).first()
            scale = e["top"] + EPS if self.regression else 1.0
            pred = pred.withColumn("_err", F.col("_err") / scale)
            err = float(e["num"] / scale / e["den"]) if e["den"] else 0.0
            self.models_.append(model)
            self.errors_.append(err)
            for h in held:
                h.unpersist()
            held = [train, kept]
            if i == self.n_estimators - 1:
                break
            beta_t = err / (2.0 - err)
            upd = F.when(dom == 0, F.col("_w") * F.pow(F.lit(beta_s), self.lr * F.col("_err"))).otherwise(
                F.col("_w") * F.pow(F.lit(beta_t), -self.lr * F.col("_err")))
            nxt = pred.select(*df.columns, upd.alias("_w"))
            total = nxt.agg(F.sum("_w")).first()[0]
            cur = nxt.withColumn("_w", F.col("_w") / total)
            if self.checkpoint_every and (i + 1) % self.checkpoint_every == 0:
                cur = cut_lineage(cur)
        self._held = held
        self.weights_ = cur  # K17: final sample weights per row
        self.estimator_weights_ = [-math.log(e / (2.0 - e) + EPS) + 2 * EPS for e in self.errors_]
        return self

    def sample_weights(self) -> DataFrame:
        """The last round's weights of source and target rows."""
        return self.weights_

    def predict(self, df: DataFrame) -> DataFrame:
        """Vote of the last ⌈N/2⌉ models, probabilities weighted by
        −ln(E/(2−E)); argmax (ties → class 0). For regression (K12) the
        weighted median of the models' predictions. The models follow one
        another in one plan without a join, so repeated keys stay as they are."""
        if self.regression:
            return predict_median(df, self.models_, self.estimator_weights_)
        start = int(len(self.models_) / 2)
        weights = self.estimator_weights_[start:]

        def vote(t):
            return _p1() if "probability" in t.columns else F.col("prediction").cast("double")
        out, cols = _with_models(df, self.models_[start:], vote)
        score1 = sum(F.col(c) * w for c, w in zip(cols, weights))
        score0 = sum((1 - F.col(c)) * w for c, w in zip(cols, weights))
        return out.withColumn("prediction", F.when(score1 > score0, 1).otherwise(0)).drop(*cols)


def _with_models(df: DataFrame, models: list, value) -> tuple[DataFrame, list[str]]:
    """``df`` with one column a model: ``value`` of its transformed rows."""
    out, names = df, []
    for k, m in enumerate(models):
        t = m.transform(out)
        out = t.select(*out.columns, value(t).alias(f"_m{k}"))
        names.append(f"_m{k}")
    return out, names


def predict_median(df: DataFrame, models: list, weights: list[float]) -> DataFrame:
    """Weighted median of the last half of the models."""
    start = int(len(models) / 2)
    out, cols = _with_models(df, models[start:], lambda t: F.col("prediction"))
    return weighted_median(out, cols, weights[start:])


def weighted_median(df: DataFrame, pred_cols: list[str], weights: list[float], out_col="prediction") -> DataFrame:
    """Per row, the prediction at which the cumulative model weight (in
    prediction order) first reaches half the total."""
    z = F.array_sort(F.array(*[F.struct(F.col(c).alias("p"), F.lit(float(w)).alias("w"))
                               for c, w in zip(pred_cols, weights)]))
    half = 0.5 * sum(weights)
    cum = F.transform(z, lambda x, i: F.struct(
        x["p"].alias("p"), F.aggregate(F.slice(z, 1, i + 1), F.lit(0.0), lambda a, y: a + y["w"]).alias("c")))
    pick = F.filter(cum, lambda s: s["c"] >= F.lit(half - 1e-12))
    return df.withColumn(out_col, F.element_at(pick, 1)["p"]).drop(*pred_cols)


class AdaBoostR2FixedSource:
    """AdaBoost.R2 with the source weights frozen; error over both
    domains; target weights × β_t^(lr·(1 − err)), rescaled to 1 − Σ source."""

    def __init__(self, make_estimator, n_estimators: int = 10, lr: float = 1.0, domain_col="domain"):
        self.make_estimator, self.n_estimators, self.lr, self.domain_col = make_estimator, n_estimators, lr, domain_col

    def fit(self, df: DataFrame, weight_col: str = "_w", checkpoint_every: int = 5) -> "AdaBoostR2FixedSource":
        """Two aggregates a round; the lineage is cut every
        ``checkpoint_every`` rounds."""
        src, w = F.col(self.domain_col) == 0, F.col(weight_col)
        t = df.agg(F.count("*").alias("n"), F.sum(w).alias("all"), F.sum(F.when(src, w)).alias("src")).first()
        n, source = t["n"], (t["src"] or 0.0) / t["all"]
        cur = _merged(df, n).withColumn(weight_col, w / t["all"])
        self.models_, self.errors_ = [], []
        held = []
        for i in range(self.n_estimators):
            train = cur.withColumn("_sw", w * n).persist(StorageLevel.MEMORY_AND_DISK)
            model = self.make_estimator(n, "_sw").fit(train)
            pred = (model.transform(train).select(*df.columns, F.abs(F.col("prediction") - F.col("label")).alias("_err"))
                    .persist(StorageLevel.MEMORY_AND_DISK))
            e = pred.agg(F.max("_err").alias("top"), F.sum(w * F.col("_err")).alias("sum")).first()
            top = e["top"] + EPS
            err = e["sum"] / top
            self.models_.append(model)
            self.errors_.append(err)
            for h in held:
                h.unpersist()
            held = [train, pred]
            if i == self.n_estimators - 1:
                break
            beta = err / (2.0 - err)
            moved = F.when(src, w).otherwise(w * F.pow(F.lit(beta), self.lr * (1 - F.col("_err") / top)))
            nxt = pred.withColumn(weight_col, moved).select(*df.columns)
            target = nxt.agg(F.sum(F.when(~src, w))).first()[0]
            if target:
                nxt = nxt.withColumn(weight_col, F.when(src, w).otherwise(w * ((1.0 - source) / target)))
            cur = cut_lineage(nxt) if (i + 1) % checkpoint_every == 0 else nxt
        for h in held:
            h.unpersist()
        self.estimator_weights_ = [-math.log(e / (2.0 - e) + EPS) + 2 * EPS for e in self.errors_]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_median(df, self.models_, self.estimator_weights_)


def find_beta(df: DataFrame, weight_col: str, err_col: str, target: float, grid: int = 16,
              passes: int = 6) -> float:
    """The β in [0, 1] at which Σ w·β^err equals ``target``.

    The sum grows with β, so the root is bracketed by neighbouring points of a
    grid; each pass evaluates the exact sums of a whole grid in one aggregate
    and the next grid lies inside the bracket (16 points and 6 passes: 1e-7).
    A target outside the range of the sums gives the nearer end.
    """
    lo, hi = 0.0, 1.0
    for _ in range(passes):
        betas = [lo + (hi - lo) * i / grid for i in range(grid + 1)]
        sums = df.agg(*[F.sum(F.col(weight_col) * F.pow(F.lit(x), F.col(err_col))).alias(f"s{i}")
                        for i, x in enumerate(betas)]).first()
        if sums[0] is None or sums[0] >= target:
            return betas[0]
        above = next((i for i in range(grid + 1) if sums[i] >= target), None)
        if above is None:
            return betas[-1]
        lo, hi = betas[above - 1], betas[above]
    return (lo + hi) / 2


def target_slices(df: DataFrame, n_slices: int, key: str = "filename", domain_col: str = "domain") -> DataFrame:
    """Consecutive target slices (by key order) as a ``slice`` column;
    source rows get null (they are in every training set). Every slice has
    floor(n / n_slices) rows (at least one) and the last one takes the rest.
    The key rank is exact and distributed (``global_rank``)."""
    tgt = df.filter(F.col(domain_col) != 0)
    cnt = tgt.agg(F.count("*").alias("_n"))
    t = tx.attach_scalar(global_rank(tgt, key, out_col="_r"), cnt)
    each = F.greatest(F.floor(F.col("_n") / n_slices), F.lit(1))
    t = t.withColumn("slice", F.least(F.floor(F.col("_r") / each), F.lit(n_slices - 1)).cast("int")).drop("_r", "_n")
    return df.filter(F.col(domain_col) == 0).withColumn("slice", F.lit(None).cast("int")).unionByName(t)


POISSON_RATE = 64.0


def weighted_bootstrap(df: DataFrame, weight_col: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """K18 (scalable form): each row is replicated Poisson(n·w/Σw) times, so
    the expected sample is n rows drawn ∝ weight. A rate above POISSON_RATE
    is drawn as the sum of independent draws of equal parts of it, one row a
    part, so no probability underflows. Each draw is an inverse-CDF search
    over k = 0..λ+12√λ+12 (the remaining tail mass is below 1e-30)."""
    stats = df.agg(F.sum(weight_col).alias("_ws"), F.count("*").alias("_n"))
    t = tx.attach_scalar(df, stats)
    rate = F.col(weight_col) * (F.lit(n) if n else F.col("_n")) / F.col("_ws")
    t = t.withColumn("_parts", F.greatest(F.lit(1), F.ceil(rate / POISSON_RATE).cast("int")))
    t = t.withColumn("_lam", rate / F.col("_parts")).withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    lam = F.col("_lam")
    t = t.withColumn("_u", F.rand(seed))
    u = F.col("_u")
    kmax = (lam + 12 * F.sqrt(lam) + 12).cast("int")
    # state: (k, p_k, cdf) ; count = first k with cdf >= u
    init = F.struct(F.lit(0).alias("k"), F.exp(-lam).alias("p"), F.exp(-lam).alias("c"), F.lit(-1).alias("hit"))

    def step(acc, j):
        p = acc["p"] * lam / j
        c = acc["c"] + p
        hit = F.when((acc["hit"] < 0) & (acc["c"] >= u), acc["k"]).otherwise(acc["hit"])
        return F.struct(j.alias("k"), p.alias("p"), c.alias("c"), hit.alias("hit"))

    draw = F.aggregate(F.sequence(F.lit(1), F.greatest(kmax, F.lit(1))), init, step,
                       lambda a: F.when(a["hit"] >= 0, a["hit"]).otherwise(a["k"]))
    t = t.withColumn("_k", draw)
    return t.filter("_k > 0").withColumn("_rep", F.explode(F.array_repeat(F.lit(1), F.col("_k")))).drop(
        "_k", "_rep", "_ws", "_n", "_parts", "_lam", "_part", "_u")


def bootstrap_draw(seed: int, i):
    """The uniform number in [0, 1) of draw ``i``: 52 bits of its md5."""
    text = F.concat(F.lit(f"{seed}:"), i.cast("string"))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def bootstrap(df: DataFrame, weight_col: str, key: str, n: int | None = None, seed: int = 0,
              draw_col: str = "draw") -> DataFrame:
    """Exactly ``n`` rows (default: as many as ``df`` has) drawn with
    replacement, with probability ∝ weight; ``draw_col`` numbers the draws.

    Rows take intervals of the total weight in ``key`` order (a distributed
    prefix sum), draw i is a point hashed from (seed, i), and each point takes
    the last interval that begins at or before it: points and intervals are
    put in one order and the rows are carried forward over range partitions.
    So the sample is the same whatever the partitions, a row of a third of the
    weight is drawn by many tasks, and nothing is joined. Rows of weight 0 or
    null are never drawn; a table without weight gives no rows. Keys must be
    unique."""
    rows = df.filter(F.col(weight_col) > 0).select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"),
                                                   F.col(weight_col).cast("double").alias("_w"), F.lit(0).alias("_one"))
    placed = grouped_prefix_sum(rows, "_one", "_key", "_w", "_at")
    total = placed.agg(F.sum("_w").alias("t")).first()["t"]
    if not total:
        return df.limit(0).withColumn(draw_col, F.lit(0).cast("long"))
    size = df.count() if n is None else n
    draws = df.sparkSession.range(size).select((bootstrap_draw(seed, F.col("id")) * total).alias("_at"), F.lit(1).alias("_kind"),
                                               F.col("id").cast("string").alias("_tie"), F.col("id").alias(draw_col))
    both = placed.select(F.col("_at").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.col("_key").cast("string").alias("_tie"), "_row").unionByName(
        draws, allowMissingColumns=True)
    drawn = carry_last(both, ["_at", "_kind", "_tie"], "_row", "_drawn").filter("_kind = 1")
    return drawn.select(*[F.col("_drawn")[c].alias(c) for c in df.columns], draw_col)


class TwoStageTrAdaBoostR2:
    """Outer loop over ``n_estimators`` steps. Each step scores the
    current weights by target-slice cross-validation (K16), fits the
    fixed-source AdaBoost.R2 (K13), then lowers the source weights by β^err
    where β is bisected (K15) so that the target's share of the weight
    follows the schedule K_t = n_t/n + step/(N−1)·(1 − n_t/n). Prediction
    uses the step with the best (lowest) CV error."""

    def __init__(self, make_estimator, n_estimators: int = 10, n_estimators_fs: int = 10, cv: int = 5,
                 lr: float = 1.0, domain_col: str = "domain", key: str = "filename"):
        self.make_estimator, self.n_estimators, self.n_fs = make_estimator, n_estimators, n_estimators_fs
        self.cv, self.lr, self.domain_col, self.key = cv, lr, domain_col, key

    def _cv_score(self, df: DataFrame, nt: int) -> float:
        """Mean absolute error over the target slices; at most one slice a
        target row. The target keeps its mass without the slice held out."""
        cv = min(self.cv, nt)
        sl = cut_lineage(target_slices(df, cv, self.key, self.domain_col))
        w = F.col("_w")
        sums = {r["slice"]: r for r in sl.groupBy("slice").agg(F.sum(w).alias("w"), F.count("*").alias("n")).collect()}
        n, full = sum(r["n"] for r in sums.values()), sum(r["w"] for s, r in sums.items() if s is not None)
        errs = []
        for i in range(cv):
            rest = full - sums[i]["w"]
            grow = full / rest if rest else 1.0
            train = sl.filter(F.col("slice").isNull() | (F.col("slice") != i))
            size = n - sums[i]["n"]
            model = self.make_estimator(size, "_sw").fit(
                train.withColumn("_sw", F.when(F.col("slice").isNull(), w).otherwise(w * grow) * size))
            e = model.transform(sl.filter(F.col("slice") == i)).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
            errs.append(e)
        return float(np.mean(errs))

    def fit(self, df: DataFrame) -> "TwoStageTrAdaBoostR2":
        dom = F.col(self.domain_col)
        c = df.agg(F.count_if(dom == 0).alias("ns"), F.count_if(dom != 0).alias("nt")).first()
        ns, nt = int(c["ns"]), int(c["nt"])
        if not nt:
            raise ValueError("two-stage boosting needs target rows")
        cur = cut_lineage(df.withColumn("_w", F.lit(1.0 / (ns + nt))))
        self.scores_, self.stages_, self.weights_ = [], [], []
        for step in range(self.n_estimators):
            self.weights_.append(cur)
            self.scores_.append(self._cv_score(cur, nt))
            stage = AdaBoostR2FixedSource(self.make_estimator, self.n_fs, self.lr, self.domain_col).fit(cur)
            self.stages_.append(stage)
            if step == self.n_estimators - 1:
                break
            # The errors are those of the whole stage's weighted median.
            pred = cut_lineage(stage.predict(cur).select(*df.columns, "_w", F.abs(F.col("prediction") - F.col("label")).alias("_err")))
            e = pred.agg(F.max("_err").alias("top"), F.sum(F.when(dom != 0, F.col("_w"))).alias("wt")).first()
            pred = pred.withColumn("_err", F.col("_err") / (e["top"] + EPS))
            k_t = nt / (ns + nt) + (step / (self.n_estimators - 1)) * (1 - nt / (ns + nt))
            beta = find_beta(pred.filter(dom == 0), "_w", "_err", e["wt"] * (1 - k_t) / k_t)
            nxt = pred.select(*df.columns, F.when(
                dom == 0, F.col("_w") * F.pow(F.lit(beta), self.lr * F.col("_err"))).otherwise(F.col("_w")).alias("_w"))
            tot = nxt.agg(F.sum("_w")).first()[0]
            cur = cut_lineage(nxt.withColumn("_w", F.col("_w") / tot))
        self.best_ = int(np.argmin(self.scores_))
        return self

    def sample_weights(self) -> DataFrame:
        """The row weights of the step with the best CV error."""
        return self.weights_[self.best_]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.stages_[self.best_].predict(df)


class AdaptedEstimator:
    """The adaptation dispatch — either *transform* the data with an
    adapter (``fit(df)`` / ``transform(df)``, e.g. ``Coral``) or *reweight*
    the rows with a weighter returning a ``_w`` column (e.g. the final
    weights of ``TrAdaBoost``), then fit the base estimator on the source
    (or on both domains when ``train_domains`` says so); at predict time the
    target goes through the same transform. With ``bootstrap_key`` (a unique
    column) an estimator that takes no weights is fitted on an exact weighted
    bootstrap sample instead (K18)."""

    def __init__(self, make_estimator, adapter=None, weighter=None, features_col: str = "features",
                 domain_col: str = "domain", train_domains=(0,), bootstrap_key: str | None = None, seed: int = 0):
        if (adapter is None) == (weighter is None):
            raise ValueError("give exactly one of adapter (transform) or weighter (reweight)")
        self.make_estimator, self.adapter, self.weighter = make_estimator, adapter, weighter
        self.features_col, self.domain_col, self.train_domains = features_col, domain_col, list(train_domains)
        self.bootstrap_key, self.seed = bootstrap_key, seed

    def _vec(self, df):
        return df.withColumn(self.features_col, array_to_vector(F.col(self.features_col)))

    def fit(self, df: DataFrame) -> "AdaptedEstimator":
        train = df.filter(F.col(self.domain_col).isin(self.train_domains))
        if self.adapter is not None:
            self.adapter.fit(df)
            moved = self._vec(self.adapter.transform(train))
            self.model_ = self.make_estimator(moved.count(), None).fit(moved)
        else:
            weighted = self.weighter(df).filter(F.col(self.domain_col).isin(self.train_domains))
            if self.bootstrap_key:
                drawn = cut_lineage(bootstrap(check_sample_weight(weighted, "_w"), "_w", self.bootstrap_key, seed=self.seed).drop("draw"))
                self.model_ = self.make_estimator(drawn.count(), None).fit(self._vec(drawn))
                return self
            n = weighted.count()
            mean_w = weighted.agg(F.avg("_w")).first()[0]
            w = self._vec(weighted.withColumn("_sw", F.col("_w") / mean_w))
            self.model_ = self.make_estimator(n, "_sw").fit(w)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        x = self.adapter.transform(df) if self.adapter is not None else df
        return self.model_.transform(self._vec(x))
