"""Linear base learners by weighted sums: K09–K15, K17, K21 and the fits of
L08, without an optimiser's many small jobs.

Every step is one pass over the training rows that returns a few sums: the
gradient and the d×d Hessian of a logistic loss (a Newton step), a weighted
Gram matrix (normal equations), weighted errors. Tasks add their rows up in
numpy and return one short vector each; more than ``FAN`` of them are added by
tasks, level by level, before the driver sees them. A fit is a generator that
yields what it wants summed next, so that any number of fits (all folds,
methods and strengths of a grid) advance together, one pass for all of them.

Boosting keeps no weight column. A row's weight follows from the models and
betas of the earlier rounds, which are a few numbers, so each pass works it
out anew from the row. No lineage grows with the rounds, nothing is
checkpointed, and a lost executor costs only its part of one pass.

Rows need ``features`` (array of d doubles), ``label`` and, for the transfer
methods, ``domain`` (0 source, 1 target).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = np.finfo(float).eps
FAN = 64  # partial sums added by one task, or by the driver
AT_ONCE = 1 << 18  # bytes of partial sums that the driver adds; more are added by a task first
ROWS_PER_TASK = 2000  # a fit is many short passes: smaller partitions are merged
MOST_PER_TASK = 200_000  # and larger ones too, up to this, while every core has one


def _numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1).astype(float)
    return column.to_numpy(zero_copy_only=False)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: _numpy(batch.column(i)) for i, n in enumerate(batch.schema.names)}


def _merge(a: np.ndarray, b: np.ndarray, tops: int) -> np.ndarray:
    """Sums, but maxima of the last ``tops`` entries."""
    cut = len(a) - tops
    return np.concatenate([a[:cut] + b[:cut], np.maximum(a[cut:], b[cut:])])


class Rows:
    """Training rows as narrow columns, held by the executors (in memory, on
    disk where that is short) while a model is fitted; lost parts are read
    again. Use as a context."""

    def __init__(self, df: DataFrame, *extra: str, features: str = "features"):
        cols = [F.col(features).alias("features"), F.col("label").cast("double").alias("label")]
        cols += [F.col(c) for c in ("domain", *extra) if c in df.columns]
        n = df.count()
        cores = df.sparkSession.sparkContext.defaultParallelism
        tasks = min(math.ceil(n / ROWS_PER_TASK), max(cores, math.ceil(n / MOST_PER_TASK)))
        self.df = df.select(*cols).coalesce(max(1, tasks)).persist(StorageLevel.MEMORY_AND_DISK)
        self.n, self.parts = n, self.df.rdd.getNumPartitions()

    def __enter__(self) -> "Rows":
        return self

    def __exit__(self, *_):
        self.df.unpersist()

    def sums(self, kernel: Callable[[dict], np.ndarray], size: int, tops: int = 0) -> np.ndarray:
        """Sum of ``kernel(columns)`` over all batches of rows: ``size``
        numbers, the last ``tops`` of them maxima."""
        def start():
            return np.concatenate([np.zeros(size - tops), np.full(tops, -np.inf)])

        def out(total):
            return pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

        def run(batches):
            total = start()
            for b in batches:
                if b.num_rows:
                    total = _merge(total, kernel(_columns(b)), tops)
            yield out(total)

        def add(batches):
            total = start()
            for b in batches:
                for v in _numpy(b.column(0)) if b.num_rows else ():
                    total = _merge(total, v, tops)
            yield out(total)

        parts, n = self.df.mapInArrow(run, "v array<double>"), self.parts
        while n > FAN or (n > 1 and 8 * n * size > AT_ONCE):
            n = math.ceil(n / FAN)
            parts = parts.repartition(n).mapInArrow(add, "v array<double>")
        total = start()
        for r in parts.toLocalIterator() if n > FAN else parts.collect():
            total = _merge(total, np.array(r["v"]), tops)
        return total


def with_values(df: DataFrame, values: Callable[[dict], np.ndarray], out_col: str, kind: str = "double",
                needs=("features",), features: str = "features") -> DataFrame:
    """``df`` with a column computed from whole batches of rows."""
    keep = [c for c in df.columns if c != out_col]
    fields = [f for f in df.schema.fields if f.name != out_col]

    def run(batches):
        for b in batches:
            rows = {"features" if n == features else n: _numpy(b.column(n)) for n in {features, *needs} - {"features"} | {features}}
            got = values(rows) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(got, pa.int32() if kind == "int" else pa.float64())],
                                             names=[*keep, out_col])
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.IntegerType() if kind == "int" else T.DoubleType())]))


# --- sums of one model --------------------------------------------------------

def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def ones(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def logistic_sums(x1: np.ndarray, y: np.ndarray, s: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gradient, Hessian, loss and total weight at ``b``."""
    z = x1 @ b
    p = sigmoid(z)
    return np.concatenate([x1.T @ (s * (p - y)), ((x1 * (s * p * (1 - p))[:, None]).T @ x1).ravel(),
                           [np.sum(s * (np.logaddexp(0, z) - y * z)), s.sum()]])


def gram_sums(x1: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Weighted Gram matrix and right side; its last entry is the weight."""
    w = x1 * s[:, None]
    return np.concatenate([w.T @ y, (w.T @ x1).ravel()])


def solve_gram(sums: np.ndarray) -> np.ndarray:
    """Least squares from ``gram_sums``; directions that the rows do not
    determine (collinear columns) get 0."""
    d = round((math.sqrt(1 + 4 * len(sums)) - 1) / 2)
    right, gram = sums[:d], sums[d:].reshape(d, d)
    values, vectors = np.linalg.eigh(gram)
    inverse = np.where(values > 1e-10 * max(values.max(), 0), 1 / np.where(values > 0, values, 1), 0)
    return vectors @ (inverse * (vectors.T @ right))


@dataclass
class Wanted:
    """A sum that a fit asks for: ``kernel(columns)`` gives ``size`` numbers,
    of which the last ``tops`` are maxima."""
    kernel: Callable[[dict], np.ndarray]
    size: int
    tops: int = 0


def together(rows: Rows, fits: list[Generator]) -> list:
    """Run fits that yield ``Wanted`` and return a result; every pass over the
    rows serves all that are not done."""
    asked, out = {}, [None] * len(fits)

    def step(i, got):
        try:
            asked[i] = next(fits[i]) if got is None else fits[i].send(got)
        except StopIteration as end:
            asked.pop(i, None)
            out[i] = end.value
    for i in range(len(fits)):
        step(i, None)
    while asked:
        want = list(asked.items())
        kernels, cuts, tops = [w.kernel for _, w in want], [w.size - w.tops for _, w in want], [w.tops for _, w in want]

        def kernel(r):
            parts = [k(r) for k in kernels]
            return np.concatenate([*[x[:c] for x, c in zip(parts, cuts)], *[x[c:] for x, c in zip(parts, cuts)]])
        total = rows.sums(kernel, sum(cuts) + sum(tops), sum(tops))
        at, top = 0, sum(cuts)
        for (i, _), c, t in zip(want, cuts, tops):
            step(i, np.concatenate([total[at:at + c], total[top:top + t]]))
            at, top = at + c, top + t
    return out


def within(fit: Generator, keep: Callable[[dict], np.ndarray]) -> Generator:
    """The fit on the rows that a mask keeps."""
    def cut(kernel):
        def run(r):
            mask = keep(r)
            return kernel({k: v[mask] for k, v in r.items()})
        return run
    got = None
    while True:
        try:
            w = fit.send(got)
        except StopIteration as end:
            return end.value
        got = yield Wanted(cut(w.kernel), w.size, w.tops)


def newton(evaluate: Callable, start: np.ndarray, ridge: np.ndarray, tol: float = 1e-20, most: int = 200) -> Generator:
    """Minimise a ridge-penalised convex loss; ``evaluate(b)`` is a generator
    that returns (gradient, Hessian, loss, extra). Full Newton steps, halved
    while the loss grows; done when the Newton decrement falls below ``tol`` of
    the loss, or when it is small and falls no further (the end of doubles).
    Returns (b, extra) at that point; not settling is an error."""
    b, best, move, step, last = start, None, None, 1.0, math.inf
    for _ in range(most):
        g, h, loss, extra = yield from evaluate(b)
        g, h, loss = g + ridge * b, h + np.diag(ridge), loss + 0.5 * np.sum(ridge * b * b)
        if best and not loss <= best[1] + 1e-12 * abs(best[1]):
            step /= 2
            if step < 1e-9:  # no descent left in doubles
                return best[0], best[2]
            b = best[0] + step * move
            continue
        try:
            move = -np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            move = -np.linalg.lstsq(h, g, rcond=None)[0]
        decrement = -(g @ move) / (1 + abs(loss))
        if decrement <= tol or last / 2 < decrement < 1e-13:
            return b, extra
        best, step, last = (b, loss, extra), 1.0, decrement
        b = b + move
    raise RuntimeError(f"the logistic fit did not settle in {most} steps")


# --- scaling ------------------------------------------------------------------

def width(df: DataFrame, features: str = "features") -> int:
    r = df.select(F.size(features).alias("d")).first()
    if r is None:
        raise ValueError("no training rows")
    return int(r["d"])


@dataclass
class Scaled:
    """Standardised features with a column of ones; ``sd`` is the population
    deviation, 1 for constant columns."""
    mean: np.ndarray
    sd: np.ndarray

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return ones((features - self.mean) / self.sd)

    def raw(self, b: np.ndarray) -> tuple[np.ndarray, float]:
        """(coefficients, intercept) for the features as they are."""
        return b[:-1] / self.sd, float(b[-1] - np.sum(b[:-1] * self.mean / self.sd))


def scaling(columns: Callable[[dict], np.ndarray], d: int) -> Generator:
    """(rows, Scaled) of ``columns(r)``, an (n, d) matrix of some rows."""
    def first(r):
        x = columns(r)
        return np.append(x.sum(0), len(x))
    s = yield Wanted(first, d + 1)
    n = s[-1]
    mean = s[:-1] / max(n, 1)
    var = (yield Wanted(lambda r: ((columns(r) - mean) ** 2).sum(0), d)) / max(n, 1)
    sd = np.sqrt(var)
    return int(n), Scaled(mean, np.where(sd > 10 * EPS * np.abs(mean), sd, 1.0))


# --- K21 and grids: logistic fits -----------------------------------------------

@dataclass
class Cell:
    """One fit of a grid: strength, training rows (a mask over the columns),
    and how features are laid out (with the width that this gives)."""
    C: float = 1.0
    rows: Callable[[dict], np.ndarray] | None = None
    layout: Callable[[dict, np.ndarray], np.ndarray] | None = None
    width: int | None = None

    def take(self, r: dict) -> dict:
        if self.rows is None:
            return r
        keep = self.rows(r)
        return {k: v[keep] for k, v in r.items()}

    def columns(self, r: dict) -> np.ndarray:
        return r["features"] if self.layout is None else self.layout(r, r["features"])


class LogisticModel:
    """Coefficients and intercept over the laid out features."""

    def __init__(self, coef, intercept, cell: Cell, sd):
        self.coef, self.intercept, self.cell, self.sd = np.asarray(coef), float(intercept), cell, sd

    def probability(self, rows: dict) -> np.ndarray:
        return sigmoid(self.cell.columns(rows) @ self.coef + self.intercept)

    def standardised(self) -> np.ndarray:
        """Coefficients per standard deviation of the training columns."""
        return self.coef * self.sd

    def transform(self, df: DataFrame, out_col: str = "prediction", features: str = "features", needs=()) -> DataFrame:
        return with_values(df, lambda r: (self.probability(r) > 0.5).astype(float), out_col, needs=needs, features=features)


def fit_logistic(cell: Cell, d: int, tol: float = 1e-20) -> Generator:
    """Standardise + L2 logistic regression (K21) of a cell's rows: the loss
    is a sum, the penalty ½‖w‖² / C on the standardised columns. Less than two
    labels give None."""
    def columns(r):
        return cell.columns(cell.take(r))
    n, scale = yield from scaling(columns, cell.width or d)
    positive = (yield Wanted(lambda r: np.array([cell.take(r)["label"].sum()]), 1))[0]
    if not 0 < positive < n:
        return None
    k = len(scale.mean) + 1

    def evaluate(b):
        def kernel(r):
            sub = cell.take(r)
            return logistic_sums(scale(cell.columns(sub)), sub["label"], np.ones(len(sub["label"])), b)
        s = yield Wanted(kernel, k + k * k + 2)
        return s[:k], s[k:k + k * k].reshape(k, k), s[-2], None
    b, _ = yield from newton(evaluate, np.zeros(k), np.append(np.full(k - 1, 1.0 / cell.C), 0.0), tol)
    return LogisticModel(*scale.raw(b), cell, scale.sd)


def logistic_newton(df: DataFrame, C: float = 1.0, features: str = "features") -> LogisticModel:
    """Standardise + L2 logistic regression, fitted to convergence."""
    d = width(df, features)
    with Rows(df, features=features) as rows:
        (model,) = together(rows, [fit_logistic(Cell(C), d)])
    if model is None:
        raise ValueError("the labels are all the same")
    return model


# --- K09–K12, K17: transfer boosting ------------------------------------------

@dataclass
class Rounds:
    """The finished rounds of a boosting: models (columns), error scales, and
    the logarithms of the betas."""
    regression: bool
    lr: float
    log_source: float = 0.0
    models: np.ndarray | None = None
    tops: tuple = ()
    log_target: tuple = ()

    def errors(self, x1, y):
        z = x1 @ self.models
        p = z if self.regression else sigmoid(z)
        return np.abs(p - y[:, None]) / np.array(self.tops)

    def log_weights(self, x1, y, source):
        """Logarithm of every row's weight, up to one constant."""
        if self.models is None:
            return np.zeros(len(y))
        e = self.errors(x1, y)
        return self.lr * np.where(source, self.log_source * e.sum(1), -(e @ np.array(self.log_target)))

    def bound(self) -> float:
        """No logarithm is above it."""
        return self.lr * sum(max(0.0, -b) for b in self.log_target)

    def then(self, b: np.ndarray, top: float, error: float) -> "Rounds":
        models = b[:, None] if self.models is None else np.column_stack([self.models, b])
        beta = math.log(max(error / (2.0 - error), 1e-300))
        return Rounds(self.regression, self.lr, self.log_source, models, (*self.tops, top), (*self.log_target, beta))


def model_weight(error: float) -> float:
    return -math.log(error / (2.0 - error) + EPS) + 2 * EPS


def median_of(preds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted median of each row of predictions."""
    order = np.argsort(preds, axis=1, kind="stable")
    reach = np.cumsum(weights[order], axis=1) >= 0.5 * weights.sum() - 1e-12
    return np.take_along_axis(preds, order, 1)[np.arange(len(preds)), reach.argmax(1)]


class LinearTrAdaBoost:
    """K09, K10, K17 (logistic) and K11, K12 (least squares): transfer
    AdaBoost with a linear base learner.

    A round fits the learner with the current weights (rescaled to mean 1),
    takes each row's error |p(1) − y| (regression: |residual| over the largest
    one), E = weighted target error, β_t = E / (2 − E), β_s = 1 / (1 + √(2 ln
    n_s / N)), and multiplies source weights by β_s^(lr·err), target weights
    by β_t^(−lr·err) (no update after the last round). Logistic rounds start
    from the round before; the pass that finds a fit settled has its errors
    too. ``steps_`` counts the passes."""

    def __init__(self, n_estimators: int = 10, lr: float = 1.0, C: float = 1.0, regression: bool = False, tol: float = 1e-20,
                 features: str = "features"):
        self.n_estimators, self.lr, self.C, self.regression, self.tol, self.features = n_estimators, lr, C, regression, tol, features

    def fit(self, df: DataFrame) -> "LinearTrAdaBoost":
        d = width(df, self.features)
        with Rows(df, features=self.features) as rows:
            together(rows, [self.run(Cell(), d)])
        return self

    def run(self, cell: Cell, d: int) -> Generator:
        """The fit on a cell's rows."""
        self.models_, self.errors_, self.steps_ = [], [], 0
        self.cell_ = cell
        n, self.scale_ = yield from scaling(lambda r: cell.take(r)["features"], d)
        ns = (yield Wanted(lambda r: np.array([np.sum(cell.take(r)["domain"] == 0)], float), 1))[0]
        state = Rounds(self.regression, self.lr, -math.log(1.0 + math.sqrt(2.0 * math.log(max(ns, 1)) / self.n_estimators)))
        b = np.zeros(d + 1)
        for i in range(self.n_estimators):
            b, top, error = yield from (self._least_squares(state, b) if self.regression else self._logistic(n, state, b))
            self.models_.append(b)
            self.errors_.append(error)
            if i < self.n_estimators - 1:
                state = state.then(b, top, error)
        self.rounds_ = state
        self.total_ = (yield self._wanted(state, lambda x1, y, src, w: np.array([w.sum()]), 1))[0]
        self.estimator_weights_ = [model_weight(e) for e in self.errors_]
        return self

    def _wanted(self, state, kernel, size, tops=0) -> Wanted:
        self.steps_ += 1
        cell, scale, shift = self.cell_, self.scale_, state.bound()

        def run(r):
            r = cell.take(r)
            x1, y, src = scale(r["features"]), r["label"], r["domain"] == 0
            return kernel(x1, y, src, np.exp(state.log_weights(x1, y, src) - shift))
        return Wanted(run, size, tops)

    def _logistic(self, n, state, start) -> Generator:
        k = len(start)

        def evaluate(b):
            def kernel(x1, y, src, w):
                err = np.abs(sigmoid(x1 @ b) - y)
                return np.concatenate([logistic_sums(x1, y, w, b), [np.sum((w * err)[~src]), np.sum(w[~src])]])
            s = yield self._wanted(state, kernel, k + k * k + 4)
            grow = n / s[-3]  # weights of mean 1
            return s[:k] * grow, s[k:k + k * k].reshape(k, k) * grow, s[-4] * grow, s[-2] / s[-1] if s[-1] else 0.0
        b, error = yield from newton(evaluate, start, np.append(np.full(k - 1, 1.0 / self.C), 0.0), self.tol)
        return b, 1.0, float(error)

    def _least_squares(self, state, start) -> Generator:
        k = len(start)
        b = solve_gram((yield self._wanted(state, lambda x1, y, src, w: gram_sums(x1, y, w), k + k * k)))

        def kernel(x1, y, src, w):
            err = np.abs(x1 @ b - y)
            return np.array([np.sum((w * err)[~src]), np.sum(w[~src]), err.max(initial=-np.inf)])
        num, den, top = yield self._wanted(state, kernel, 3, 1)
        return b, top + EPS, float(num / den / (top + EPS)) if den else 0.0

    def sample_weights(self, df: DataFrame) -> DataFrame:
        """``df`` (the training rows) with the last round's weights
        ``_w``, which sum to 1."""
        state, scale, total, shift = self.rounds_, self.scale_, self.total_, self.rounds_.bound()

        def values(r):
            x1 = scale(r["features"])
            return np.exp(state.log_weights(x1, r["label"].astype(float), r["domain"] == 0) - shift) / total
        return with_values(df, values, "_w", needs=("label", "domain"), features=self.features)

    def predict(self, df: DataFrame) -> DataFrame:
        """Vote of the last ⌈N/2⌉ models, probabilities weighted by
        −ln(E/(2−E)) (ties: class 0). K12: their weighted median."""
        half = int(len(self.models_) / 2)
        models, weights, scale = np.column_stack(self.models_[half:]), np.array(self.estimator_weights_[half:]), self.scale_
        if self.regression:
            return with_values(df, lambda r: median_of(scale(r["features"]) @ models, weights), "prediction", features=self.features)
        return with_values(df, self.vote(), "prediction", "int", features=self.features)

    def vote(self) -> Callable[[dict], np.ndarray]:
        half = int(len(self.models_) / 2)
        models, weights, scale = np.column_stack(self.models_[half:]), np.array(self.estimator_weights_[half:]), self.scale_

        def run(r):
            p = sigmoid(scale(r["features"]) @ models)
            return ((p @ weights) > ((1 - p) @ weights)).astype(np.int32)
        return run


# --- K13–K16: two-stage regression boosting -----------------------------------

@dataclass
class Stage:
    """A finished K13 boosting: models (columns), their weights, the largest
    error of their median and the beta that lowered the source weights."""
    models: np.ndarray
    weights: np.ndarray
    top: float = 1.0
    beta: float = 1.0

    def median(self, x1):
        half = int(self.models.shape[1] / 2)
        return median_of(x1 @ self.models[:, half:], self.weights[half:])


class LinearTwoStage:
    """K14 with K13, K15 and K16, least-squares base learner.

    Each of ``n_estimators`` steps scores the current weights by
    cross-validation over target slices, fits the fixed-source AdaBoost.R2
    (``n_estimators_fs`` rounds), and lowers the source weights by β^err, with
    β chosen so that the target's share of the weight follows the schedule.
    The step with the lowest score predicts.

    The cross-validation costs two passes however many slices there are: Gram
    matrices are summed by slice, and a training side is the total less its
    own; then the errors of every slice under its own model."""

    GRID, PASSES = 64, 4  # β to 64**-4

    def __init__(self, n_estimators: int = 10, n_estimators_fs: int = 10, cv: int = 5, lr: float = 1.0, key: str = "filename",
                 features: str = "features"):
        self.n_estimators, self.n_fs, self.cv, self.lr, self.key, self.features = n_estimators, n_estimators_fs, cv, lr, key, features

    def _sums(self, kernel, size, tops=0):
        """``kernel(x1, y, source, slice, weight)`` with the step's weights."""
        self.steps_ += 1
        scale, stages, lr = self.scale_, list(self.lowered_), self.lr

        def run(r):
            x1, y, src = scale(r["features"]), r["label"], r["domain"] == 0
            w = np.ones(len(y))
            for s in stages:
                w = np.where(src, w * s.beta ** (lr * np.abs(s.median(x1) - y) / s.top), w)
            return kernel(x1, y, src, r["slice"], w)
        return self.rows_.sums(run, size, tops)

    def _boost(self, k: int) -> tuple[Stage, list[float]]:
        """AdaBoost.R2 with the source weights frozen; target weights
        times β^(lr·(1 − err)), rescaled to the target's share."""
        models, tops, betas, errors, lr = [], [], [], [], self.lr

        def split(x1, y, src, w):
            """Weights of (source, target) rows, the target's up to a factor."""
            t = w.copy()
            for b, top, beta in zip(models, tops, betas):
                t *= beta ** (lr * (1 - np.abs(x1 @ b - y) / top))
            return w * src, t * ~src

        for i in range(self.n_fs):
            def grams(x1, y, src, _, w):
                s, t = split(x1, y, src, w)
                return np.concatenate([gram_sums(x1, y, s), gram_sums(x1, y, t), [np.sum(w)]])
            half = k + k * k
            got = self._sums(grams, 2 * half + 1)
            source = got[half - 1] / got[-1]
            to_s, to_t = 1 / got[-1], (1 - source) / got[2 * half - 1] if got[2 * half - 1] else 0.0
            b = solve_gram(got[:half] * to_s + got[half:2 * half] * to_t)

            def misses(x1, y, src, _, w):
                s, t = split(x1, y, src, w)
                err = np.abs(x1 @ b - y)
                return np.array([np.sum((s * to_s + t * to_t) * err), err.max()])
            num, top = self._sums(misses, 2, 1)
            models.append(b)
            tops.append(top + EPS)
            errors.append(float(num / (top + EPS)))
            betas.append(errors[-1] / (2.0 - errors[-1]))
        return Stage(np.column_stack(models), np.array([model_weight(e) for e in errors])), errors

    def _cv_score(self, k: int, cv: int) -> float:
        """Mean over the slices of the mean absolute error outside the
        training side; the target keeps its mass without the slice."""
        half = k + k * k

        def grams(x1, y, src, part, w):
            return np.concatenate([gram_sums(x1, y, w * (part == s)) for s in range(-1, cv)])
        got = self._sums(grams, (cv + 1) * half).reshape(cv + 1, half)
        target = got[1:].sum(0)
        rest = target - got[1:]
        grow = [target[-1] / r[-1] if r[-1] > 0 else 1.0 for r in rest]
        models = np.column_stack([solve_gram(got[0] + r * g) for r, g in zip(rest, grow)])

        def misses(x1, y, src, part, w):
            own = np.flatnonzero(part >= 0)
            s = part[own].astype(int)
            err = np.abs(np.einsum("ij,ji->i", x1[own], models[:, s]) - y[own])
            return np.concatenate([np.bincount(s, err, cv), np.bincount(s, minlength=cv)])
        err = self._sums(misses, 2 * cv)
        return float(np.mean(err[:cv] / err[cv:]))

    def _beta(self, stage: Stage, share: float) -> float:
        """The β at which the source's weight falls to the target's
        weight times (1 − share) / share; grids within grids."""
        lr, lo, hi = self.lr, 0.0, 1.0
        for _ in range(self.PASSES):
            betas = np.linspace(lo, hi, self.GRID + 1)

            def kernel(x1, y, src, _, w):
                err = np.abs(stage.median(x1[src]) - y[src]) / stage.top
                return np.append([np.sum(w[src] * x ** err) for x in betas], np.sum(w[~src]))
            got = self._sums(kernel, self.GRID + 2)
            goal = got[-1] * (1 - share) / share
            above = np.flatnonzero(got[:-1] >= goal)
            if not len(above) or above[0] == 0:
                return float(betas[0 if len(above) else -1])
            lo, hi = betas[above[0] - 1], betas[above[0]]
        return float((lo + hi) / 2)

    def fit(self, df: DataFrame) -> "LinearTwoStage":
        from .adapt import target_slices
        self.steps_, self.scores_, self.stages_, self.lowered_, self.fs_errors_ = 0, [], [], [], []
        k = width(df, self.features) + 1
        c = df.agg(F.count("*").alias("n"), F.count_if(F.col("domain") != 0).alias("t")).first()
        n, nt = c["n"], c["t"]
        if not nt:
            raise ValueError("two-stage boosting needs target rows")
        cv = min(self.cv, nt)
        sliced = target_slices(df, cv, self.key).withColumn("slice", F.coalesce("slice", F.lit(-1)))
        with Rows(sliced, "slice", features=self.features) as self.rows_:
            ((_, self.scale_),) = together(self.rows_, [scaling(lambda r: r["features"], k - 1)])
            for step in range(self.n_estimators):
                self.scores_.append(self._cv_score(k, cv))
                stage, errors = self._boost(k)
                self.stages_.append(stage)
                self.fs_errors_.append(errors)
                if step < self.n_estimators - 1:
                    top = self._sums(lambda x1, y, src, _, w: np.array([np.abs(stage.median(x1) - y).max()]), 1, 1)[0]
                    stage.top = top + EPS
                    stage.beta = self._beta(stage, nt / n + step / (self.n_estimators - 1) * (1 - nt / n))
                    self.lowered_.append(stage)
            self.best_ = int(np.argmin(self.scores_))
            self.lowered_ = self.lowered_[:self.best_]
            self.total_ = self._sums(lambda x1, y, src, _, w: np.array([w.sum()]), 1)[0]
        return self

    def sample_weights(self, df: DataFrame) -> DataFrame:
        """The row weights of the step with the best score."""
        scale, stages, lr, total = self.scale_, self.lowered_, self.lr, self.total_

        def values(r):
            x1, y, src = scale(r["features"]), r["label"].astype(float), r["domain"] == 0
            w = np.full(len(y), 1 / total)
            for s in stages:
                w = np.where(src, w * s.beta ** (lr * np.abs(s.median(x1) - y) / s.top), w)
            return w
        return with_values(df, values, "_w", needs=("label", "domain"), features=self.features)

    def predict(self, df: DataFrame) -> DataFrame:
        stage, scale = self.stages_[self.best_], self.scale_
        return with_values(df, lambda r: stage.median(scale(r["features"])), "prediction", features=self.features)


class LinearR2FixedSource(LinearTwoStage):
    """K13 alone: ``n_estimators`` rounds from equal weights."""

    def __init__(self, n_estimators: int = 10, lr: float = 1.0, features: str = "features"):
        super().__init__(1, n_estimators, lr=lr, features=features)

    def fit(self, df: DataFrame) -> "LinearR2FixedSource":
        self.steps_, self.lowered_, self.best_ = 0, [], 0
        k = width(df, self.features) + 1
        with Rows(df.withColumn("slice", F.lit(-1)), "slice", features=self.features) as self.rows_:
            ((_, self.scale_),) = together(self.rows_, [scaling(lambda r: r["features"], k - 1)])
            stage, self.errors_ = self._boost(k)
        self.stages_, self.estimator_weights_ = [stage], list(stage.weights)
        return self
