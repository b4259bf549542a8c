"""The fold loop and the experiment grid.

A training set is a mask over one labelled table (fold, domain and corpus
columns), never a materialised copy. All cells of a grid that use logistic
regression (method × C × fold) are fitted together: each is a generator that
asks for sums, and one pass over the table serves every cell that is not done
(``linear.together``); a cell's scores are four counts of its last request.
Margin classifiers are one Spark ML fit a cell, submitted from a small thread
pool. Only sums and scores come back to the driver. Quirk 27 fixed: every
method runs, each fold gets a fresh model.

Methods, all tested on the target rows of the held-out fold: ``target_only``,
``source_only``, ``joint``, ``augment`` (K03), ``multiaugment`` (K05, a block
per source corpus, one for the target, one for all), ``coral`` (K06 from the
training target, fitted on the moved source), ``fmmd`` (K07 and K08 on the
training rows, fitted on the kept features of the source) and ``tradaboost``
(K09, source and training target).
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from . import adapt as ad
from . import evaluate as ev
from . import linear as lin

METHODS = ["target_only", "source_only", "joint", "augment"]
ALL_METHODS = [*METHODS, "multiaugment", "coral", "fmmd", "tradaboost"]
ROUNDS = 45  # boosting rounds of the reference's experiments
MOST_FOLDS = 100  # a fit per fold: more (leave-one-out of a large table) is an error


def _source(r):
    return r["domain"] == 0


def _train_target(fold: int):
    return lambda r: (r["domain"] == 1) & (r["fold"] != fold)


def _both(fold: int):
    train = _train_target(fold)
    return lambda r: _source(r) | train(r)


def _flag(column: str):
    return lambda r: r[column] == 1


def _augmented(r, x):
    t = (r["domain"] == 1)[:, None]
    return np.column_stack([x, x * ~t, x * t])


def _by_corpus(corpora: int):
    """A block per source corpus 0 .. corpora - 1, the target's, and a joint
    one; target rows have corpus ``corpora``."""
    return lambda r, x: np.column_stack([*[x * (r["corpus"] == c)[:, None] for c in range(corpora + 1)], x])


def _moments(mask, d: int) -> Generator:
    """(n, mean, covariance) of the features of some rows."""
    n, scale = yield from lin.scaling(lambda r: r["features"][mask(r)], d)

    def spread(r):
        x = r["features"][mask(r)] - scale.mean
        return (x.T @ x).ravel()
    s = yield lin.Wanted(spread, d * d)
    return n, scale.mean, s.reshape(d, d) / max(n - 1, 1)


def coral_layout(d: int, train_target) -> Generator:
    """K06 as a layout: source rows standardised and moved to the target's
    correlations, target rows standardised."""
    ns, ms, cs = yield from _moments(_source, d)
    nt, mt, ct = yield from _moments(train_target, d)
    if not ns or not nt:
        return None
    matrix, ss, st = ad.coral_matrix(ns, cs, nt, ct)
    ss, st = np.where(ss > 0, ss, 1.0), np.where(st > 0, st, 1.0)

    def layout(r, x):
        t = (r["domain"] == 1)[:, None]
        return np.where(t, (x - mt) / st, ((x - ms) / ss) @ matrix)
    return layout


def fmmd_layout(d: int, train_target) -> Generator:
    """K07 + K08 as a layout: features above the threshold are zeroed."""
    _, s = yield from lin.scaling(lambda r: r["features"][_source(r)], d)
    _, t = yield from lin.scaling(lambda r: r["features"][train_target(r)], d)
    square = (s.mean - t.mean) ** 2
    norm = np.sqrt(np.sum(square ** 2))
    weight = square / norm if norm else square
    order = np.argsort(weight, kind="stable")
    gaps = np.diff(weight[order])
    keep = weight <= (weight[order][int(np.argmax(gaps))] if len(gaps) else weight[0])
    return lambda r, x: x * keep


def logistic_cell(method: str, C: float, fold: int, d: int, corpora: int = 1, rounds: int = ROUNDS) -> Generator:
    """Fit one cell; returns a predictor over the columns, or None where its
    training rows hold less than two labels."""
    train = _train_target(fold)
    rows = {"target_only": train, "source_only": _source, "coral": _source, "fmmd": _source}.get(method, _both(fold))
    cell = lin.Cell(C, rows)
    if method == "tradaboost":
        labels = (yield lin.Wanted(lambda r: np.array([np.sum(rows(r)), r["label"][rows(r)].sum(), np.sum(train(r))]), 3))
        if not 0 < labels[1] < labels[0] or not labels[2]:
            return None
        model = yield from lin.LinearTrAdaBoost(rounds, C=C).run(cell, d)
        return model.vote()
    if method == "augment":
        cell = lin.Cell(C, rows, _augmented, 3 * d)
    elif method == "multiaugment":
        cell = lin.Cell(C, rows, _by_corpus(corpora), (corpora + 2) * d)
    elif method in ("coral", "fmmd"):
        layout = yield from (coral_layout if method == "coral" else fmmd_layout)(d, train)
        if layout is None:
            return None
        cell = lin.Cell(C, rows, layout, d)
    elif method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    model = yield from lin.fit_logistic(cell, d)
    return model and (lambda r: (model.probability(r) > 0.5).astype(int))


def scored_cell(fit: Generator, fold: int) -> Generator:
    """(tp, fp, fn, tn) of a cell's predictor on its held-out fold."""
    predict = yield from fit
    if predict is None:
        return None

    def kernel(r):
        test = (r["domain"] == 1) & (r["fold"] == fold)
        sub = {k: v[test] for k, v in r.items()}
        y, p = sub["label"] == 1, predict(sub) == 1
        return np.array([np.sum(y & p), np.sum(~y & p), np.sum(y & ~p), np.sum(~y & ~p)], float)
    return (yield lin.Wanted(kernel, 4))


def _scores(counts) -> tuple:
    """(n, accuracy, F1) rounded as the fold scores are."""
    if counts is None or not sum(counts):
        return 0, None, None
    tp, fp, fn, tn = counts
    f1 = 2 * tp / (2 * tp + fp + fn) if tp or fp or fn else 0.0
    return int(sum(counts)), round(float((tp + tn) / sum(counts)), 6), round(float(f1), 6)


# --- margin classifiers: one Spark ML fit a cell ---------------------------------

def training_set(t: DataFrame, method: str, fold: int, d: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) for one method and target fold; ``t`` holds
    ``features`` (array), ``label``, ``domain`` (0 source, 1 target), ``fold``."""
    tgt_test = (F.col("domain") == 1) & (F.col("fold") == fold)
    tgt_train = (F.col("domain") == 1) & (F.col("fold") != fold)
    src = F.col("domain") == 0
    if method == "target_only":
        train = t.filter(tgt_train)
    elif method == "source_only":
        train = t.filter(src)
    elif method in ("joint", "augment"):
        train = t.filter(src | tgt_train)
    else:
        raise ValueError(f"unknown method {method!r}")
    test = t.filter(tgt_test)
    if method == "augment":
        train = ad.augment(train, d).withColumn("features", F.col("aug")).drop("aug")
        test = ad.augment(test, d).withColumn("features", F.col("aug")).drop("aug")
    vec = array_to_vector(F.col("features"))
    return train.withColumn("features", vec), test.withColumn("features", vec)


def margin_cell(t: DataFrame, method: str, C: float, fold: int, d: int) -> dict:
    """L08 for a margin classifier: fit, predict, score one fold."""
    train, test = training_set(t, method, fold, d)
    labels = [r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()]
    row = {"method": method, "model": "svm", "C": C, "fold": fold, "n": 0, "acc": None, "fms": None}
    if len(labels) < 2:
        return row
    pred = ad.margin_classifier(C, sum(labels), weight_col="cw").fit(ad.class_balance_weights(train)).transform(test)
    s = ev.binary_scores(pred.select("label", F.col("prediction").cast("int").alias("prediction"))).first()
    return row | ({"n": int(s["n"]), "acc": float(s["acc"]), "fms": float(s["fms"])} if s and s["n"] else {})


def run_grid(spark, t: DataFrame, d: int, methods=METHODS, models=("lr",), Cs=(1.0,), folds=None,
             parallelism: int = 4, rounds=(ROUNDS,), corpora: int = 1, settings=()) -> DataFrame:
    """Methods × models × C × folds (tradaboost: × rounds); returns
    (method, model, C, rounds, fold, n, acc, fms), ``rounds`` null for the
    methods without. Margin classifiers run the first four methods. With
    ``settings`` (0/1 columns of ``t``) the logistic grid is run on the rows
    of each, in the same passes, and a column ``setting`` is added."""
    wanted = ["features", "label", "domain", "fold", "corpus", *settings]
    t = cut_lineage(t.select(*[c for c in wanted if c in t.columns]))
    if folds is None:
        folds = sorted(r["fold"] for r in t.filter("domain = 1").select("fold").distinct().limit(MOST_FOLDS + 1).collect())
        if len(folds) > MOST_FOLDS:
            raise ValueError(f"more than {MOST_FOLDS} folds: give the folds to run")
    out = []
    if "lr" in models:
        cells = [(s, m, C, n, k) for s, m, C, k in product(settings or (None,), methods, Cs, folds) for n in (rounds if m == "tradaboost" else (None,))]
        fits = [scored_cell(logistic_cell(m, C, k, d, corpora, n or ROUNDS), k) for _, m, C, n, k in cells]
        fits = [lin.within(f, _flag(s)) if s else f for f, (s, *_) in zip(fits, cells)]
        with lin.Rows(t, *[c for c in wanted[3:] if c in t.columns]) as rows:
            got = lin.together(rows, fits)
        out += [(m, "lr", float(C), n, int(k), *_scores(c), s) for (s, m, C, n, k), c in zip(cells, got)]
    if "svm" in models:
        cells = [(m, C, k) for m, C, k in product(methods, Cs, folds) if m in METHODS]
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            got = list(pool.map(lambda c: margin_cell(t, *c, d), cells))
        out += [(r["method"], "svm", float(r["C"]), None, int(r["fold"]), r["n"], r["acc"], r["fms"], None) for r in got]
    found = spark.createDataFrame(out, "method string, model string, C double, rounds int, fold int, n long, acc double, fms double, setting string")
    return found if settings else found.drop("setting")


def bias_summary(results: DataFrame, setting_col: str = "setting") -> DataFrame:
    """Mean and population std of accuracy and F1 across cohort mixes."""
    return ev.fold_summary(results, [setting_col, "method", "model"])


def fitted_weights(t: DataFrame, d: int, method: str = "augment", C: float = 1.0, folds=None) -> list[tuple[int, np.ndarray]]:
    """Standardised coefficients of a method's logistic model for every fold,
    in shared passes: the input of M07, M08 and M13."""
    t = cut_lineage(t.select(*[c for c in ("features", "label", "domain", "fold", "corpus") if c in t.columns]))
    folds = folds if folds is not None else sorted(r["fold"] for r in t.filter("domain = 1").select("fold").distinct().limit(MOST_FOLDS).collect())
    cells = [lin.Cell(C, _both(k), _augmented if method == "augment" else None, 3 * d if method == "augment" else d) for k in folds]
    with lin.Rows(t, "fold") as rows:
        models = lin.together(rows, [lin.fit_logistic(c, d) for c in cells])
    return [(int(k), m.standardised()) for k, m in zip(folds, models) if m is not None]
