"""Toxicity: a linear classifier over character n-grams, whose features are
scaled by naive Bayes log-count ratios.

Features: hashed character n-grams (``ORDERS``) of the whole lower-cased
text, present or not. r = log((p + a) / |p|) - log((q + a) / |q|) from the
class-wise document counts, 0 where it is below SIGNAL times its standard
error; a logistic regression is fitted over x * r, and
its intercept is moved from the balanced sample to the class shares of all
training labels. The fit takes at most ``MAX_ROWS`` labelled rows a class
(the smallest hashes of their ids); every text is scored whole.

Null texts count as empty; an empty text gets the intercept's score. Labels
that are null, or of ids that no document has, are not used; of repeated
labels the majority counts, ties as toxic. With no label of one class the
score of every text is the share of toxic labels (0 without any label).
Extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

ORDERS = (3, 4, 5)
BITS = 18
MAX_ROWS = 2000
SMOOTH = 0.5
L2 = 5.0
STEPS = 60
SIGNAL = 2.5


class Features:
    """Distinct hashed n-grams of a text; holds one scratch array."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        parts, h = [], c
        for n in range(2, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:]  # the hash of n characters
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
                parts.append((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS))
        if not parts:
            return np.empty(0, np.int64)
        i = np.concatenate(parts).astype(np.int64)
        order = np.arange(len(i))
        self.last[i] = order
        return i[self.last[i] == order]


@dataclass
class Model:
    weights: np.ndarray  # regression weight times log-count ratio
    bias: float

    def score(self, features: np.ndarray) -> float:
        z = self.bias + float(self.weights[features].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_arrays(docs: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """Fit on feature arrays; ``share`` is the toxic share of all labels."""
    y = y.astype(float)
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(size), float(np.log(share / (1 - share))))
    p, q = (np.bincount(np.concatenate([d for d, t in zip(docs, y) if t == c] or [np.empty(0, np.int64)]), minlength=size) + SMOOTH for c in (1, 0))
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    # Ratios within their own error carry no signal; a long text has thousands.
    r[np.abs(r) < SIGNAL * np.sqrt(1 / p + 1 / q)] = 0
    lens = np.array([len(d) for d in docs])
    idx = np.concatenate(docs).astype(np.int32)
    idx, lens = idx[r[idx] != 0], np.add.reduceat(np.concatenate([(r[idx] != 0).astype(np.int64), [0]]), np.concatenate(([0], np.cumsum(lens)[:-1]))) * (lens > 0)
    rows = np.repeat(np.arange(len(y), dtype=np.int32), lens)
    used, idx = np.unique(idx, return_inverse=True)
    scale = r[used]
    w, b = np.zeros(len(used)), 0.0
    m = v = np.zeros(len(used) + 1)
    per = 1.0 / np.array([(y == 0).sum(), (y == 1).sum()])[y.astype(int)] / 2  # classes weigh alike
    for t in range(1, STEPS + 1):
        z = b + np.bincount(rows, (w * scale)[idx], minlength=len(y))
        g = per * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.append(np.bincount(idx, g[rows], minlength=len(used)) * scale + L2 * w / len(y), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(size)
    out[used] = w * scale
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(out, float(b + np.log(share / (1 - share))))


def _feature_rows(batches):
    feats = Features()
    for batch in batches:
        texts, y = batch.column(0).to_pylist(), batch.column(1)
        for i in range(0, len(texts), 64):
            yield pa.RecordBatch.from_arrays([pa.array([feats(t).astype("<i4").tobytes() for t in texts[i:i + 64]], pa.binary()), y[i:i + 64]], names=["f", "y"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit from the rows of ``labels`` given (the caller leaves out what is
    held out). The labels are grouped and sampled without texts; only the
    sampled texts are read into features, and the fit runs in one task over
    at most 2 * ``max_rows`` of them."""
    own = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("i")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y")))
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # A label counts only if its document is there.
    own = own.join(texts.select("i").distinct(), "i", "left_semi")
    there = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = there.get(1, 0) / max(1, sum(there.values()))

    def smallest(c):
        # Twice the rows wanted pass the filter, so few rows are sorted.
        part = min(1.0, 2 * max_rows / max(1, there.get(c, 0)))
        h = F.xxhash64("i")
        return own.filter((F.col("y") == c) & (F.pmod(h, F.lit(1_000_000)) < part * 1_000_000)).orderBy(F.pmod(h, F.lit(1_000_000)), h, "i").limit(max_rows)
    pick = [smallest(0), smallest(1)]
    sample = pick[0].union(pick[1])  # at most 2 * max_rows narrow rows
    rows = texts.join(F.broadcast(sample), "i").select("t", "y")

    def fit(batches):
        f, y = [], []
        for b in batches:
            f += [np.frombuffer(x, "<i4") for x in b.column(0).to_pylist()]
            y += b.column(1).to_pylist()
        m = fit_arrays(f, np.array(y), share)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype("<f4").tobytes()], pa.binary()), pa.array([m.bias])], names=["w", "b"])

    got = (rows.mapInArrow(_feature_rows, "f binary, y int").repartition(1)
           .mapInArrow(fit, "w binary, b double").first())
    return Model(np.frombuffer(got["w"], "<f4").astype(float), got["b"])


def score(docs_text, model: Model, spark):
    """Score column of a text column; the model (1 MB) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def toxicity(t: pd.Series) -> pd.Series:
        feats, m = Features(), shared.value
        return pd.Series([m.score(feats(x or "")) for x in t], dtype=float)
    return toxicity(docs_text)
