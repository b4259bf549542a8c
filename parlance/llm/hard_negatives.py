"""Hard-negative mining by slot-decomposed selection.

A row's vector is scaled and floored to integers; a pair's score is the inner
product. An anchor's positives are its first ``n_pos`` other rows of the same
label. Every positive asks for the first ``n_neg`` rows of another label with
a score at most its own and at least ``low / high`` of it: overlapping
windows. The positives' scores cut the scores into disjoint slots. One pass
over the rows keeps, in every task, the first ``n_neg`` rows of each anchor's
slot; Spark keeps the first of these over all tasks; an anchor's slots in
descending order, from a positive's own slot down, are then merged for each of
its windows. So all windows of an anchor are answered by one pass, and a row
is compared once.

Order: higher score first, ties by smaller id (null ids after all others).
Anchors are taken in blocks of bounded size (``BLOCK_BYTES`` of vectors), each
compared with all rows by a matrix product within Spark's own input
partitions: nothing is shuffled but the kept rows, and a label that holds a
third of the rows costs no more than others. Integer scores are exact: doubles
carry them up to 2**53, Python integers beyond that (results above 64 bits are
cut to the largest long).

Defined results: rows with a null label or vector, or with null or non-finite
components, take no part. Missing components of shorter vectors count as 0. A
row with the anchor's id is the anchor itself; other repeated rows are rows
like others, and a repeated anchor is answered once per row. An anchor
without positives, and a positive without rows in its window, return nothing.
Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hub, quiet_threads

BLOCK_BYTES = 64_000_000
FOUND = "anchor int, slot int, id long, score long"
_LAST = np.iinfo(np.int64).max  # stands for a null id in the order


def usable(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, label, vec) of the rows that take part."""
    vec = F.col(vector_col).cast("array<double>")
    return (vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vec.alias("vec"))
            .filter(F.col("label").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))))


def matrix(column: pa.ListArray, scale: float) -> np.ndarray:
    """Scaled, floored vectors, short ones filled with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    flat = np.floor(scale * flat[offsets[0]:offsets[-1]])
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), size[0])
    out = np.zeros((len(size), max(size, default=0)))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two integer-valued matrices."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0 ** 53:
        return a @ b.T
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.vectorize(lambda x: max(-_LAST, min(_LAST, x)), otypes=[np.int64])(exact)


def first(key: list[np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` entries of each key by (score, id)."""
    order = np.lexsort((ids, -score, *key[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in key], axis=0)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _best(scores: np.ndarray, valid: np.ndarray, k: int):
    """(row, column) of every valid entry that may be one of its row's first
    ``k``: those not below the k-th largest, ties included."""
    masked = np.where(valid, scores.astype(float), -np.inf)
    if masked.shape[1] > k:
        valid = valid & (masked >= np.partition(masked, masked.shape[1] - k, axis=1)[:, -k][:, None])
    return np.nonzero(valid)


def _positives(scores, same, limits, high, low):
    yield 0, same


def _slots(scores, same, limits, high, low):
    """Slot s holds the scores at most limit s and above limit s + 1; below
    ``low / high`` of its own limit no window reaches them."""
    for s in range(limits.shape[1]):
        top = limits[:, s:s + 1]
        below = limits[:, s + 1:s + 2] if s + 1 < limits.shape[1] else np.full_like(top, -np.inf)
        yield s, ~same & (scores <= top) & (scores > below) & (high * scores >= low * top)


def _scan(block, select, k: int, scale: float, low: int, high: int):
    def run(batches):
        quiet_threads()
        a_id, a_label, a_vec, limits, codes = block.value
        kept = [np.empty(0, np.int64) for _ in range(4)]  # anchor, slot, id, score
        nulls = False
        for batch in batches:
            ids, vec = batch.column(0), matrix(batch.column(2), scale)
            nulls |= ids.null_count > 0
            ids = ids.fill_null(_LAST).to_numpy()
            labels = np.array([codes.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for lo in range(0, len(a_id), 256):
                part = slice(lo, lo + 256)
                scores = products(a_vec[part], vec)
                same = a_label[part, None] == labels[None, :]
                other = a_id[part, None] != ids[None, :]
                for slot, valid in select(scores, same, limits[part], high, low):
                    row, col = _best(scores, valid & other, k)
                    fresh = (row + lo, np.full(len(row), slot), ids[col], scores[row, col].astype(np.int64))
                    kept = [np.concatenate(x) for x in zip(kept, fresh)]
            keep = first(kept[:2], kept[3], kept[2], k)
            kept = [x[keep] for x in kept]
        ids = pa.array(kept[2], mask=kept[2] == _LAST) if nulls else pa.array(kept[2])
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[1].astype(np.int32)), ids, pa.array(kept[3])],
                                         names=["anchor", "slot", "id", "score"])
    return run


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(anchors: DataFrame, block_bytes: int):
    """Anchors as lists of rows, each list bounded by its vectors' bytes."""
    held, size = [], 0
    for r in anchors.toLocalIterator():
        held.append(r)
        size += 8 * len(r["vec"]) + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def mine(vectors: DataFrame, is_anchor: Column, label: Column, n_pos: int = 5, n_neg: int = 5, low: int = 80,
         high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): up to ``n_neg`` rows a positive. ``is_anchor`` and
    ``label`` are expressions over the columns of ``vectors``."""
    spark = vectors.sparkSession
    rows = usable(vectors, label, id_col, vector_col)
    anchors = hub(usable(vectors.filter(is_anchor), label, id_col, vector_col))
    out = None
    for held in _blocks(anchors, block_bytes):
        ids = np.array([_LAST if r["id"] is None else r["id"] for r in held], np.int64)
        codes = {x: i for i, x in enumerate(dict.fromkeys(r["label"] for r in held))}
        labels = np.array([codes[r["label"]] for r in held], np.int64)
        vec = matrix(pa.array([r["vec"] for r in held], pa.list_(pa.float64())), scale)

        def scan(select, k, limits):
            block = spark.sparkContext.broadcast((ids, labels, vec, limits, codes))
            return rows.mapInArrow(_scan(block, select, k, scale, low, high), FOUND)

        positive = hub(_ranked(scan(_positives, n_pos, np.empty((len(held), 0))), n_pos, "anchor"))
        # Upper limits in descending order; as many rows as the block has anchors.
        limits = np.full((len(held), n_pos), -np.inf)
        for r in positive.select("anchor", "rank", "score").toLocalIterator():
            limits[r["anchor"], r["rank"] - 1] = r["score"]
        kept = _ranked(scan(_slots, n_neg, limits), n_neg, "anchor", "slot")
        # At most n_pos * n_neg entries an anchor, in descending order.
        slots = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
            (-F.col("score")).alias("s"), F.col("id").isNull().alias("none"), F.col("id")))).alias("list"))
        name = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(held)], "anchor int, anchor_id long")
        asked = positive.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(slots, "anchor").join(name, "anchor")
        suffix = F.filter("list", lambda x: (-x["s"] <= F.col("positive_score")) & (low * F.col("positive_score") <= -high * x["s"]))
        got = (asked.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(suffix, 1, n_neg)).alias("rank", "x"))
               .select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("negative_id"),
                       "positive_score", (-F.col("x.s")).alias("negative_score")))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 5
"""
