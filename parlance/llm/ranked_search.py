"""Ranked lexical search over hashed max-sketches.

Terms are the runs of ASCII letters and digits and of all characters beyond
ASCII; only A-Z is lower-cased. A document's impact of a term grows with the
term's frequency and shrinks with the document's length, a term's weight is
its inverse document frequency, and a document's score for an item sums weight
times impact over the item's distinct terms, all in integers.

One pass counts N (documents with terms), L (all terms) and the document
frequency of the items' terms. The second pass goes through the documents
where they are read, in small batches. Each document's impacts are folded into
a sketch: a term's hash names a coordinate, which holds the largest impact of
all terms that share it, rounded up. The sketch's width grows with the
document's distinct terms, so that its looseness does not. All items are
looked up in a batch's sketches at once: weight times coordinate, summed, is
at least the score. Per item the documents are scored exactly in descending
order of that bound, until the bound falls below the ``k``-th best score that
the task has found. A task returns at most ``k`` rows an item; Spark keeps the
best ``k`` of all tasks.

So no document is cut off by the sketch, nothing is shuffled but ``k`` rows an
item and task, and a word that stands in every document costs no more than
others. Items go through in blocks of at most ``BLOCK_TERMS`` distinct terms;
a block is broadcast, a larger set of items takes more passes.

Order: higher score first, ties by smaller doc_id (null ids after all
others). Defined results: null and empty texts have no terms and are not
found; items without terms return nothing. Each row of documents and of items
is one of its own, also with equal ids. Terms of weight 0 add nothing. Empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quiet_threads

BLOCK_TERMS = 200_000
# Coordinates a distinct term; impacts are kept in units of STEP, rounded up.
ROOM = 8
STEP = 16
BATCH_BYTES = 4_000_000
BATCH_CELLS = 4_000_000
_LAST = np.iinfo(np.int64).max
# Bytes of terms, A-Z lower-cased; all other bytes to a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


class Batch:
    """The term counts of a few documents: ``keys`` are document * V + term,
    ascending, with their counts ``tf``; ``vocab`` are the V terms."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b" ".join(texts).translate(_TERM_BYTES), np.uint8)
        solid = buf != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
        start, length = edge[::2], edge[1::2] - edge[::2]
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        doc = np.searchsorted(begin, start, "right") - 1
        offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[solid])]).dictionary_encode()
        self.docs, self.vocab = len(texts), found.dictionary
        self.v = max(len(self.vocab), 1)
        self.n = np.bincount(doc, minlength=self.docs).astype(np.int64)
        self.keys, self.tf = np.unique(doc * self.v + found.indices.to_numpy(), return_counts=True)

    def impacts(self, big_n: int, big_l: int) -> np.ndarray:
        m = 100 - 90 + (90 * self.n * big_n) // big_l
        return (1_000_000_000 * self.tf) // (1000 * self.tf + 8 * m[self.keys // self.v])

    def sketch(self, impacts: np.ndarray):
        """(cells, base, width): a document's coordinates begin at its base;
        widths are powers of two."""
        doc, term = np.divmod(self.keys, self.v)
        distinct = np.bincount(doc, minlength=self.docs)
        width = 1 << np.ceil(np.log2(np.maximum(ROOM * distinct, 1))).astype(np.int64)
        base = np.concatenate(([0], np.cumsum(width)[:-1]))
        cells = np.zeros(int(width.sum()), np.uint16)
        np.maximum.at(cells, base[doc] + (hashes(self.vocab)[term] & (width[doc] - 1)), (-(-impacts // STEP)).astype(np.uint16))
        return cells, base, width


def hashes(vocab: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, vocab.to_pylist()), np.int64, len(vocab))


def batches_of(batch: pa.RecordBatch, cells: int):
    """(first row, texts) runs, bounded by bytes and by ``cells`` a row."""
    texts = [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
    rows, a, size = max(1, min(1024, BATCH_CELLS // max(cells, 1))), 0, 0
    for i, t in enumerate(texts):
        if i > a and (i - a >= rows or size + len(t) > BATCH_BYTES):
            yield a, texts[a:i]
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, texts[a:]


class Items:
    """A block of items: distinct terms, and per item the terms it holds."""

    def __init__(self, texts: list[bytes]):
        held = [sorted(set(terms(t))) for t in texts]
        self.terms = sorted(set().union(*held)) if held else []
        at = {t: i for i, t in enumerate(self.terms)}
        self.size = np.array([len(h) for h in held], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = np.array([at[t] for h in held for t in h], np.int64)  # terms by item
        item = np.repeat(np.arange(len(held)), self.size)
        order = np.argsort(self.flat, kind="stable")
        self.by_term = item[order]  # items by term
        self.posting = np.bincount(self.flat, minlength=len(self.terms)).astype(np.int64)
        self.posting_start = np.concatenate(([0], np.cumsum(self.posting)))
        self.hash = np.fromiter(map(zlib.crc32, self.terms), np.int64, len(self.terms))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] numbers) for every i."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


def _count(block):
    """(term, n) of a task: document frequencies; -1 is N and -2 is L."""
    def run(batches):
        quiet_threads()
        items = block.value
        wanted = pa.array(items.terms, pa.large_binary())
        df, docs, total = np.zeros(len(items.terms), np.int64), 0, 0
        for batch in batches:
            for _, texts in batches_of(batch, 1):
                b = Batch(texts)
                docs += int((b.n > 0).sum())
                total += int(b.n.sum())
                to = pc.index_in(b.vocab, value_set=wanted).fill_null(-1).to_numpy()
                hit = to >= 0
                df[to[hit]] += np.bincount(b.keys % b.v, minlength=len(to))[hit]
        term = np.concatenate((np.flatnonzero(df), [-1, -2]))
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(np.concatenate((df[df > 0], [docs, total])))], names=["term", "n"])
    return run


class Best:
    """The best ``k`` (score, id) of every item of a block."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.score, self.id = np.zeros(items, np.int64), np.full(items, _LAST)  # the k-th best

    def beats(self, item, score, ids):
        """Whether a document of that score (or bound) would come in."""
        return (score > self.score[item]) | ((score > 0) & (score == self.score[item]) & (ids < self.id[item]))

    def add(self, item: int, score: int, key: int, null: bool):
        heap = self.heaps[item]
        (heapq.heappush if len(heap) < self.k else heapq.heappushpop)(heap, (score, -key, null))
        if len(heap) == self.k:
            self.score[item], self.id[item] = heap[0][0], -heap[0][1]


def _search(block, weights: np.ndarray, big_n: int, big_l: int, k: int):
    def run(batches):
        quiet_threads()
        items = block.value
        n_items, vocab = len(items.size), pa.array(items.terms, pa.large_binary())
        best = Best(n_items, k)
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(_LAST).to_numpy()
            for a, texts in batches_of(batch, max(len(items.flat), n_items)):
                b = Batch(texts)
                impacts = b.impacts(big_n, big_l)
                bound = bounds(b, items, weights, impacts)
                code = pc.index_in(vocab, value_set=b.vocab).fill_null(-1).to_numpy()
                _rescore(b, items, weights, impacts, code, bound, ids[a:a + b.docs], null[a:a + b.docs], best)
        rows = [(i, None if none else -key, score) for i, heap in enumerate(best.heaps) for score, key, none in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                                         names=["item", "doc_id", "score"])
    return run


def bounds(b: Batch, items: Items, weights: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Upper bounds of all scores, (documents, items). The sums stay below
    2**53, so doubles hold them exactly."""
    cells, base, width = b.sketch(impacts)
    seen = cells[base[:, None] + (items.hash[None, :] & (width[:, None] - 1))]
    doc, term = np.nonzero(seen)
    size = items.posting[term]
    value = np.repeat(seen[doc, term].astype(float) * STEP * weights[term], size)
    to = np.repeat(doc * len(items.size), size) + items.by_term[_ranges(items.posting_start[term], size)]
    return np.bincount(to, value, minlength=b.docs * len(items.size)).reshape(b.docs, len(items.size))


def _rescore(b: Batch, items: Items, weights, impacts, code, bound, ids, null, best: Best, chunk: int = 8) -> None:
    """Exact scores in descending order of the bounds, ``chunk`` documents an
    item at a time, until no bound can come in any more."""
    todo = np.flatnonzero(best.beats(np.arange(len(items.size)), bound, ids[:, None]).any(axis=0))
    order = np.argsort(-bound[:, todo], axis=0, kind="stable")
    for lo in range(0, b.docs, chunk):
        doc, item = order[lo:lo + chunk].ravel(), np.tile(todo, min(chunk, b.docs - lo))
        may = best.beats(item, bound[doc, item], ids[doc])
        doc, item = doc[may], item[may]
        if len(doc):
            size = items.size[item]
            term = items.flat[_ranges(items.start[item], size)]
            key = np.repeat(doc * b.v, size) + code[term]
            at = np.minimum(np.searchsorted(b.keys, key), max(len(b.keys) - 1, 0))
            there = (code[term] >= 0) & (b.keys[at] == key)
            score = np.bincount(np.repeat(np.arange(len(doc)), size), np.where(there, weights[term] * impacts[at], 0), minlength=len(doc)).astype(np.int64)
            come = best.beats(item, score, ids[doc])
            for i, s, d in zip(item[come].tolist(), score[come].tolist(), doc[come].tolist()):
                best.add(i, s, int(ids[d]), bool(null[d]))
        # An item goes on while its next bound reaches its k-th best score.
        if lo + chunk < b.docs:
            more = bound[order[lo + chunk], todo] >= np.maximum(best.score[todo], 1)
            todo, order = todo[more], order[:, more]
        if not len(todo):
            return


def _blocks(items: DataFrame, block_terms: int):
    """Items as lists of (id, text bytes), bounded by their terms."""
    held, size = [], 0
    for r in items.toLocalIterator():
        text = (r["text"] or "").encode()
        n = len(set(terms(text))) + 1
        if held and size + n > block_terms:
            yield held
            held, size = [], 0
        held.append((r["item_id"], text))
        size += n
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents with the
    highest scores above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    out = spark.createDataFrame([], asked.select("item_id").schema).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for held in _blocks(asked, block_terms):
        block = spark.sparkContext.broadcast(Items([t for _, t in held]))
        counts = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_count(block), "term int, n long")
                  .groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
        big_n, big_l = counts.get(-1, 0), counts.get(-2, 0)
        if not big_l:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * big_n + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(block.value.terms))], np.int64)
        found = rows.mapInArrow(_search(block, weights, big_n, big_l, k), "item int, doc_id long, score long")
        name = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], "item int, item_id " + asked.schema["item_id"].dataType.simpleString())
        out = out.unionByName(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                              .join(name, "item").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE = """
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM low),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
m AS (SELECT doc_id, 100 - 90 + (90 * n * n_docs) // n_terms AS m FROM d, s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
hits AS (SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM hits WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
