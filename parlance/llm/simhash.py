"""SimHash near-duplicates by a byte-position index with count filtering.

A fingerprint is 64 majority bits over the XXH64 of the word shingles. Two
fingerprints that differ in at most ``max_bits`` = 4 bits share at least
8 - 4 = 4 of their 8 positional bytes. The inverted index posts each distinct
fingerprint under (positions, bytes) for 20 triples of positions chosen so
that any four positions contain one of them whole (Turan's covering of
4-subsets by triples); so every pair with four shared bytes meets in a list.
In a list, the shared positional bytes of each pair are tallied, pairs below
four are dropped, the rest are verified by bit distance, and only a spanning
forest of the verified links leaves the task: no pair list is emitted and no
link between two fingerprints can be lost. Lists beyond ``block`` postings
are split into blocks and every pair of blocks is a group of its own.

Equal texts and equal fingerprints collapse first (a combined minimum), so a
group of copies is one posting. Texts without words, null and empty ones have
fingerprint zero and link like any other. Repeated rows and equal ids keep
their rows; null ids take part, and a component's id is the smallest id that
is not null. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import components, fresh, hub

_SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one text given as UTF-8 bytes."""
    import xxhash
    words = text.lower().split()  # bytes: A-Z only, and blanks \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), ends[k - 1:].tolist())
    digests = [h(joined[a:b], seed) for a, b in spans]
    for i in range(0, n, _SLICE):
        block = np.array(digests[i:i + _SLICE], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text, shingle: int):
    """Column of signed 64-bit fingerprints of a text column."""
    @pandas_udf("long")
    def simhash64(t: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x or b"", shingle) for x in t], dtype="int64")
    return simhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def position_sets() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that any 4 positions hold one.

    Three classes; the triples inside a class, and those with two positions
    in a class and one in the next class."""
    cls = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        c = sorted(cls[p] for p in t)
        pair = next((x for x in c if c.count(x) == 2), None)
        if len(set(c)) == 1 or pair is not None and (pair + 1) % 3 in c:
            out.append(t)
    return out


def _spanning(a: np.ndarray, max_bits: int, least: int):
    """Edges of a spanning forest of the verified links in a group."""
    by = a.view(np.uint8).reshape(-1, 8)
    link_a, link_b = [], []
    for i in range(0, len(a), 256):
        tally = np.zeros((min(256, len(a) - i), len(a)), np.uint8)
        for p in range(8):
            tally += by[i:i + 256, p, None] == by[None, :, p]
        x, y = np.nonzero(tally >= least)
        x += i
        keep = x < y
        x, y = x[keep], y[keep]
        near = np.bitwise_count(a[x] ^ a[y]) <= max_bits
        link_a.append(x[near])
        link_b.append(y[near])
    x, y = np.concatenate(link_a), np.concatenate(link_b)
    root = np.arange(len(a))
    while len(x):  # smallest index reachable; each round at least one merge
        rx, ry = root[x], root[y]
        far = rx != ry
        x, y, rx, ry = x[far], y[far], rx[far], ry[far]
        if not len(x):
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    kept = np.nonzero(root != np.arange(len(a)))[0]
    return a[kept], a[root[kept]]


def _verify(max_bits: int, least: int):
    def run(batches):
        # Rows come sorted by group; the last group of a batch waits for the
        # next batch. A group is at most two blocks.
        out_u, out_v = [], []
        left_k, left_f = np.empty((0, 3), np.int64), np.empty(0, "<u8")

        def groups(k, f):
            cut = np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1
            for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))):
                if b - a == 2:
                    x = f[a] ^ f[a + 1]
                    if x and int(x).bit_count() <= max_bits:
                        out_u.append(f[a:a + 1])
                        out_v.append(f[a + 1:b])
                elif b - a > 2:
                    u, v = _spanning(f[a:b], max_bits, least)
                    out_u.append(u)
                    out_v.append(v)

        def flush():
            u, v = np.concatenate(out_u).view("<i8"), np.concatenate(out_v).view("<i8")
            out_u.clear()
            out_v.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            f = batch.column(3).to_numpy(zero_copy_only=False).view("<u8")
            k, f = np.concatenate([left_k, k]), np.concatenate([left_f, f])
            if not len(k):
                continue
            last = len(k) - int(np.argmin((k[::-1] == k[-1]).all(1))) if not (k == k[-1]).all() else 0
            groups_k, groups_f = k[:last], f[:last]
            left_k, left_f = k[last:], f[last:]
            if len(groups_k):
                groups(groups_k, groups_f)
            if sum(map(len, out_u)) > 50_000:
                yield flush()
        if len(left_k):
            groups(left_k, left_f)
        if out_u:
            yield flush()
    return run


def link_fingerprints(fps: DataFrame, max_bits: int = 4, block: int = 1024) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` exactly as
    all links within ``max_bits`` would."""
    least = 8 - max_bits
    if least < 4:
        raise ValueError("the index covers pairs that share at least four positional bytes")

    def byte(p):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    keys = [F.lit(j).cast("long") * (1 << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c)
            for j, (a, b, c) in enumerate(position_sets())]
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    lists = posted.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    # A list of one block goes once; else each posting goes to every pair of
    # blocks that its own block is in.
    rows = (posted.join(lists, "k").withColumn("g", blocks).withColumn("b", mine)
            .select("k", "fp", "b", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
            .select("k", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "fp"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "k", "x", "y").sortWithinPartitions("k", "x", "y", "fp")
            .mapInArrow(_verify(max_bits, least), "u long, v long"))


def fingerprint_groups(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, comp, keep_id) of every distinct fingerprint: its component's
    smallest fingerprint and smallest document id. Input: (fp, doc_id)."""
    own = hub(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    comp = components(link_fingerprints(own.select("fp"), max_bits))
    named = (own.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("comp", F.coalesce("comp", "fp")))
    ids = named.groupBy("comp").agg(F.min("doc_id").alias("keep_id"))
    return hub(named.select("fp", "comp").join(ids, "comp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    fps = hub(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp")))
    groups = fingerprint_groups(fps, max_bits).select("fp", F.col("keep_id").alias("component_id"))
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the
    smallest id (of rows that repeat it, one)."""
    fps = hub(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp")))
    groups = fingerprint_groups(fps, max_bits)
    times = fps.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    chosen = (fps.join(groups, "fp").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
              .groupBy("comp", "keep_id").agg(F.min("fp").alias("fp")))
    keep, rep, want = fresh(docs, "keep_id", "repeated", "keep_fp")
    kept = hub(chosen.join(times, chosen.keep_id.eqNullSafe(times.doc_id), "left")
               .select(F.col("keep_id").alias(keep), F.col("fp").alias(want), F.col("n").isNotNull().alias(rep)))
    plain = docs.join(kept.filter(~F.col(rep)).select(keep), docs[id_col].eqNullSafe(F.col(keep)), "left_semi")
    again = kept.filter(rep)
    if again.isEmpty():
        return plain
    # Rows that share an id are told apart by their fingerprints.
    same = (docs.join(again, docs[id_col].eqNullSafe(F.col(keep)))
            .filter(fingerprints(F.col(text_col), shingle) == F.col(want)).dropDuplicates([want]))
    return plain.unionByName(same.select(*docs.columns))
