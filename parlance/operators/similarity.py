"""H: pairwise utterance similarity within each transcript.

Each pair's TF-IDF is fitted on the pair alone: idf = ln(3 / (1 + df)) + 1,
i.e. 1 for a term in both texts and c = 1 + ln(3/2) for a term in one. With
raw tf and L2 norms, for a pair (a, b) with shared terms S:

    dot(a, b) = sum_S tf_a * tf_b
    |a|^2     = c^2 * sum_a tf_a^2 - (c^2 - 1) * sum_S tf_a^2

so everything a pair needs are three sums over the terms both texts hold.

The features H02-H05 need no pairs as rows. The utterances of a transcript are
dealt into blocks. The texts of a block are shuffled together and its words
made where they are used; one task gets the three sums of all pairs of its
blocks, of many small blocks together from the postings of their terms, of a
block of many common terms by products of its count matrix, and returns for
every block their number, sum, minimum and counts under the thresholds. What is
shuffled grows with the texts, not with their pairs. Only a transcript of
several blocks also meets across them: every pair of its blocks is a group of
bounded size, and a transcript of a third of all utterances is spread over as
many tasks as it has block pairs.

H01 returns the pairs that share a term, from an equi-join of the (filename,
term) posting lists. The postings of a term that many utterances of one
transcript hold are dealt into g blocks, and each pair of blocks is a join key
of its own: at most ``POSTINGS`` squared pairs come from a key, however hot
the term. Pairs that share no term have similarity 0 and are never made rows.
All pairs are kept: no sampling, no cap.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.frames import cut_lineage

C_ONE_SIDED = 1.0 + math.log(1.5)  # idf of a term present in one text of the pair
POSTINGS = 256  # postings of one (transcript, term) in a join key
BLOCK = 256  # utterances of one transcript in a block
BROADCAST_ROWS = 500_000  # transcripts of several blocks, listed to the tasks
CELLS = 4_000_000  # entries of a dense term matrix held at once
PAIRS = 2_000_000  # pairs of postings held at once


def utterance_terms(spark: SparkSession, utts: DataFrame, block: int | None = None) -> DataFrame:
    """B14 normalisation for similarity: strip punctuation, lower-case,
    tokenise, stem; stop words removed. Returns (filename, utt_idx, term, tf).

    Explode + stem + broadcast anti join + partial-aggregated count, all in
    whole-stage codegen (measured faster than counting inside each row with
    higher-order functions, which Spark evaluates without codegen).

    With ``block``, for ``matched_sums`` of that block size: (filename, block,
    utt_idx, term), a row an utterance with the array of its terms, uncounted.
    The texts, not the terms, are shuffled, and a term costs no row on the way
    to Python. Rows without a term are left in (Python drops them): a filter
    here is pushed below the shuffle and makes all terms a second time.
    """
    norm = F.lower(F.regexp_replace("text", tx.PUNCT_RE, ""))
    if block:
        term = F.filter(F.transform(tx.spaced_tokens("norm"), tx.light_stem), lambda w: ~w.isin(list(lx.STOP_WORDS)))
        dealt = _dealt(utts.select("filename", "utt_idx", "text"), block).withColumn("norm", norm)
        return dealt.select("filename", "block", "utt_idx", term.alias("term"))
    t = utts.select("filename", "utt_idx", F.explode(tx.tokens(norm)).alias("w"))
    t = t.select("filename", "utt_idx", tx.light_stem("w").alias("word"))
    t = t.join(lx.stop_words_df(spark), "word", "left_anti")
    return t.groupBy("filename", "utt_idx", F.col("word").alias("term")).agg(F.count("*").alias("tf"))


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows of a transcript's utterances with their ``block``; those of one
    block lie in one partition, one after the other."""
    rows = rows.filter(F.col("filename").isNotNull() & F.col("utt_idx").isNotNull())
    return (rows.withColumn("block", F.floor(F.col("utt_idx") / block).cast("long"))
            .repartition("filename", "block").sortWithinPartitions("filename", "block"))


def pair_cosine(terms: DataFrame, materialize: bool = True, postings: int = POSTINGS) -> DataFrame:
    """H01 for every pair (a < b) of one transcript sharing at least one term.

    The term table feeds both join sides and both norm look-ups, so it is
    checkpointed once (``materialize``) instead of re-tokenising per branch.
    """
    if materialize:
        terms = cut_lineage(terms)
    q = terms.groupBy("filename", "utt_idx").agg(F.sum(F.col("tf") * F.col("tf")).alias("q"))
    # Only terms used by two or more utterances of a transcript can pair up;
    # the others contribute to the norms (q) only and stay out of the join.
    # (A partial-aggregated count + join, not a window: a hot term is never
    # gathered into one task just to be counted.)
    multi = (terms.groupBy("filename", "term").agg(F.count("*").alias("_df")).filter(F.col("_df") > 1)
             .withColumn("_g", F.ceil(F.col("_df") / postings).cast("int")))
    dealt = terms.join(multi.select("filename", "term", "_g"), ["filename", "term"]).withColumn(
        "_b", F.pmod(F.xxhash64("utt_idx"), F.col("_g")).cast("int"))
    # Block i meets block j >= i once; a pair inside a block once, by order.
    x = dealt.select("filename", "term", F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_g") - 1)).alias("_j"),
                     F.col("utt_idx").alias("_x"), F.col("tf").alias("_tx"))
    y = dealt.select("filename", "term", F.explode(F.sequence(F.lit(0), "_b")).alias("_i"), F.col("_b").alias("_j"),
                     F.col("utt_idx").alias("_y"), F.col("tf").alias("_ty"))
    met = x.join(y, ["filename", "term", "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y")))
    first = F.col("_x") < F.col("_y")
    shared = met.select("filename", F.least("_x", "_y").alias("utt_a"), F.greatest("_x", "_y").alias("utt_b"),
                        F.when(first, F.col("_tx")).otherwise(F.col("_ty")).alias("tf_a"),
                        F.when(first, F.col("_ty")).otherwise(F.col("_tx")).alias("tf_b"))
    p = shared.groupBy("filename", "utt_a", "utt_b").agg(
        F.sum(F.col("tf_a") * F.col("tf_b")).alias("dot"),
        F.sum(F.col("tf_a") * F.col("tf_a")).alias("sa"),
        F.sum(F.col("tf_b") * F.col("tf_b")).alias("sb"))
    qa = q.select("filename", F.col("utt_idx").alias("utt_a"), F.col("q").alias("qa"))
    qb = q.select("filename", F.col("utt_idx").alias("utt_b"), F.col("q").alias("qb"))
    p = p.join(qa, ["filename", "utt_a"]).join(qb, ["filename", "utt_b"])
    c2 = C_ONE_SIDED * C_ONE_SIDED
    na = F.sqrt(c2 * F.col("qa") - (c2 - 1) * F.col("sa"))
    nb = F.sqrt(c2 * F.col("qb") - (c2 - 1) * F.col("sb"))
    return p.select("filename", "utt_a", "utt_b", (F.col("dot") / (na * nb)).alias("cosine"))


def _matched(x: tuple, y: tuple | None, thresholds) -> tuple:
    """(pairs sharing a term, sum, minimum, counts at or below each
    threshold) over the pairs of two blocks' utterances, or of one block's
    own. A block is (utterances, term codes, counts) of its rows; a term that
    stands in several rows of an utterance counts their sum. Terms are taken
    in runs, so the dense matrices stay bounded."""
    blocks = []
    for utt, term, tf in (x,) if y is None else (x, y):
        key = utt.astype(np.int64) << 32 | term
        if (key[1:] <= key[:-1]).any():  # else each term once, in order
            key, at = np.unique(key, return_inverse=True)
            tf = np.bincount(at, tf, len(key))
        rows, r = np.unique(key >> 32, return_inverse=True)
        blocks.append((len(rows), r, key & 0xFFFFFFFF, tf, np.bincount(r, tf * tf, len(rows))))
    a, b = blocks[0], blocks[-1]
    if y is None:  # terms of one utterance only add to the norms, not to what a pair shares
        held, n = np.unique(a[2], return_counts=True)
        common = held[n > 1]
    else:
        common = np.intersect1d(a[2], b[2])
    if not len(common):
        return 0, 0.0, None, [0] * len(thresholds)
    dot, sa, sb = (np.zeros((a[0], b[0])) for _ in range(3))
    step = max(1, CELLS // max(a[0], b[0], 1))
    for lo in range(0, len(common), step):
        run = common[lo:lo + step]
        dense = []
        for size, r, t, f, _ in blocks:
            at = np.minimum(np.searchsorted(run, t), len(run) - 1)
            hit = run[at] == t
            m = np.zeros((size, len(run)))
            m[r[hit], at[hit]] = f[hit]
            dense.append(m)
        u, v = dense[0], dense[-1]
        both = u @ v.T
        dot += both
        if u.max() <= 1 and v.max() <= 1:
            sa += both
            sb += both
        elif y is None:
            one = (u * u) @ (u > 0).astype(float).T
            sa += one
            sb += one.T
        else:
            sa += (u * u) @ (v > 0).astype(float).T
            sb += (u > 0).astype(float) @ (v * v).T
    c2 = C_ONE_SIDED * C_ONE_SIDED
    i, j = np.nonzero(np.triu(dot > 0, 1) if y is None else dot > 0)
    s = dot[i, j] / (np.sqrt(c2 * a[4][i] - (c2 - 1) * sa[i, j]) * np.sqrt(c2 * b[4][j] - (c2 - 1) * sb[i, j]))
    return len(s), float(s.sum()), float(s.min()) if len(s) else None, [int((s <= t).sum()) for t in thresholds]


def _with_terms(t):
    """The rows (of a batch or table) that hold a term."""
    term = t.column("term")
    return t.filter(pc.greater(pc.list_value_length(term), 0)) if pa.types.is_list(term.type) else t


def _terms(t: pa.Table) -> tuple:
    """(utterances, term codes, counts, the place of each row's first term):
    of rows with a term and its ``tf``, or with an array of terms."""
    utt, term = t.column("utt_idx").to_numpy().astype(np.int64), t.column("term").combine_chunks()
    if pa.types.is_list(term.type):
        n = pc.list_value_length(term).to_numpy()
        utt, start, term, tf = np.repeat(utt, n), np.append(0, np.cumsum(n)), term.flatten(), np.ones(n.sum())
    else:
        start, tf = np.arange(len(utt) + 1), t.column("tf").to_numpy().astype(float)
    return utt, term.dictionary_encode().indices.to_numpy().astype(np.int64), tf, start


def _run_sums(block, utts, row, term, tf, thresholds):
    """(pairs sharing a term, sum, minimum, counts) as ``_matched``, as arrays
    over the blocks 0, 1, ...; the minimum is nan without a pair. A row is of
    an utterance (``utts``) of a ``block``, which ascend; (row, term, tf) are
    the terms of the rows, which may repeat."""
    order = np.lexsort((utts, block))
    b, x = block[order], utts[order]
    utt = np.empty(len(order), np.int64)  # utterances, numbered; rows may share one
    utt[order] = np.cumsum(np.append(False, (b[1:] != b[:-1]) | (x[1:] != x[:-1])))
    of = np.zeros(utt.max() + 1, np.int64)
    of[utt] = block
    m, t = int(block[-1]) + 1, int(term.max()) + 1
    first = np.searchsorted(of, np.arange(m + 1))
    size = np.diff(first)
    wide = int(size.max())
    # The postings, a term of a block after the other.
    key = (block[row] * t + term) * wide + (utt[row] - first[block[row]])
    if tf.max() == 1:
        key, tf = np.unique(key, return_counts=True)
    else:
        key, at = np.unique(key, return_inverse=True)
        tf = np.bincount(at, tf, len(key))
    group, loc = np.divmod(key, wide)
    blk, trm = np.divmod(group, t)
    u = first[blk] + loc
    q = np.bincount(u, tf * tf, len(of))
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    n = np.diff(np.append(start, len(group)))
    found = np.bincount(blk[start], n * (n - 1) // 2, m).astype(np.int64)  # pairs of postings
    shared = np.bincount(blk[start], n > 1, m)
    # ns: a pair of postings 60, a block in products 200,000 and 0.3 a cell and term.
    dense = (found > PAIRS) | (60 * found > 200_000 + 0.3 * size * size * shared)
    out_m, out_s, out_mn = np.zeros(m, np.int64), np.zeros(m), np.full(m, np.nan)
    out_le = [np.zeros(m, np.int64) for _ in thresholds]
    edge = np.searchsorted(blk, np.arange(m + 1))
    for k in np.flatnonzero(dense).tolist():
        lo, hi = edge[k], edge[k + 1]
        out_m[k], out_s[k], mn, le = _matched((loc[lo:hi], trm[lo:hi], tf[lo:hi]), None, thresholds)
        out_mn[k] = np.nan if mn is None else mn
        for o, v in zip(out_le, le):
            o[k] = v
    c2 = C_ONE_SIDED * C_ONE_SIDED
    # A posting's later ones of its group; the others are in no pair.
    rest = np.repeat(start + n, n) - np.arange(len(group)) - 1
    cells = np.where(dense, 0, size * size)
    load = np.maximum(np.cumsum(cells) // CELLS, np.cumsum(np.where(dense, 0, found)) // PAIRS)
    for lo, hi in zip(cut := np.flatnonzero(np.append(True, load[1:] != load[:-1])), [*cut[1:], m]):
        p = np.arange(edge[lo], edge[hi])
        p = p[(rest[p] > 0) & ~dense[blk[p]]]
        if not len(p):
            continue
        k = rest[p]
        a = np.repeat(p, k)
        z = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        # A cell a pair of utterances of a block.
        own = of[first[lo]:first[hi]]
        base = np.append(0, np.cumsum(np.where(dense[own], 0, size[own])))
        cell = base[u[a] - first[lo]] + loc[z]
        dot = np.bincount(cell, tf[a] * tf[z], base[-1])
        at = np.flatnonzero(dot)
        if tf[p].max() == 1 and tf[z].max() == 1:
            dot = sa = sb = dot[at]
        else:
            dot, sa, sb = dot[at], np.bincount(cell, tf[a] * tf[a], base[-1])[at], np.bincount(cell, tf[z] * tf[z], base[-1])[at]
        x = np.searchsorted(base, at, "right") - 1
        home = own[x]
        y = first[home] + at - base[x]
        s = dot / (np.sqrt(c2 * q[x + first[lo]] - (c2 - 1) * sa) * np.sqrt(c2 * q[y] - (c2 - 1) * sb))
        new = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        out_m += np.bincount(home, minlength=m)
        out_s += np.bincount(home, s, m)
        out_mn[home[new]] = np.minimum.reduceat(s, new)
        for o, v in zip(out_le, thresholds):
            o += np.bincount(home[s <= v], minlength=m)
    return out_m, out_s, out_mn, out_le


def _own_sums(batches, thresholds):
    """A row for every block of batches that hold a block's rows one after the
    other."""
    def table(parts):
        t = pa.Table.from_batches(parts)
        key = [t.column(c).combine_chunks() for c in ("filename", "block")]
        new = pc.or_(*[pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)) for k in key])
        return t, [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), len(t)]

    def sums(t, at):
        _, code, tf, start = _terms(t)
        names, blocks = (t.column(c).take(pa.array(at[:-1], pa.int64())).combine_chunks() for c in ("filename", "block"))
        block, row = np.repeat(np.arange(len(blocks)), np.diff(at)), np.repeat(np.arange(len(t)), np.diff(start))
        m, s, mn, le = _run_sums(block, t.column("utt_idx").to_numpy().astype(np.int64), row, code, tf, thresholds)
        return pa.RecordBatch.from_arrays([names, blocks, pa.array(m), pa.array(s), pa.array(mn, mask=m == 0), *map(pa.array, le)],
                                          names=["filename", "block", "m", "s", "mn", *[f"le{k}" for k in range(len(le))]])

    held: list = []
    for b in map(_with_terms, batches):
        if not b.num_rows:
            continue
        if held and all(held[-1].column(c)[-1] == b.column(c)[i] for c in (0, 1) for i in (0, b.num_rows - 1)):
            held.append(b)  # no block ends here
            continue
        t, at = table([*held, b])
        if len(at) > 2:
            yield sums(t.slice(0, at[-2]), at[:-1])
        held = t.slice(at[-2]).combine_chunks().to_batches()
    if held:
        yield sums(*table(held))


def _pair_sums(pairs: DataFrame, thresholds) -> DataFrame:
    return pairs.groupBy("filename").agg(
        F.count("*").alias("m"), F.sum("cosine").alias("s"), F.min("cosine").alias("mn"),
        *[F.count_if(F.col("cosine") <= t).alias(f"le{i}") for i, t in enumerate(thresholds)])


def matched_sums(terms: DataFrame, thresholds=(0.0, 0.3, 0.5), block: int = BLOCK,
                 again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(filename, m, s, mn, le0, le1, ...): over the pairs of a transcript's
    utterances that share a term, their number, sum, minimum and counts.
    ``terms`` are those of ``utterance_terms``, at best with this ``block``;
    a term of an utterance may come more than once. ``again`` gives the
    ``terms`` of the transcripts of a table (``filename``): those of several
    blocks are needed a second time, and the others' texts need no second
    shuffle for it."""
    names = [f"le{k}" for k in range(len(thresholds))]
    def blocks_of(t):
        t = t if "block" in t.columns else _dealt(t, block)
        return t.select("filename", "block", "utt_idx", "term", *(["tf"] if "tf" in t.columns else []))

    dealt = blocks_of(terms)
    kind = terms.schema["filename"].dataType.simpleString()
    found = "m long, s double, mn double, " + ", ".join(f"{n} long" for n in names)
    # A row a block, read below to list the blocks.
    own = cut_lineage(dealt.mapInArrow(lambda b: _own_sums(b, thresholds), f"filename {kind}, block long, {found}"))
    sums = own.drop("block")
    large = cut_lineage(own.groupBy("filename").agg(F.count("*").alias("_n")).filter("_n > 1").select("filename"))
    several = large.count()
    if several:
        large = F.broadcast(large) if several <= BROADCAST_ROWS else large
        blocks = own.join(large, "filename", "left_semi").select("filename", F.col("block").alias("_b"))
        # A block goes to the group of every block pair that it is part of.
        mates = blocks.join(blocks.withColumnRenamed("_b", "_o"), "filename").filter("_b <> _o").select(
            "filename", F.col("_b").alias("block"), F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
        second = blocks_of(again(large)) if again else dealt.join(large, "filename", "left_semi")
        sent = second.join(mates, ["filename", "block"])

        def run(t: pa.Table) -> pa.Table:
            t = _with_terms(t)  # both blocks hold some: only such blocks are listed
            utt, code, tf, start = _terms(t)
            first = np.repeat(pc.equal(t.column("block"), t.column("_i")).to_numpy(), np.diff(start))
            m, s, mn, le = _matched(*[(utt[k] - utt[k].min(), code[k], tf[k]) for k in (first, ~first)], thresholds)
            return pa.table({"filename": t.column("filename").slice(0, 1), "m": pa.array([m], pa.int64()), "s": [s], "mn": pa.array([mn], pa.float64()),
                             **{n: pa.array([k], pa.int64()) for n, k in zip(names, le)}})
        sums = sums.unionByName(sent.groupBy("filename", "_i", "_j").applyInArrow(run, f"filename {kind}, {found}"))
    return sums.groupBy("filename").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.min("mn").alias("mn"), *[F.sum(n).alias(n) for n in names])


def distance_features(utts: DataFrame, found: DataFrame, thresholds=(0.0, 0.3, 0.5),
                      include_zero: bool = False, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mean, minimum and share of pair similarities <= t over all
    n(n-1)/2 utterance pairs of each transcript (Quirk 20 fixed: every
    utterance, not only the first list; the reference's leading 0 is kept
    only with ``include_zero``). ``found`` holds the utterances' terms, or
    the pairs of ``pair_cosine`` where these are there anyway; ``again`` as in
    ``matched_sums``."""
    n = utts.groupBy("filename").agg(F.count("*").alias("n"))
    s = matched_sums(found, thresholds, again=again) if "term" in found.columns else _pair_sums(found, thresholds)
    j = n.join(s, "filename", "left").fillna(0, ["m"]).fillna(0.0, ["s"])
    P = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    total = P + 1 if include_zero else P
    zeros = total - F.col("m")  # pairs sharing no term (+ the leading 0)
    mn = F.when(zeros > 0, F.lit(0.0)).otherwise(F.col("mn"))
    cols = [tx.round6(tx.safe_div("s", total)).alias("avg_cos_dist"),
            tx.round6(F.when(total > 0, mn)).alias("min_cos_dist")]
    for i, t in enumerate(thresholds):
        name = f"proportion_below_threshold_{t:g}".replace(".", "_")
        cols.append(tx.round6(tx.safe_div(F.coalesce(F.col(f"le{i}"), F.lit(0)) + zeros, total)).alias(name))
    return j.select("filename", P.alias("n_pairs"), *cols)


def utterance_distances(spark: SparkSession, utts: DataFrame, thresholds=(0.0, 0.3, 0.5)) -> DataFrame:
    """``distance_features`` of the utterances' own terms by block. The texts
    of transcripts of several blocks are taken from ``utts`` a second time,
    before any shuffle."""
    def terms(u):
        return utterance_terms(spark, u, block=BLOCK)

    return distance_features(utts, terms(utts), thresholds, again=lambda large: terms(utts.join(large, "filename", "left_semi")))
