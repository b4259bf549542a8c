"""Line deduplication, hard negatives and ranked search against brute force,
with nulls, empty and long texts, ties, repeated rows, empty tables, clashing
column names, and both sides of every size switch."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import hard_negatives, line_dedup, ranked_search

CLASH = ("row", "id", "t1", "t2", "pos", "line", "key", "h1", "h2", "last", "drop", "n_lines", "lines", "rank", "score", "item",
         "label_", "vec", "anchor", "slot", "term", "n", "s", "x")
LINE = "This line of more than forty characters stands in many documents"
LONG = "\n".join(f"long line number {i % 3000} of a very long text, {i % 7}" for i in range(20000))


def with_clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# --- line deduplication -------------------------------------------------------

def texts():
    hot = [f" {LINE}\t", LINE.upper(), f"{LINE}\x0b", f"\r{LINE}", LINE]
    rows = [(i, f"own {i}\n{hot[i % 5]}\nmiddle\n{LINE}\nend") for i in range(1, 8)]
    four = "A line that only four documents hold, so that it stays"
    rows += [(20 + i, f"{four}\n{LINE[:39]}\n") for i in range(4)]
    rows += [(30 + i, LINE[:39]) for i in range(6)]  # too short
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, LONG), (44, LONG), (45, LONG), (46, LONG), (47, LONG)]
    rows += [(48, "Ärger " + "É" * 34), (49, "Ärger " + "é" * 34), (50, "Ärger " + "É" * 34), (51, "Ärger " + "É" * 34),
             (52, "Ärger " + "É" * 34), (53, "ÄRGER " + "É" * 34), (54, "Ärger " + "É" * 34)]
    rows += [(None, f"{LINE}\nno id"), (None, f"no id\n{LINE}"), (7, f"{LINE}\nagain"), (3, rows[2][1])]
    return rows


def brute_lines(rows, min_docs=5, min_chars=40):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), line)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = defaultdict(set)
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    last = {k: max(d, key=lambda i: (i is not None, i)) for k, d in held.items() if len(d) >= min_docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_line_dedup_matches_brute_force(spark, limit):
    rows = texts()
    docs = with_clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = line_dedup.dedup_lines(docs, broadcast_rows=limit, broadcast_positions=limit)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped"]
    got = [(r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"], r["lines"]) for r in got.collect()]
    assert Counter(r[:4] for r in got) == Counter(brute_lines(rows))
    assert {r[4] for r in got} == {"x"}
    assert sum(r[3] for r in got) > 4 * 20000


def test_line_dedup_thresholds_and_empty_table(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, min_docs=2, min_chars=5)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == Counter(brute_lines(rows, 2, 5))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_runs_no_python(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- hard negatives -----------------------------------------------------------

def brute_negatives(rows, n_pos=5, n_neg=5):
    use = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
           if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, va in use:
        if a is None or a % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(va, v)), i, other) for i, other, v in use if i != a),
                        key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p_score, p, _ in [s for s in scored if s[2] == lab][:n_pos]:
            neg = [s for s in scored if s[2] != lab and 80 * p_score <= 100 * s[0] <= 100 * p_score][:n_neg]
            out += [(a, p, k, i, p_score, s) for k, (s, i, _) in enumerate(neg, 1)]
    return out


def vectors(seed=0, n=400, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 12, dim) / 8]) for i in range(n)]
    rows += [(1000 + i, i % 2, [1.0] * dim) for i in range(60)]  # equal vectors: ties
    rows += [(2000, 0, None), (2001, None, [1.0] * dim), (2002, 0, [float("nan")] * dim), (2100, 1, [float("inf")] + [0.0] * (dim - 1)),
             (2200, 1, [None] * dim), (2300, 2, [0.0] * dim), (2400, 7, [1.0] * dim), (2500, 1, [1.0]), (None, 1, [1.0] * dim),
             (2600, 1, []), (100, 1, [0.5] * dim), (2700, 0, [-1.0] * dim)]
    return rows


def mine(spark, rows, **options):
    df = with_clash(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), **options).collect()
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


@pytest.mark.parametrize("block_bytes", [10 ** 8, 200])
def test_hard_negatives_match_brute_force(spark, block_bytes):
    rows = vectors()
    want = brute_negatives(rows)
    assert len(want) > 50
    assert mine(spark, rows, block_bytes=block_bytes) == Counter(want)


def test_hard_negatives_other_sizes_and_empty(spark):
    rows = vectors(1, n=300)
    assert mine(spark, rows, n_pos=3, n_neg=7) == Counter(brute_negatives(rows, 3, 7))
    assert mine(spark, [r for r in rows if r[0] == 2400]) == Counter()
    assert not mine(spark, rows[:0])


def test_products_beyond_doubles():
    a = np.array([[2.0 ** 40, 1.0]])
    assert hard_negatives.products(a, np.array([[2.0 ** 20, 1.0]])).tolist() == [[2 ** 60 + 1]]
    assert hard_negatives.products(a, np.array([[2.0 ** 40, 1.0]])).tolist() == [[2 ** 63 - 1]]


# --- ranked search ------------------------------------------------------------

ITEMS = [(1, "the quick brown fox"), (2, "The THE quick; fox-trot 42"), (3, ""), (4, None), (5, "漢字 Ünï"), (6, "absent words"),
         (7, "common"), (1, "the quick brown fox"), (8, "common w1 w2 w3 w4 w5"), (9, "a_b c")]


def search_docs():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)) if x < 50) + " common") for i in range(300)]
    rows += [(400 + i, "the quick brown fox, the end. common") for i in range(25)]  # copies: ties
    rows += [(500, None), (501, ""), (502, "..."), (503, "漢字 Ünï ünï"), (504, "the " * 30000 + "FOX"), (505, "a_b-c\x00d"),
             (None, "the quick brown fox"), (None, "quick"), (300, "w1 w2 W3"), (300, "w1 w2 W3")]
    rows += [(600 + i, f"quick {i} " * 40) for i in range(30)]
    return rows


def brute_search(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    big_n, big_l = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("block_terms", [10 ** 5, 6])
def test_ranked_search_matches_brute_force(spark, block_terms):
    docs = with_clash(spark.createDataFrame(search_docs(), "doc_id long, text string"))
    items = with_clash(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = ranked_search.search(docs.repartition(5), items, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_search(search_docs(), ITEMS))


def test_ranked_search_empty_tables(spark):
    docs = spark.createDataFrame(search_docs(), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.filter("text = ''"), items).count() == 0


def test_sketch_bounds_are_upper_bounds_and_tight():
    texts = [(t or "").encode() for _, t in search_docs()]
    items = ranked_search.Items([(t or "").encode() for _, t in ITEMS])
    b = ranked_search.Batch(texts)
    weights = np.arange(1, len(items.terms) + 1) * 100
    impacts = b.impacts(len(texts), int(b.n.sum()))
    bound = ranked_search.bounds(b, items, weights, impacts)
    at = {(int(k) // b.v, b.vocab[int(k) % b.v].as_py()): int(x) for k, x in zip(b.keys, impacts)}
    exact = np.array([[sum(int(weights[t]) * at.get((d, items.terms[t]), 0) for t in items.flat[items.start[i]:items.start[i + 1]])
                       for i in range(len(items.size))] for d in range(len(texts))])
    assert (bound >= exact).all()
    assert (bound[exact > 0] <= 2 * exact[exact > 0]).mean() > 0.6
