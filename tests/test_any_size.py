"""Operators in the form that holds for any size of one transcript, group or
weight (H01-H05, D06, K18, K20, L01, L02), against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions.frames import carry_last, running
from parlance.operators import adapt, assemble, distance, evaluate, mtld
from parlance.operators import similarity as sim

from .test_features import mtld_ref


# --- carried values -----------------------------------------------------------

@pytest.mark.parametrize("group", [None, "g"])
def test_carry_last_crosses_partitions(spark, group):
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], i, int(rng.integers(0, 100)) if rng.random() < 0.02 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {r["i"]: r["last"] for r in carry_last(df, ["i"], "v", "last", group, partitions=7).collect()}
    held, want = {}, {}
    for g, i, v in rows:
        k = g if group else 0
        held[k] = v if v is not None else held.get(k)
        want[i] = held[k]
    assert got == want


# --- K18, K20 -----------------------------------------------------------------

def brute_bootstrap(rows, n, seed):
    """rows: (key, weight) in key order."""
    rows = [(k, w) for k, w in rows if w and w > 0]
    edges = np.concatenate([[0], np.cumsum([w for _, w in rows])])
    u = [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / 2 ** 52 * edges[-1] for i in range(n)]
    return [rows[min(int(np.searchsorted(edges, x, "right")) - 1, len(rows) - 1)][0] for x in u]


def test_bootstrap_is_exact_and_repeatable(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(w), f"x{i}") for i, w in enumerate(rng.random(400))]
    rows[17] = (17, 200.0, "hot")  # half of all the weight
    rows[3], rows[4] = (3, 0.0, "never"), (4, None, "never")
    df = spark.createDataFrame(rows, "k int, w double, extra string")
    got = [{r["draw"]: r["k"] for r in adapt.bootstrap(df.repartition(p), "w", "k", seed=5).collect()} for p in (1, 6)]
    assert got[0] == got[1] == dict(enumerate(brute_bootstrap([(k, w) for k, w, _ in rows], 400, 5)))
    more = adapt.bootstrap(df, "w", "k", n=3000, seed=1)
    assert more.count() == 3000 and more.columns == ["k", "w", "extra", "draw"]
    share = more.filter("k = 17").count() / 3000
    assert abs(share - 200 / sum(w or 0 for _, w, _ in rows)) < 0.04
    assert more.filter("extra = 'never'").count() == 0
    assert adapt.bootstrap(df.limit(0), "w", "k").count() == 0
    assert adapt.bootstrap(df.withColumn("w", F.lit(0.0)), "w", "k").count() == 0


def test_bootstrap_branch_fits_on_the_sample(spark):
    rows = [(i, i % 2, float(i % 5), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "filename int, domain int, w0 double, label double").withColumn("features", F.array("label"))
    seen = {}

    class Learner:
        def fit(self, d):
            seen["rows"] = Counter(r["filename"] for r in d.collect())
            return self
    est = adapt.AdaptedEstimator(lambda n, w: seen.update(n=n, w=w) or Learner(), weighter=lambda d: d.withColumn("_w", F.col("w0")),
                                 bootstrap_key="filename", seed=3)
    est.fit(df)
    want = Counter(brute_bootstrap([(r[0], r[2]) for r in rows if r[1] == 0], 30, 3))
    assert seen["n"] == 30 and seen["w"] is None and seen["rows"] == want


# --- L01, L02 -----------------------------------------------------------------

def greedy(sizes, k):
    loads, out = [0] * k, []
    for s in sizes:
        f = loads.index(min(loads))
        loads[f] += s
        out.append(f)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_ranges_equal_one_by_one(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted((int(x) for x in np.concatenate([rng.integers(1, 2000, 3), rng.zipf(1.5, 400) % 50 + 1, np.ones(300, int)])), reverse=True)
    k = int(rng.integers(1, 9))
    runs = sorted(Counter(sizes).items(), reverse=True)
    got = [f for _, n, folds in evaluate.greedy_ranges(runs, k) for i in range(n) for f in [folds[i % len(folds)]]]
    assert got == greedy(sizes, k)
    assert len(list(evaluate.greedy_ranges(runs, k))) <= (k + 1) * len(runs)


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_greedy_folds_by_rank(spark, monkeypatch, limit):
    monkeypatch.setattr(evaluate, "BROADCAST_RANGES", limit)
    rng = np.random.default_rng(4)
    groups = [(f"g{i}", int(rng.zipf(1.6) % 30) + 1) for i in range(200)] + [("hot", 900)]
    df = spark.createDataFrame([(g, j, j % 2) for g, n in groups for j in range(n)], "group_id string, j int, label int")
    got = {r["group_id"]: r["fold"] for r in evaluate.group_kfold(df, 5).select("group_id", "fold").distinct().collect()}
    order = sorted(groups, key=lambda x: (-x[1], x[0]))
    assert got == dict(zip([g for g, _ in order], greedy([n for _, n in order], 5)))
    # Inside the majority label the folds start empty again.
    two = evaluate.stratified_group_kfold(df.withColumn("label", (F.length("group_id") > 2).cast("int")), 3)
    got = {r["group_id"]: r["fold"] for r in two.select("group_id", "fold").distinct().collect()}
    for side in (True, False):
        mine = [(g, n) for g, n in order if (len(g) > 2) == side]
        assert {g: got[g] for g, _ in mine} == dict(zip([g for g, _ in mine], greedy([n for _, n in mine], 3)))


# --- D06 ----------------------------------------------------------------------

def texts(rng):
    out = {k: [f"w{int(x)}" for x in rng.integers(0, v, n)] for k, (v, n) in enumerate([(3, 100), (12, 331), (40, 200), (400, 300), (5, 8), (5, 9), (2, 1), (9, 16)])}
    out[20] = [f"u{i}" for i in range(150)]  # no term twice: no factor ends
    out[21] = [f"u{i}" for i in range(60)] + ["u59"] * 60 + [f"v{i}" for i in range(50)]  # a factor longer than two blocks
    out[22] = ["a"] * 77
    out[23] = [f"u{i % 50}" for i in range(64)]
    return out


@pytest.mark.parametrize("block", [8, 32, 5000])
def test_mtld_by_blocks(spark, block):
    data = texts(np.random.default_rng(block))
    rows = [(k, i, t) for k, words in data.items() for i, t in enumerate(words)]
    rich = spark.createDataFrame(rows, "filename int, pos long, term string")
    got = {r["filename"]: r["mtld"] for r in mtld.mtld(rich, block=block).collect()}
    assert sorted(got) == sorted(data)
    for k, words in data.items():
        assert got[k] == pytest.approx(mtld_ref(words), abs=1e-6), k


def test_mtld_of_a_hot_transcript_is_dealt_by_blocks(spark):
    """A transcript of a third of all tokens: no block holds more rows than
    two blocks of positions."""
    words = [f"w{i * i % 61}" for i in range(3000)]
    rows = [(0, i, w) for i, w in enumerate(words)] + [(1 + i // 60, i % 60, w) for i, w in enumerate(words * 2)]
    rich = spark.createDataFrame(rows, "filename int, pos long, term string")
    jumps = mtld._jumps(rich.filter("filename = 0").select("filename", F.lit(0).alias("back"), F.lit(3000).cast("long").alias("N"), F.col("pos").alias("p"), "term"), 128, 0.72)
    per = [r["n"] for r in jumps.groupBy(F.floor(F.col("s") / 128)).agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 3000 and max(per) == 128
    got = {r["filename"]: r["mtld"] for r in mtld.mtld(rich, block=128).collect()}
    assert got[0] == pytest.approx(mtld_ref(words), abs=1e-6) and len(got) == 101


# --- H01-H05 ------------------------------------------------------------------

def brute_pairs(utts):
    """Cosine of every pair, TF-IDF fitted on the pair."""
    out = {}
    for (f, a, x) in utts:
        for (g, b, y) in utts:
            if f == g and a < b:
                wa = {t: n * (1.0 if t in y else sim.C_ONE_SIDED) for t, n in x.items()}
                wb = {t: n * (1.0 if t in x else sim.C_ONE_SIDED) for t, n in y.items()}
                na, nb = (math.sqrt(sum(v * v for v in w.values())) for w in (wa, wb))
                out[f, a, b] = sum(v * wb.get(t, 0) for t, v in wa.items()) / (na * nb) if na and nb else 0.0
    return out


@pytest.mark.parametrize("size", [4, 1000])
def test_hot_term_pairs_and_sums(spark, monkeypatch, size):
    monkeypatch.setattr(sim, "CELLS", 3 * size)  # several runs of terms a group
    rng = np.random.default_rng(1)
    utts = []
    for f, n in ((0, 45), (1, 7), (2, 1), (3, 2)):
        for u in range(n):
            words = Counter({"hot": 1 + u % 3}) if u % 9 else Counter()
            words.update(f"w{int(x)}" for x in rng.integers(0, 25, rng.integers(0, 6)))
            utts.append((f, u, words))
    terms = spark.createDataFrame([(f, u, t, n) for f, u, w in utts for t, n in w.items()], "filename int, utt_idx int, term string, tf long")
    base = spark.createDataFrame([(f, u) for f, u, _ in utts], "filename int, utt_idx int")
    want = brute_pairs(utts)
    got = {(r["filename"], r["utt_a"], r["utt_b"]): r["cosine"] for r in sim.pair_cosine(terms, postings=size).collect()}
    assert sorted(got) == sorted(k for k, v in want.items() if v > 0)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    sums = {r["filename"]: r for r in sim.matched_sums(terms, block=size).collect()}
    for f in (0, 1, 3):
        mine = [v for (g, _, _), v in want.items() if g == f and v > 0]
        if f not in sums:  # no pair of a small transcript shares a term
            assert not mine
            continue
        r = sums[f]
        assert r["m"] == len(mine) and r["s"] == pytest.approx(sum(mine))
        assert r["le1"] == sum(v <= 0.3 for v in mine) and (r["mn"] is None) == (not mine)
    by_pairs = {tuple(r) for r in sim.distance_features(base, sim.pair_cosine(terms)).collect()}
    assert {tuple(r) for r in sim.distance_features(base, terms).collect()} == by_pairs


def test_no_join_key_of_a_hot_term_makes_all_pairs(spark):
    """900 postings of one term: 10 keys of block pairs, none above the
    square of a block and its spread."""
    terms = spark.createDataFrame([(0, u, "hot", 1) for u in range(900)], "filename int, utt_idx int, term string, tf long")
    assert sim.pair_cosine(terms, postings=256).count() == 900 * 899 // 2
    assert sim.matched_sums(terms).first()["m"] == 900 * 899 // 2


# --- B01, G11, J11, J17, N06 ----------------------------------------------------

def test_running_sums_and_earlier_values(spark):
    rng = np.random.default_rng(12)
    rows = [("ab"[int(rng.integers(0, 2))], i, int(rng.integers(1, 9)), int(rng.integers(0, 9)) if rng.random() < 0.05 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, x int, v int")
    got = {r["i"]: (r["t"], r["e"]) for r in running(df, ["i"], "g", sums={"t": "x"}, earlier={"e": "v"}, partitions=9).collect()}
    total, held, want = Counter(), {}, {}
    for g, i, x, v in rows:
        total[g] += x
        want[i] = (total[g], held.get(g))
        held[g] = v if v is not None else held.get(g)
    assert got == want


def test_side_switches_and_tiers_have_no_window_over_a_transcript(spark):
    from parlance.operators import prep, psych
    words = spark.createDataFrame([(0, i, "x") for i in range(50)], "filename int, pos long, word string")
    files = spark.createDataFrame([("f", "@Begin\n*PAR:\thello\n\tyou\n%mor:\tco\n*INV:\tand\n@End\n*PAR:\tlate"),
                                   ("g", "*PAR:\tno end\n%com:\tnote\n\tmore\n%gra:\t1|0"), ("h", "@End")], "filename string, text string")
    tiers = prep.chat_tiers(prep.chat_lines(files))
    got = {(r["filename"], r["utt_idx"]): (r["speaker"], r["text"], r["mor"], r["gra"]) for r in tiers.collect()}
    assert got == {("f", 1): ("PAR", "hello you", "co", ""), ("f", 2): ("INV", "and", "", ""), ("g", 1): ("PAR", "no end", "", "1|0")}
    for df in (tiers, psych.side_switches(spark, words)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all("_pid" in line for line in plan.splitlines() if "Window [" in line or "Window " in line and "windowspec" in line), plan


def test_permutation_is_a_bijection_and_does_not_depend_on_partitions(spark):
    for n in (1, 2, 3, 7, 50, 401):
        df = spark.createDataFrame([(i * 3, f"x{i}") for i in range(n)], "filename int, extra string")
        got = [{r["filename"]: r["position"] for r in assemble.seeded_permutation(df.repartition(p), "filename", 5).collect()} for p in (1, 5)]
        assert got[0] == got[1] and sorted(got[0].values()) == list(range(n))
    other = {r["filename"]: r["position"] for r in assemble.seeded_permutation(df, "filename", 6).collect()}
    same = sum(other[k] == got[0][k] for k in other)
    assert same < 20
    assert abs(np.corrcoef(sorted(got[0]), [got[0][k] for k in sorted(got[0])])[0, 1]) < 0.2
    both = assemble.concat_and_shuffle([df, df.limit(3)]).collect()
    assert sorted(r["position"] for r in both) == list(range(404)) and Counter(r["part"] for r in both) == {0: 401, 1: 3}
    assert assemble.seeded_permutation(df.limit(0), "filename").count() == 0


def test_density_ratio_ascent_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)) + (np.arange(60) >= 30)[:, None] * 0.8
    df = spark.createDataFrame([(i, int(i >= 30), [float(v) for v in x[i]]) for i in range(60)], "vec_id int, domain int, features array<double>")
    got = distance.neg_j_score(df.repartition(3), max_centers=100, max_iter=40, tol=1e-9, gamma=0.3)
    k = np.exp(-0.3 * ((x[:, None] - x[None, 30:]) ** 2).sum(-1))
    b, a, eps = k[:30].mean(0), k[30:], np.finfo(float).eps
    alpha, prev = np.ones(30) / 30, -np.inf
    score = np.mean(np.log(a @ alpha + eps))
    for _ in range(40):
        if not score - prev > 1e-9:
            break
        prev = score
        alpha = alpha + 1e-4 * (a / (a @ alpha + eps)[:, None]).sum(0)
        alpha = np.maximum(0, alpha + b * ((1 - b @ alpha) / (b @ b + eps)))
        alpha = alpha / (b @ alpha + eps)
        score = np.mean(np.log(a @ alpha + eps))
    assert got == pytest.approx(-score, abs=1e-9)


# --- H02-H05 without pair rows, types tagged once, bounded sums --------------------

@pytest.mark.parametrize("size", [4, 1000])
def test_sums_of_texts_need_no_pair_rows(spark, monkeypatch, size):
    """Texts dealt by block give the features of the pairs, and the pairs are
    made as rows for no transcript, however short."""
    rng = np.random.default_rng(2)
    rows = [(f, u, " ".join(rng.choice(["Hot", "hot,", "boys", "the", "singing", "x1", "été"], int(rng.integers(0, 9)))))
            for f, n in ((1, 30), (2, 6), (3, 1), (4, 2)) for u in rng.permutation(n).tolist()]
    rows += [(5, 0, None), (5, 1, "hot hot"), (5, 1 << 40, "hot"), (None, 0, "hot"), (6, 0, "one row"), (6, 0, "row one")]
    utts = spark.createDataFrame(rows, "filename int, utt_idx long, text string")
    want = {tuple(r) for r in sim.distance_features(utts, sim.pair_cosine(sim.utterance_terms(spark, utts))).collect()}
    monkeypatch.setattr(sim, "pair_cosine", None)
    terms = sim.utterance_terms(spark, utts, block=size)
    assert terms.count() <= len(rows)
    monkeypatch.setattr(sim, "BLOCK", size)
    sums = {r["filename"]: r["m"] for r in sim.matched_sums(terms, block=size).collect()}
    assert sums[5] == 1 and sums[6] == 0 and None not in sums
    assert {tuple(r) for r in sim.distance_features(utts, terms).collect()} == want


def test_own_sums_of_blocks_over_many_batches(spark):
    import pyarrow as pa
    t = pa.table({"filename": ["a"] * 6 + ["b"] * 2, "block": [0] * 4 + [1] * 2 + [0] * 2, "utt_idx": [0, 1, 2, 3, 4, 5, 0, 1],
                  "term": [["x"], ["x", "x"], ["y"], ["x"], ["z"], ["z"], ["q"], ["r"]]})
    for size in (1, 2, 3, 8):
        got = [r for b in sim._own_sums(t.to_batches(max_chunksize=size), (0.3,)) for r in b.to_pylist()]
        assert [(r["filename"], r["block"], r["m"]) for r in got] == [("a", 0, 3), ("a", 1, 1), ("b", 0, 0)]


@pytest.mark.parametrize("bound", [0, 1000])
def test_types_are_tagged_once(spark, monkeypatch, bound):
    from parlance.operators import lexical as lex, prep
    toks = spark.createDataFrame([(f, 0, i, w) for f in (1, 2) for i, w in enumerate("The boys were singing , and the Boys sang 12 the".split()[:11 - f])],
                                 "filename int, utt_idx int, tok_idx int, token string")
    types = lex.token_types(toks)
    want = {tuple(r) for r in lex.token_profile(prep.tag_tokens(spark, toks)).collect()}
    rich = {tuple(r) for r in lex.richness_scalar(lex.rich_terms(toks)).collect()}
    whole, seen = prep.tag_tokens, []
    monkeypatch.setattr(prep, "tag_tokens", lambda s, t: seen.append(t.count()) or whole(s, t))
    assert {tuple(r) for r in lex.token_profile(prep.tag_types(spark, types, bound)).collect()} == want
    rows, vocabulary = types.count(), toks.select("token").distinct().count()
    assert seen == ([0, rows] if bound == 0 else [vocabulary, 0])
    assert {tuple(r) for r in lex.richness_scalar(lex.rich_terms(types)).collect()} == rich


# --- the feature table: one shuffle of the texts, one of long transcripts --------

def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_types_of_dealt_texts_need_no_exchange(spark):
    """Tokens, types, tags and sums by document follow the shuffle of the
    texts; every type is tagged in one pass."""
    from parlance.operators import lexical as lex, prep
    docs = spark.createDataFrame([(1, "The boys sang.\nthe Boys sing"), (1, "twice, the"), (2, "one"), (3, None), (4, " \n")], "doc_id long, text string")
    types = lex.token_types(prep.token_table(prep.utterances_from_documents(docs.repartition("doc_id"))))
    tagged = prep.tag_types(spark, types)
    profile, rich = lex.token_profile(tagged), lex.richness_scalar(lex.rich_terms(types))
    assert _exchanges(profile) == 1 and _exchanges(rich) == 1
    toks = prep.token_table(prep.utterances_from_documents(docs))
    assert {tuple(r) for r in profile.collect()} == {tuple(r) for r in lex.token_profile(prep.tag_tokens(spark, toks)).collect()}
    assert {tuple(r) for r in rich.collect()} == {tuple(r) for r in lex.richness_scalar(lex.rich_terms(toks)).collect()}


def test_texts_of_one_block_are_not_dealt_twice(spark, monkeypatch):
    rows = [(1, u, f"hot w{u % 3}") for u in range(20)] + [(2, u, "hot x") for u in range(3)] + [(2, 3, None)]
    utts = spark.createDataFrame(rows, "filename long, utt_idx long, text string")
    want = {tuple(r) for r in sim.distance_features(utts, sim.utterance_terms(spark, utts)).collect()}
    monkeypatch.setattr(sim, "BLOCK", 4)
    dealt, whole = [], sim._dealt
    monkeypatch.setattr(sim, "_dealt", lambda r, b: dealt.append({x["filename"] for x in r.collect()}) or whole(r, b))
    assert {tuple(r) for r in sim.utterance_distances(spark, utts).collect()} == want
    assert dealt == [{1, 2}, {1}]


def test_a_pass_has_no_more_tasks_than_cores(spark, monkeypatch):
    from parlance.operators import linear as lin
    monkeypatch.setattr(lin, "ROWS_PER_TASK", 1)
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(400, numPartitions=4 * cores).selectExpr("array(double(id)) AS features", "double(id % 2) AS label")
    with lin.Rows(df) as rows:
        assert rows.parts == cores
        assert rows.sums(lambda r: r["features"].sum(0), 1)[0] == 399 * 200
    monkeypatch.setattr(lin, "MOST_PER_TASK", 1)
    with lin.Rows(df) as rows:
        assert rows.parts == 4 * cores


def test_terms_are_made_behind_the_shuffle_only(spark):
    utts = spark.createDataFrame([(1, 0, "hot cold"), (1, 1, "the"), (1, 2, None), (1, 3, "hot")], "filename long, utt_idx long, text string")
    plan = sim.utterance_terms(spark, utts, block=4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [tuple(r) for r in sim.utterance_distances(spark, utts).select("n_pairs", "min_cos_dist").collect()] == [(6, 0.0)]


def test_cheap_tests_of_a_token_equal_their_expressions(spark):
    from parlance.functions import text as tx
    words = ["a", "-", "\u2014", "\U0001f600", "-\n", "-\r\n", "--", "", None, "\u00e9t\u00e9", "K\u212a", "\u212a", "word", "7", "Sing", "singing", "SINGING", "fully", "famous", "boss", "boys", "red", "\U0001d400b", "...."]
    t = spark.createDataFrame([(w,) for w in words], "t string")
    rules = [tx.fallback_tag("t").alias("a"), tx.fallback_tag("t", "lw").alias("b")]
    assert all(r["a"] == r["b"] for r in t.withColumn("lw", F.lower("t")).select(*rules).collect())
    got = t.select("t", tx.is_punct_token("t").alias("p"), F.expr(r"t rlike '^[^\\p{L}\\p{N}]$'").alias("q"),
                   (tx.fallback_tag("t") == "FW").alias("w"), (F.col("t").rlike(tx.NON_ASCII_RE) & F.col("t").rlike(tx.WORD_RE)).alias("v")).collect()
    assert all(r["p"] == r["q"] and (r["t"] is None or r["w"] == r["v"]) for r in got), got


@pytest.mark.parametrize("cells, pairs", [(4_000_000, 2_000_000), (50, 30), (200, 2_000_000)])
def test_many_small_blocks_are_summed_together(monkeypatch, cells, pairs):
    """The sums of each block's pairs, whatever the runs of blocks, and no
    small block costs a call of its own."""
    rng = np.random.default_rng(3)
    n = np.append(rng.integers(1, 40, 30), [1, 2])
    block, utts = np.repeat(np.arange(len(n)), n), np.concatenate([np.append(rng.permutation(k - 1), 0) for k in n])
    row = np.repeat(np.arange(len(block)), rng.integers(1, 8, len(block)))
    term, tf = rng.integers(0, 25, len(row)), rng.integers(1, 3, len(row)).astype(float)
    whole, calls = sim._matched, []
    monkeypatch.setattr(sim, "CELLS", cells)
    monkeypatch.setattr(sim, "PAIRS", pairs)
    monkeypatch.setattr(sim, "_matched", lambda *a: calls.append(a) or whole(*a))
    for f in (tf, np.ones(len(row))):
        m, s, mn, le = sim._run_sums(block, utts, row, term, f, (0.0, 0.3, 0.5))
        for b in range(len(n)):
            k = block[row] == b
            want = whole((utts[row[k]], term[k], f[k]), None, (0.0, 0.3, 0.5))
            assert (m[b], [x[b] for x in le]) == (want[0], want[3]) and s[b] == pytest.approx(want[1])
            assert np.isnan(mn[b]) if want[2] is None else mn[b] == want[2]
    assert pairs == 30 or not calls
