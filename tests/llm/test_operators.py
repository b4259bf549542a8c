"""Training-data operators against brute force on small inputs, and their
defined results for nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names."""

import functools
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import decontam, licenses, lm, near_vectors, packing, sharding, simhash, token_files, toxicity, urls
from parlance.llm.common import components, shared_folder
from parlance.llm.queries import LLM_QUERIES, ids_crc32
from parlance.llm.tokens import default_tokenizer, encoder

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(15000))
ROWS = [(1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
        (4, "  two  spaces\n\n\nand lines \t don't stop", "en", "b"), (5, LONG, "en", "b"), (5, LONG, "en", "b"), (None, "no id here", "de", None),
        (7, "The quick brown fox jumps over the lazy dog again and again", "en", "c"), (8, "Ünïcode 漢字 <|endoftext|> text", "fr", "c"), (9, "a", "en", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"
# Names that the operators use inside.
CLASH = ("fp", "comp", "keep_id", "t", "i", "part", "w", "score", "toxicity_score", "repeated", "keep_fp", "node", "size", "contaminated_id", "sequence_id", "e", "lab", "key")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@functools.cache
def fresh_tokenizer():
    """The tokenizer as its file gives it."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_tokenizer())


def whole_ids(text):
    return fresh_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_special_tokens_keep_their_id():
    assert whole_ids("end <|endoftext|> of text").count(50256) == 1
    texts = ["end <|endoftext|> of text", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "<|endoftext| >", "end of text"]
    assert [g.tolist() for g in encoder(default_tokenizer()).encode(texts)] == [whole_ids(t) for t in texts]


def test_small_caches_change_nothing(monkeypatch):
    from parlance.llm import tokens
    monkeypatch.setattr(tokens, "CACHE", 20)
    rng = np.random.default_rng(8)
    enc = tokens.Encoder(default_tokenizer())
    for _ in range(30):
        texts = [" ".join(f"w{int(x)}{'.,!'[int(x) % 3]}" for x in rng.integers(0, 60, 15)) for _ in range(4)]
        assert [g.tolist() for g in enc.encode(texts)] == [whole_ids(t) for t in texts]


def test_chunked_encoding_equals_whole_text():
    rng = np.random.default_rng(3)
    parts = [" ", "\n", "\t", "  ", "\n\n", "don't", "'s", "it's", "Word", " word", ".", ",", "_", "12", "é", "ß", "²", "漢", " ", "😀", "a.b", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(3000)]
    got = encoder(default_tokenizer()).encode(texts)
    assert all(list(g) == whole_ids(t) for g, t in zip(got, texts))


def test_token_files(spark, docs, none):
    m = token_files.write_token_files(docs, token_files.new_folder(shared_folder(spark)), default_tokenizer(), 2)
    got = sorted(token_files.read_token_files(m).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 7, 8, 9]
    text = {r[0]: r[1] for r in ROWS}
    start = 0
    for r in got:
        ids = [*whole_ids(text[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    m = token_files.write_token_files(none, token_files.new_folder(shared_folder(spark)), default_tokenizer(), 2)
    assert token_files.read_token_files(m).count() == 0


def test_packing(spark, docs, none):
    path = default_tokenizer()
    got = packing.pack(docs, path, 0, 1024).withColumn("crc", ids_crc32(F.col("ids"), packing.id_width(path))).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()]
        assert sum(r["length"] for r in pieces) <= 1024
    text = {r[0]: r[1] for r in ROWS}
    covered = Counter()
    for r in got:
        ids = [*whole_ids(text[r["doc_id"]]), 0]
        assert r["doc_tokens"] == len(ids)
        assert r["crc"] == r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
        covered[r["doc_id"]] += r["length"]
    assert all(covered[r[0]] == (len(whole_ids(r[1])) + 1) * (2 if r[0] == 5 else 1) for r in ROWS)
    assert packing.pack(none, path, 0).count() == 0


def test_level_packer_prefers_balanced_levels():
    p = packing.LevelPacker(10)
    # A second window at level 4 would square to 4, one at level 8 stays 1.
    assert p.place((1, 0, 4)) is None and p.place((2, 0, 4)) is None
    assert p.count[8] == 1 and p.count.sum() == 1
    assert p.place((3, 0, 6)) is None
    assert [sum(x[2] for x in b) for b in p.finish()] == [10, 4]


def brute_fingerprint(text, k):
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_groups(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    text = {r[0]: r[1] for r in ROWS}
    for r in got:
        assert r["fp"] & (2 ** 64 - 1) == brute_fingerprint(text[r["doc_id"]], 4)
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[7] == 1 and comp[3] == 2 and comp[5] == 5 and comp[None] is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 4, 5, None, 8, 9])
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_simhash_links_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20]:
        x = int(b)
        for _ in range(12):  # chains and dense groups
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps], "fp long")
    comp = {r["node"] & (2 ** 64 - 1): r["comp"] for r in components(simhash.link_fingerprints(df, 4, block)).collect()}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    want = {}
    for f in fps:
        want.setdefault(find(f), set()).add(f)
    have = {}
    for f in fps:
        have.setdefault(comp.get(f, ("own", f)), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_position_triples_cover_every_four_positions():
    from itertools import combinations
    sets = simhash.position_sets()
    assert len(sets) == 20
    assert all(any(set(t) <= set(q) for t in sets) for q in combinations(range(8), 4))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert len(got) == 201 and set(got.values()) == {0}
    assert components(edges.filter("u < 0")).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(10, "quick brown fox jumps over the lazy dog"), (11, "quick brown fox jumps over the lazy dog"), (12, None), (13, "no id"), (14, "never seen words in this corpus at all"), (None, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 10, 4), (1, 11, 4), (7, 10, 4), (7, 11, 4), (None, 13, 1)}
    left = decontam.remove_contaminated(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {2, 3, 4, 5, 8, 9}
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.remove_contaminated(docs, items.filter("item_id < 0")).count() == len(ROWS)


def test_toxicity_learns_and_has_defined_edges(spark, docs, none):
    rng = np.random.default_rng(1)
    good = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = list(rng.choice(good, 40)) + (["zqxvile", "zqxmean"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame(labels + [(0, 1), (None, 1), (99999, 1), (3, None)], "doc_id long, toxic int")
    m = toxicity.train(d, y.filter("doc_id < 300 or doc_id is null or doc_id > 400"))
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", toxicity.score(F.col("text"), m, spark).alias("s")).collect()}
    held = [i for i in range(300, 400)]
    assert np.mean([(got[i] >= 0.7) == (i % 5 == 0) for i in held]) > 0.95
    assert docs.select(toxicity.score(F.col("text"), m, spark).alias("s")).filter("s is null or s < 0 or s > 1").count() == 0
    m = toxicity.train(none, y)
    assert m.score(np.empty(0, np.int64)) < 1e-6


def test_sharding(spark, docs, none):
    dims = {"len": F.length("text"), "src": sharding.spread(F.col("source"))}
    got = sharding.kd_shards(docs, dims, n_shards=3).collect()
    assert len(got) == len(ROWS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["doc_id"]: r["size"] for r in got}[2] == 1
    assert sharding.kd_shards(none, dims, n_shards=8).count() == 0
    # A hot group is cut: a third of all bytes is one text.
    hot = spark.createDataFrame([(i, "same text again" if i % 3 == 0 else f"text {i} of its own {'x' * (i % 50)}", "en", "s") for i in range(3000)], SCHEMA)
    sizes = Counter()
    for r in sharding.kd_shards(hot, dims, n_shards=8).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) / min(sizes.values()) < 1.1


def test_language_model(spark, docs, none):
    held = F.coalesce(F.col("doc_id") == 7, F.lit(False))
    got = lm.score(docs, held).collect()
    train = Counter()
    for i, t, *_ in ROWS:
        if i != 7:
            train.update((t or "").encode().lower().split() + [b""])
    n, v = sum(train.values()), len(train)
    text = {r[0]: r[1] for r in ROWS}
    for r in got:
        w = (text[r["doc_id"]] or "").encode().lower().split() + [b""]
        assert r["n_tokens"] == len(w) and r["train_tokens"] == n and r["n_known"] == sum(x in train for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm.score(none, held).count() == 0
    assert lm.score(docs, F.lit(True)).filter("score is null or n_known > 0").count() == 0


def test_language_model_is_normalised(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), 2000 // (i + 1)) for i in range(700)] + [(bytearray(b""), 90)], "w binary, c long")
    texts = spark.createDataFrame([(bytearray(b"w0 w1 w2 w600 w3"),)] * 20, "t binary")
    m = lm.train(texts, counts)
    every = np.arange(m.v.short + 1)
    p = 10 ** m.log10(np.full(len(every), 3), np.full(len(every), m.v.bos), every)
    assert p.sum() == pytest.approx(1, abs=1e-4)
    # The tail class spreads its share over its words and one unknown.
    rest = m.v.count[m.v.short:-1] + 1
    assert (rest.sum() + 1) / m.v.tail_mass == pytest.approx(1)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    rows = [(i, x[i % 20].tolist() if i < 40 else (x[i] * 1.0).tolist(), i % 2) for i in range(60)]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 8, 1), (103, [float("nan")] * 8, 1), (104, x[0].tolist(), None), (105, x[0][:4].tolist(), 0), (None, x[1].tolist(), 1), (3, x[3].tolist(), 1), (106, (x[0] * 3).tolist(), 0), (107, [None] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit(1), "e": F.lit(2)})
    got = near_vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    ok = [(i, np.array(v, float), y) for i, v, y in rows if v and None not in v and y is not None and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    for i, v, y in ok:
        links = [j for j, (a, b, c) in enumerate(ok) if c == y and len(b) == len(v) and b is not v and v @ b / np.linalg.norm(v) / np.linalg.norm(b) >= 0.98]
        ids = [ok[j][0] for j in links] + [i]
        assert by[i, len(links), min(z for z in ids if z is not None)], (i, len(links), ids)
    assert all(by[i, 0, i] for i in (100, 101, 102, 103, 104, 105, 107))
    assert near_vectors.near_vectors(df.filter("vec_id < 0")).count() == 0


def test_dense_cluster_beyond_the_lists(spark):
    rng = np.random.default_rng(4)
    c = rng.standard_normal(16)
    rows = [(i, (c + rng.standard_normal(16) * 0.01).tolist(), 0) for i in range(700)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(699, 0)}


def brute_links(x, threshold=0.98):
    """(links a row, smallest row of the component a row) over all pairs."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(low, np.where(near, low[None, :], len(x)).min(1))
        if (new == low).all():
            break
        low = new
    return near.sum(1), low


def linked_groups(groups=6, size=60, dim=32):
    """Tight groups (cosine above 0.99 inside), each linked with the next at
    0.98-0.985 only, and scattered vectors."""
    rng = np.random.default_rng(11)
    base, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    step = np.arccos(0.9825)
    centre = [np.cos(step * g) * base[0] + np.sin(step * g) * base[1] for g in range(groups)]
    tight = [c + rng.standard_normal(dim) * 0.002 for c in centre for _ in range(size)]
    return np.array(tight + [rng.standard_normal(dim) for _ in range(200)])


def test_tight_groups_that_are_linked_with_each_other(spark):
    x = linked_groups()
    links, low = brute_links(x)
    assert len(set(low[:360])) == 1 and links[:360].min() > 59
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, int(n), int(c)) for i, (n, c) in enumerate(zip(links, low))]


@pytest.mark.parametrize("threshold", [0.98, 0.5])
def test_links_between_components_need_no_graph(spark, threshold):
    x = linked_groups(3, 20, 8)
    links, low = brute_links(x, threshold)
    vec = [(i, "0", 8, (v / np.linalg.norm(v)).astype("<f8").tobytes()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(vec, "node long, lab string, len int, x binary")
    for pairs in ([], [(i, i + 1) for i in range(59) if i % 20 != 19]):
        pairs = spark.createDataFrame(pairs, "u long, v long")
        comp = components(pairs)
        cross = near_vectors.cross_links(nodes, pairs, comp, threshold)
        whole = {r["node"]: r["comp"] for r in components(comp.toDF("u", "v").union(cross)).collect()}
        assert [whole.get(i, i) for i in range(len(x))] == low.tolist()


def test_audit_sees_lost_links(spark):
    rng = np.random.default_rng(12)
    unit = lambda v: (v / np.linalg.norm(v)).astype("<f8").tobytes()
    hot, alone = rng.standard_normal(16), rng.standard_normal((3, 100, 16))
    vec = [hot + rng.standard_normal(16) * 0.001 for _ in range(300)] + [v for a in alone[0] for v in (a, a * 1.5 + 1e-6)] + list(alone[1]) + list(alone[2])
    nodes = spark.createDataFrame([(i, "0", 16, 1, unit(v)) for i, v in enumerate(vec)], "node long, lab string, len int, mult long, x binary")
    found = [(i, 299) for i in range(300)] + [(i, 1) for i in range(300, 500)]
    links = spark.createDataFrame(found, "node long, links long")
    assert near_vectors.audited_recall(nodes, links, 0.98) == 1.0
    # By link all lost pairs are under 0.3 %, by node two in five.
    assert near_vectors.audited_recall(nodes, links.filter("node < 300"), 0.98) < 0.8
    sparse = nodes.filter("node >= 500")
    assert near_vectors.audited_recall(sparse.limit(50), links, 0.98) == 1.0
    many = spark.range(20_000).select("id", F.lit("0").alias("lab"), F.lit(2).alias("len"), F.lit(1).alias("mult"), F.lit(unit(np.array([1.0, 0]))).alias("x")).toDF("node", "lab", "len", "mult", "x")
    assert near_vectors.audited_recall(many, links.filter("node < 0"), 0.98) == 0.0
    assert near_vectors.audited_recall(many, links.filter("node < 0"), 1.5) is None


def test_a_bad_audit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "audited_recall", lambda *a: 0.5)
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError):
        near_vectors.near_vectors(df)


def test_urls(spark):
    def link(to):
        return f'<head><LINK href="{to}" rel="canonical"></head>'
    rows = [(1, "http://a.net/x", None), (2, "https://b.example.com/p", link("http://a.net/x/")), (3, "http://c.example.com/q", '<meta http-equiv="Refresh" content="0; url=https://b.example.com/p?utm_source=f">'),
            (4, "https://d.example.net/en/1", link("http://a.net/x")), (5, "https://e.example.com/fr/1", ""), (6, None, link("http://a.net/x")), (7, "no scheme", None), (8, "HTTP://E.EXAMPLE.COM/de/1", None),
            (9, "http://f.example.com/dir/page", link("/de/9")), (10, "http://f.example.com/de/9#top", None), (2, "https://b.example.com/p", None), (None, "http://x.org/fr/1?a", None), (11, "http://net", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "rule": F.lit("z")})
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()]
    want = [(1, "a.net", "/x", "net/", "block"), (2, "b.example.com", "/p", None, "block"), (2, "b.example.com", "/p", None, "block"), (3, "c.example.com", "/q", None, "block"), (4, "d.example.net", "/en/1", "example.net/en/", "allow"),
            (5, "e.example.com", "/fr/1", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "e.example.com", "/de/1", "example.com/de/", "block"), (9, "f.example.com", "/dir/page", None, "block"), (10, "f.example.com", "/de/9", "example.com/de/", "block"), (None, "x.org", "/fr/1", "org/fr/", "allow"), (11, "net", "", None, "allow")]
    assert Counter(got) == Counter(want)
    assert urls.judge(df.filter("page_id < 0"), rules).count() == 0


def test_urls_blocked_through_urls_that_are_no_pages(spark):
    def link(to):
        return f'<link rel="canonical" href="{to}">'
    rows = [(1, "http://good.com/x", link("http://bad.net/y")), (2, "http://other.com/x", link("http://bad.net/y/")), (3, "http://third.com/x", '<meta http-equiv="refresh" content="0; url=http://bad.net/y">'),
            (4, "http://safe.org/a", link("http://bad.net/y")), (5, "http://good.com/z", link("http://fine.com/y")), (6, "http://one.com/a", None), (7, "http://six.com/s", link("http://six.com/s/")), (8, "http://two.com/a", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("net", "/", "block"), ("safe.org", "/", "allow"), ("six.com", "/s/", "block")], "host string, path string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, rules).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow"}
    edges = spark.createDataFrame([("http://one.com/a", "http://hop.com/b"), ("http://hop.com/b", "http://far.net/c"), ("http://two.com/a", None)], "u string, v string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, rules, edges).filter("page_id in (6, 8)").collect()} == {6: "block", 8: "allow"}


def test_licenses(spark, none):
    rows = [(1, "p/a/LICENSE", "Licensed under the Apache License, Version 2.0.", True), (2, "p/a/b/c.txt", "code " * 50, False), (3, "p/x.txt", "Text here.\nReleased under the MIT License.\nmore text " * 3, False),
            (4, "p/a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3.", True), (5, "q/x.txt", None, False), (6, None, "", None), (7, "p/a/z.txt", "the work is under this version", False), (7, "p/a/z.txt", "the work is under this version", False)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string, f boolean").withColumns({"dir": F.lit("d"), "own": F.lit(1)})
    got = Counter((r["doc_id"], r["own"], r["license"], r["origin"]) for r in licenses.scan_licenses(df, F.col("p"), F.col("f")).collect())
    assert got == Counter([(1, "Apache-2.0", "Apache-2.0", None), (2, None, "GPL-3.0", "p/a/b"), (3, "MIT", "MIT", None), (4, "GPL-3.0", "GPL-3.0", None), (5, None, None, None), (6, None, None, None), (7, None, "Apache-2.0", "p/a"), (7, None, "Apache-2.0", "p/a")])
    assert licenses.scan_licenses(df.filter("doc_id < 0"), F.col("p"), F.col("f")).count() == 0


def test_license_at_the_root(spark):
    rows = [(1, "LICENSE", "Released under the MIT License.", True), (2, "src/a.py", "code", False), (3, "b.py", "code", False), (4, "/abs/c.py", "code", False), (5, None, "code", False),
            (6, "src/x/LICENSE", "Licensed under CC BY 4.0.", True), (7, "src/x/y/d.py", "code", False)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string, f boolean")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(df, F.col("p"), F.col("f")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("MIT", ""), 5: (None, None), 6: ("CC-BY-4.0", None), 7: ("CC-BY-4.0", "src/x")}


GPL = """# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{1} either version {2} of the License, or
# (at your option) any later version.
"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
"""
MIT = """// Permission is hereby granted, free of charge, to any person
// obtaining a copy of this software and associated documentation
// files (the "Software"), to deal in the Software without restriction
"""


def test_wrapped_license_headers(spark):
    code = "def f(x):\n    return x + 1\n\nimport os\n" * 30
    long = code * 50  # longer than a chunk of sentences
    heads = [(1, GPL.format(";", ";", 2), "GPL-2.0"), (2, GPL.format(":", ",", 3), "GPL-3.0"), (3, BSD, "BSD-3-Clause"), (4, MIT, "MIT"), (5, "", None),
             (6, "                GNU GENERAL PUBLIC LICENSE\n                   Version 2, June 1991\n", "GPL-2.0"), (7, "          GNU GENERAL PUBLIC LICENSE\n             Version 3, 29 June 2007\n", "GPL-3.0"),
             (8, "      Apache License\n   Version 2.0, January 2004\nhttp://www.apache.org/licenses/\n", "Apache-2.0")]
    rows = [(i, "f/" + str(i), code + h + code) for i, h, _ in heads] + [(10 + i, "g/" + str(i), long + h) for i, h, _ in heads]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r["doc_id"]: r["own"] for r in licenses.scan_licenses(df, F.col("p"), F.lit(False)).collect()}
    assert got == {k + i: name for i, _, name in heads for k in (0, 10)}


def test_pipeline_stages(spark, docs, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "packing"]
    for stage in (s for _, s in corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 11))
    assert os.path.exists(default_tokenizer())
