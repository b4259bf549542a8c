"""Mini fixtures checked against brute-force definitions written out here."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.operators import lexical as lex
from parlance.operators import prep, psych, similarity as sim, trees as tr

TEXTS = [
    (1, 0, "the boy is taking a cookie from the jar and the stool is falling"),
    (1, 1, "the mother is drying the dishes while the water is overflowing the sink"),
    (1, 2, "um the girl the girl laughs"),
    (2, 0, "a a a a b b c"),
    (3, 0, "word"),
]


def _utts(spark):
    return spark.createDataFrame(TEXTS, "filename long, utt_idx long, text string")


def _seq(fn):
    toks = {}
    for f, u, t in TEXTS:
        toks.setdefault(f, []).extend(t.split())
    return toks if fn is None else {k: fn(v) for k, v in toks.items()}


def mtld_ref(words, thr=0.72):
    def sub(ws):
        types, n, factors = set(), 0, 0.0
        ttr = 1.0
        for w in ws:
            n += 1
            types.add(w)
            ttr = len(types) / n
            if ttr <= thr:
                types, n, factors = set(), 0, factors + 1
        if n > 0:
            factors += (1 - ttr) / (1 - thr)
        if factors == 0:
            factors = 1
        return len(ws) / factors
    return (sub(words) + sub(words[::-1])) / 2


def mattr_ref(words, w):
    if len(words) < w:
        return None
    vals = [len(set(words[i:i + w])) / w for i in range(len(words) - w + 1)]
    return sum(vals) / len(vals)


def hdd_ref(words):
    n = len(words)
    return sum((1 - (n - f) * (n - f - 1) / (n * (n - 1))) / 2 for f in Counter(words).values()) if n > 1 else None


def test_richness_against_definitions(spark):
    rich = lex.rich_tokens(prep.token_table(_utts(spark)))
    got = {r["filename"]: r for r in lex.mtld(rich).join(lex.mattr(rich, 3), "filename")
           .join(lex.richness_scalar(rich), "filename").collect()}
    for f, ws in _seq(None).items():
        assert got[f]["mtld"] == pytest.approx(mtld_ref(ws), abs=1e-6)
        want = mattr_ref(ws, 3)
        assert (got[f]["mattr_3"] is None) if want is None else got[f]["mattr_3"] == pytest.approx(want, abs=1e-6)
        h = hdd_ref(ws)
        if h is not None:
            assert got[f]["hdd"] == pytest.approx(h, abs=1e-6)


def test_mattr_short_text_pads(spark):
    rich = lex.rich_tokens(prep.token_table(_utts(spark)))
    r = {x["filename"]: x["mattr_20"] for x in lex.mattr(rich, 20, pad_short=True).collect()}
    assert r[3] == pytest.approx(1 / 20)
    assert r[2] == pytest.approx(3 / 20)


def _tfidf_cos(a, b):
    ta, tb = Counter(a), Counter(b)
    if not ta or not tb:
        return 0.0
    c = 1 + math.log(1.5)
    idf = {t: (1.0 if t in ta and t in tb else c) for t in set(ta) | set(tb)}
    va = {t: ta[t] * idf[t] for t in ta}
    vb = {t: tb[t] * idf[t] for t in tb}
    dot = sum(va[t] * vb.get(t, 0) for t in va)
    return dot / (math.sqrt(sum(v * v for v in va.values())) * math.sqrt(sum(v * v for v in vb.values())))


def test_pair_cosine_brute_force(spark):
    utts = _utts(spark)
    terms = sim.utterance_terms(spark, utts)
    per = {}
    for r in terms.collect():
        per.setdefault((r["filename"], r["utt_idx"]), Counter())[r["term"]] += r["tf"]
    got = {(r["filename"], r["utt_a"], r["utt_b"]): r["cosine"] for r in sim.pair_cosine(terms).collect()}
    keys = sorted(per)
    for (f1, a) in keys:
        for (f2, b) in keys:
            if f1 == f2 and a < b:
                want = _tfidf_cos(list(per[(f1, a)].elements()), list(per[(f2, b)].elements()))
                assert got.get((f1, a, b), 0.0) == pytest.approx(want, abs=1e-12)
    feats = {r["filename"]: r for r in sim.distance_features(utts, sim.pair_cosine(terms)).collect()}
    assert feats[1]["n_pairs"] == 3 and feats[3]["n_pairs"] == 0 and feats[3]["avg_cos_dist"] is None


def test_tree_nodes_and_phrases(spark):
    t = spark.createDataFrame([(1, 0, 0, "(ROOT (S (NP (DT the) (NN boy)) (VP (VBD fell) (PP (IN off) (NP (DT the) (NN stool))))))")],
                              "filename long, utt_idx long, tree_idx long, tree string")
    nodes = tr.tree_nodes(t)
    rows = sorted((r["node_id"], r["parent_id"], r["depth"], r["label"], r["word"]) for r in nodes.collect())
    assert rows[0] == (0, -1, 0, "ROOT", None)
    assert rows[3] == (3, 2, 3, "DT", "the")
    assert len(rows) == 12
    size = tr.tree_size(nodes).first()
    assert (size["n_nodes"], size["height"]) == (12, 6)
    p = tr.phrase_features(nodes).first()
    # NP words: "the boy" (1 NP each) + "the stool" (1 NP) = 4; VP covers "fell off the stool" = 4
    assert (p["len_NP"], p["len_VP"], p["len_PP"]) == (4, 4, 3)
    assert (p["emb_NP"], p["out_NP"]) == (2, 2)
    rules = tr.named_rules(nodes).first()
    assert rules["NP_to_DT_NN"] == 2 and rules["VP_to_VBD_NP"] == 0


def test_information_units(spark):
    utts = _utts(spark)
    toks = prep.token_table(utts)
    iu = {r["filename"]: r for r in psych.info_units(spark, prep.words(toks), utts).collect()}
    assert iu[1]["keywordBoy"] == 1 and iu[1]["keywordJar"] == 1 and iu[1]["keywordWater"] == 1
    assert iu[1]["keywordWoman"] == 1 and iu[1]["keywordGirl"] == 2 and iu[1]["binaryCurtains"] == 0
    au = {r["filename"]: r for r in psych.action_units(prep.tag_tokens(spark, toks)).collect()}
    assert au[1]["keywordIUActionBoyTaking"] == 1
    assert au[1]["keywordIUActionWaterOverflowing"] == 1
    words = lex.rich_tokens(toks).withColumnRenamed("term", "word")
    sw = {r["filename"]: r["ls_rs_switches"] for r in psych.side_switches(spark, words).collect()}
    # boy(L) cookie(L) jar(L) stool(L) | mother(R) dishes(R) water(R) sink(R) | girl(L) girl(L)
    assert sw[1] == 2


def test_clean_and_apostrophes(spark):
    from parlance.functions import text as tx
    df = spark.createDataFrame([("do n't go 123 xxx [+ exc] now",)], "text string")
    r = df.select(tx.merge_apostrophes(tx.clean_text("text")).alias("c")).first()["c"]
    assert r == " dont go now"


def test_repeat_markers(spark):
    df = spark.createDataFrame([("the dog [x 3] ran",)], "text string")
    assert df.select(prep.resolve_repeats("text")).first()[0] == "the dog dog dog ran"


def test_mattr_across_bucket_edges(spark, monkeypatch):
    monkeypatch.setattr(lex, "MATTR_BUCKET", 4)
    rich = lex.rich_tokens(prep.token_table(_utts(spark)))
    for w in (3, 5):
        got = {r["filename"]: r[f"mattr_{w}"] for r in lex.mattr(rich, w).collect()}
        for f, ws in _seq(None).items():
            want = mattr_ref(ws, w)
            assert (got[f] is None) if want is None else got[f] == pytest.approx(want, abs=1e-6)


def test_chat_tiers_fixture(spark):
    text = "\n".join(["@Begin", "@Participants:\tPAR Participant", "*INV:\ttell me what you see .",
                      "*PAR:\tthe boy is on the stool", "\tand it is falling .", "%mor:\tdet|the n|boy",
                      "%gra:\t1|2|DET 2|0|ROOT", "*PAR:\twater [x 2] everywhere .", "@End", "*PAR:\tignored"])
    files = spark.createDataFrame([("f1", text)], "filename string, text string")
    rows = sorted((r["utt_idx"], r["speaker"], r["text"], r["mor"], r["gra"])
                  for r in prep.chat_tiers(prep.chat_lines(files)).collect())
    assert rows == [
        (1, "INV", "tell me what you see .", "", ""),
        (2, "PAR", "the boy is on the stool and it is falling .", "det|the n|boy", "1|2|DET 2|0|ROOT"),
        (3, "PAR", "water [x 2] everywhere .", "", ""),
    ]
    resolved = spark.createDataFrame([(rows[2][2],)], "t string").select(prep.resolve_repeats("t")).first()[0]
    assert resolved == "water water everywhere ."
