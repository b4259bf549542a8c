"""The one-pass text profile: the values of the two operators it joins, whatever the runs."""
import pytest

from parlance.operators import lexical as lex
from parlance.operators import prep

LINES = [
    "The cat, the CAT and the dog's 2nd bone!", "a\tb\x0bc\x0cd\re f", " café Café naïve ΟΔΟΣ İstanbul Kelvin",
    "x1y22z333 ٣٤ Ⅷ 12.5% \U0001d400\U0001f600\U0001f600 é", "   ", "\t", "", "...", "is was been being running walked quickly", "a\u0085b \x1cc\x1fd \x00",
]
ROWS = [(i % 4 + 1, i, t) for i, t in enumerate(LINES * 2)] + [(7, k, f"word{k % 50} Again, and again {k % 7}.") for k in range(3000)]
ROWS += [(8, 0, "..."), (9, 0, "one"), (10, 0, None), (None, 0, "lost words"), (7, 0, "twice the key"), (11, 0, "Zebra zebra")]


def both(spark, utts):
    toks = prep.token_table(utts)
    a = lex.token_profile(prep.tag_types(spark, lex.token_types(toks)))
    return a.join(lex.richness_scalar(lex.rich_terms(toks)).select("filename", "maas", "hdd"), "filename")


@pytest.mark.parametrize("words", [1, 40, 10_000_000])
@pytest.mark.parametrize("key", ["bigint", "string"])
def test_profile_equals_the_joined_operators(spark, words, key):
    utts = spark.createDataFrame(ROWS, "filename long, utt_idx int, text string").selectExpr(f"cast(filename as {key}) filename", "utt_idx", "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # so that a transcript goes on over runs
    try:
        got = lex.text_profile(spark, utts, words)
        want = both(spark, utts)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tokens_are_made_once_from_texts_shuffled_once(spark):
    utts = spark.createDataFrame(ROWS, "filename long, utt_idx int, text string")
    plan = lex.text_profile(spark, utts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("regexp_extract_all") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_feature_table_makes_tokens_for_the_profile_once(spark, tmp_path):
    from parlance.plans import featuretable as ft
    spark.createDataFrame([(1, "One two.\nTwo three!"), (2, "Four\nfour five")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t = ft.doc_features(spark, str(tmp_path))
    assert t._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # the similarity's are made before
    assert t.count() == 2


def test_spaced_tokens_are_the_tokens(spark):
    from pyspark.sql import functions as F
    from parlance.functions import text as tx
    odd = LINES + ["plain words only", "  two  spaces ", "end\u0085", "end ", "end\r", "end\n", "tab\tbed", "no break", None, "a1", "\U0001d400b c"]
    got = spark.createDataFrame([(t,) for t in odd], "text string").select(tx.tokens("text").alias("a"), tx.spaced_tokens("text").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_similarity_terms_split_plain_texts(spark):
    from parlance.operators import similarity as sim
    utts = spark.createDataFrame(ROWS, "filename long, utt_idx int, text string")
    assert "split(" in sim.utterance_terms(spark, utts, block=256)._jdf.queryExecution().optimizedPlan().toString()
