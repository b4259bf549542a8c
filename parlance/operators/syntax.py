"""E (and the per-utterance D08–D14): POS shares, ratios and the interview
roll-up as a two-stage aggregate.

Stage 1 groups by (filename, utt_idx, token, pos) — the token's tag is a
function of the token, so one pass gives both per-type frequencies (for
Brunet / Honoré) and per-tag counts. Stage 2 groups by (filename, utt_idx);
stage 3 averages per filename. All three are partial-aggregated hash
aggregates; a very long transcript is spread over many tasks by stage 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx

NOUNS = ["NN", "NNP", "NNS", "NNPS"]
VERBS = ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"]
TAG_GROUPS = {
    "NumNouns": NOUNS,
    "NumVerbs": VERBS,
    "NumInflectedVerbs": ["VBD", "VBG", "VBN", "VBP", "VBZ"],
    "NumDeterminers": ["DT", "PDT", "WDT"],
    "NumAdverbs": ["RB", "RBR", "RBS", "WRB"],
    "NumAdjectives": ["JJ", "JJR", "JJS"],
    "NumInterjections": ["UH"],
    "NumSubordinateConjunctions": ["IN"],
    "NumCoordinateConjunctions": ["CC"],
}
PRONOUNS = ["PRP", "PRP$", "WP", "WP$"]  # Quirk 12 fixed


def utterance_counts(tagged: DataFrame) -> DataFrame:
    """Per utterance: N, V, V1, tag-group counts, length sum, FW and um/uh."""
    f = tagged.groupBy("filename", "utt_idx", "token", "pos").agg(F.count("*").alias("f"))

    def tag_sum(tags):
        return F.sum(F.when(F.col("pos").isin(tags), F.col("f")).otherwise(0))

    return f.groupBy("filename", "utt_idx").agg(
        F.sum("f").alias("N"), F.count("*").alias("V"), F.count_if(F.col("f") == 1).alias("V1"),
        *[tag_sum(tags).alias(f"c_{name}") for name, tags in TAG_GROUPS.items()],
        tag_sum(PRONOUNS).alias("c_pron"), tag_sum(["IN"]).alias("c_in"), tag_sum(["CC"]).alias("c_cc"),
        F.sum(F.col("f") * F.length("token")).alias("len_sum"),
        tag_sum(["FW"]).alias("c_fw"),
        F.sum(F.when((F.col("pos") == "FW") & (F.length("token") > 2), F.col("f")).otherwise(0)).alias("c_nid"),
        F.sum(F.when(F.col("token").isin("um", "uh"), F.col("f")).otherwise(0)).alias("c_umuh"))


def utterance_features(tagged: DataFrame) -> DataFrame:
    """E01–E13 and D08–D13 for every utterance (Quirk 10 fixed: true total)."""
    c = utterance_counts(tagged)
    N, V, V1 = F.col("N"), F.col("V"), F.col("V1")
    nouns, verbs = F.col("c_NumNouns"), F.col("c_NumVerbs")
    cols = [tx.safe_div(f"c_{name}", "N").alias(name) for name in TAG_GROUPS]
    honore = (F.when(V == 0, F.lit(0.0))
              .when(V1 == V, 100 * F.log(N) / (2 - V1 / V))
              .otherwise(100 * F.log(N) / (1 - V1 / V)))
    return c.select(
        "filename", "utt_idx", *cols,
        (nouns / (verbs + 1)).alias("RatioVerb"),
        (nouns / (nouns + verbs + 1)).alias("RatioNoun"),
        (F.col("c_pron") / (nouns + 1)).alias("RatioPronoun"),
        (F.col("c_cc") / (F.col("c_in") + 1)).alias("RatioCoordinate"),
        F.pow(N, V * -0.165).alias("BrunetIndex"),
        F.pow(N, F.pow(V, -0.165)).alias("brunet_w"),
        honore.alias("HonoreStatistic"),
        F.coalesce(tx.safe_div("len_sum", "N"), F.lit(0.0)).alias("MeanWordLength"),
        F.col("c_nid").cast("double").alias("NumberOfNID"),
        F.coalesce(tx.safe_div("c_umuh", "N"), F.lit(0.0)).alias("DisfluencyFrequency"),
        (N - F.col("c_fw") - F.col("c_umuh")).cast("double").alias("TotalNumberOfWords"))


ROLLUP_COLS = list(TAG_GROUPS) + ["RatioVerb", "RatioNoun", "RatioPronoun", "RatioCoordinate",
                                  "BrunetIndex", "brunet_w", "HonoreStatistic", "MeanWordLength",
                                  "NumberOfNID", "DisfluencyFrequency", "TotalNumberOfWords"]


def interview_rollup(tagged: DataFrame) -> DataFrame:
    """Mean over utterances of every per-utterance feature (Quirk 11
    fixed: NumVerbs is a mean like the others)."""
    u = utterance_features(tagged)
    return u.groupBy("filename").agg(*[tx.round6(F.avg(c)).alias(c) for c in ROLLUP_COLS])


def mean_sentence_length(utts: DataFrame, toks: DataFrame) -> DataFrame:
    """D14 (Quirk 9 fixed): tokens per sentence for each transcript."""
    s = utts.groupBy("filename").agg(F.sum(tx.sentence_count("text")).alias("n_sentences"))
    n = toks.groupBy("filename").agg(F.count("*").alias("n_tokens"))
    return s.join(n, "filename", "left").select(
        "filename", "n_sentences", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        tx.round6(tx.safe_div(F.coalesce("n_tokens", F.lit(0)), "n_sentences")).alias("mean_sentence_length"))


def light_verb_share(tagged: DataFrame) -> DataFrame:
    """Tokens whose surface form is a light verb / verb-tagged tokens."""
    return tagged.groupBy("filename").agg(
        tx.round6(tx.safe_div(F.count_if(F.lower("token").isin(lx.LIGHT_VERBS)),
                              F.count_if(F.col("pos").isin(VERBS)))).alias("light_verb_share"))
