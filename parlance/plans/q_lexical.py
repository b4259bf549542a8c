"""Registered queries for B (preparation), C (counts) and D (richness)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import lexical as lex
from ..operators import prep
from ..sources.tables import read
from . import sqlparts as S
from . import transcripts as T
from .registry import query

CONV_TOK = S.with_(S.UTT_CONV, S.TOK)
CONV_TAGGED = S.with_(S.UTT_CONV, S.TOK, S.TAGGED)
DOC_TOK = S.with_(S.UTT_DOCS, S.TOK)
DOC_TAGGED = S.with_(S.UTT_DOCS, S.TOK, S.TAGGED)


# --- flagship: lexical profile of the participant's speech -----------------

def lexical_profile(spark, sf_dir):
    """Per conversation: utterances, tokens, distinct tokens, TTR, mean token
    length of the user's turns (B02, B10, B20, C01, C02, D01, D10)."""
    utts = T.conv_utterances(spark, sf_dir)
    toks = prep.token_table(utts)
    n_utt = utts.groupBy("filename").agg(F.count("*").alias("n_utterances"))
    return n_utt.join(lex.token_counts(toks), "filename", "left").fillna(0, ["n_tokens", "n_unique_tokens"])


LEXICAL_PROFILE_SQL = CONV_TOK + f"""
, n_utt AS (SELECT filename, count(*) AS n_utterances FROM utt GROUP BY filename)
, tc AS (SELECT filename, count(*) AS n_tokens, count(DISTINCT token) AS n_unique_tokens,
         {S.r6('count(DISTINCT token) / count(*)')} AS ttr, {S.r6('avg(length(token))')} AS mean_token_length
         FROM tok GROUP BY filename)
SELECT n.filename, n.n_utterances, coalesce(tc.n_tokens, 0) AS n_tokens,
       coalesce(tc.n_unique_tokens, 0) AS n_unique_tokens, tc.ttr, tc.mean_token_length
FROM n_utt n LEFT JOIN tc ON n.filename = tc.filename"""

query("q_lexical_profile", LEXICAL_PROFILE_SQL)(lexical_profile)


@query("b02_speaker_filter", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def b02(spark, sf_dir):
    conv = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conv.filter(F.col("role") == "user").select("conv_id", "turn", "text")


@query("b03_clean_text", S.with_(S.UTT_CONV) + """
SELECT filename, utt_idx, """ + "{CLEAN}" + """ AS clean FROM utt""")
def b03(spark, sf_dir):
    return T.conv_utterances(spark, sf_dir).select("filename", "utt_idx", tx.clean_text("text").alias("clean"))


def _clean_sql(expr="text"):
    out = expr
    for pat, rep in tx.CLEAN_STEPS:
        pat_sql = pat.replace("'", "''")
        if pat == r"‡":
            pat_sql = "‡"
        out = f"regexp_replace({out}, '{pat_sql}', '{rep}', 'g')"
    return out


def _merge_apos_sql(expr):
    t = f"trim({expr})"
    spaced = f"(' ' || regexp_replace({t}, '\\s+', ' ', 'g'))"
    # RE2 has no look-ahead: drop a space followed by a run holding an apostrophe.
    glued = f"regexp_replace({spaced}, ' ([^ ]*'')', '\\1', 'g')"
    return f"CASE WHEN {t} = '' THEN '' ELSE replace({glued}, '''', '') END"


from .registry import ORACLE  # noqa: E402

ORACLE["b03_clean_text"] = ORACLE["b03_clean_text"].replace("{CLEAN}", _clean_sql())


@query("b05_apostrophe_merge", S.with_(S.UTT_CONV) + f"""
SELECT filename, utt_idx, {_merge_apos_sql(_clean_sql())} AS clean FROM utt""")
def b05(spark, sf_dir):
    return T.conv_utterances(spark, sf_dir).select(
        "filename", "utt_idx", tx.merge_apostrophes(tx.clean_text("text")).alias("clean"))


@query("b06_join_utterances", S.with_(S.UTT_CONV) + f"""
, c AS (SELECT filename, utt_idx, {_merge_apos_sql(_clean_sql())} || ' ' ||
        CASE WHEN contains(text, '?') THEN '? ' ELSE '. ' END AS t FROM utt)
SELECT filename, ' ' || string_agg(t, '' ORDER BY utt_idx) AS utterance, count(*) AS n_utterances
FROM c GROUP BY filename""")
def b06(spark, sf_dir):
    return prep.join_utterances(T.conv_utterances(spark, sf_dir)).drop("single_utt")


@query("b08_remove_non_ascii", """
SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS ascii_text FROM documents""")
def b08(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", tx.remove_non_ascii("text").alias("ascii_text"))


@query("b09_word_chunks", """
WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS ws FROM documents WHERE trim(text) <> '')
SELECT doc_id, CAST(unnest(range(CAST(ceil(len(ws) / 50.0) AS BIGINT))) AS INTEGER) AS chunk_idx,
       len(ws) AS n_doc_words FROM w""")
def b09(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    ch = d.select("doc_id", prep.chunk_words("text", 50).alias("chunks"),
                  F.size(F.split(F.trim("text"), r"\s+")).alias("n_doc_words"))
    return ch.select("doc_id", F.posexplode("chunks").alias("chunk_idx", "chunk"), "n_doc_words").drop("chunk")


@query("b10_tokens", CONV_TOK + "SELECT filename, utt_idx, tok_idx, token FROM tok")
def b10(spark, sf_dir):
    return T.conv_tokens(spark, sf_dir)


@query("b11_nonpunct_tokens", CONV_TOK + """
SELECT filename, count(*) AS n_terms, count(DISTINCT lower(token)) AS n_types
FROM tok WHERE NOT regexp_matches(token, '^[^\\p{L}\\p{N}]$') GROUP BY filename""")
def b11(spark, sf_dir):
    t = T.conv_tokens(spark, sf_dir).filter(~tx.is_punct_token("token"))
    return t.groupBy("filename").agg(F.count("*").alias("n_terms"),
                                     F.count_distinct(F.lower("token")).alias("n_types"))


@query("b12_words", CONV_TOK + f"""
SELECT filename, count(*) AS n_words, count(DISTINCT lower(token)) AS n_word_types
FROM tok WHERE regexp_matches(token, '{tx.WORD_RE}') GROUP BY filename""")
def b12(spark, sf_dir):
    w = prep.words(T.conv_tokens(spark, sf_dir))
    return w.groupBy("filename").agg(F.count("*").alias("n_words"),
                                     F.count_distinct("word").alias("n_word_types"))


@query("b13_non_stop_words", S.with_(S.UTT_CONV, S.TOK, S.STOP) + f"""
SELECT filename, count(*) AS n_content_words FROM tok
WHERE regexp_matches(token, '{tx.WORD_RE}') AND lower(token) NOT IN (SELECT word FROM stop)
GROUP BY filename""")
def b13(spark, sf_dir):
    w = prep.non_stop_words(spark, T.conv_tokens(spark, sf_dir))
    return w.groupBy("filename").agg(F.count("*").alias("n_content_words"))


@query("b14_normalise_stem", S.with_(S.UTT_CONV) + """
, t AS (SELECT filename, unnest(regexp_extract_all(lower(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g')),
        '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]')) AS w FROM utt)
, s AS (SELECT filename, CASE WHEN length(w) > 4 AND w LIKE '%ing' THEN substr(w, 1, length(w) - 3)
        WHEN length(w) > 3 AND w LIKE '%ed' THEN substr(w, 1, length(w) - 2)
        WHEN length(w) > 3 AND w LIKE '%s' AND NOT w LIKE '%ss' THEN substr(w, 1, length(w) - 1)
        ELSE w END AS stem FROM t)
SELECT stem, count(*) AS n FROM s GROUP BY stem""")
def b14(spark, sf_dir):
    u = T.conv_utterances(spark, sf_dir)
    norm = F.lower(F.regexp_replace("text", tx.PUNCT_RE, ""))
    t = u.select("filename", F.explode(tx.tokens(norm)).alias("w"))
    return t.select(tx.light_stem("w").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query("b15_not_only_stopwords", S.with_(S.UTT_CONV, S.STOP) + """
, t AS (SELECT filename, utt_idx, unnest(regexp_extract_all(lower(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g')),
        '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]')) AS w FROM utt)
, flag AS (SELECT u.filename, u.utt_idx, EXISTS (SELECT 1 FROM t WHERE t.filename = u.filename
           AND t.utt_idx = u.utt_idx AND t.w NOT IN (SELECT word FROM stop)) AS has_content FROM utt u)
SELECT filename, utt_idx, has_content FROM flag""")
def b15(spark, sf_dir):
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(lx.STOP_WORDS)])
    u = T.conv_utterances(spark, sf_dir)
    toks = tx.tokens(F.lower(F.regexp_replace("text", tx.PUNCT_RE, "")))
    return u.select("filename", "utt_idx",
                    F.exists(toks, lambda w: ~F.array_contains(stop, w)).alias("has_content"))


@query("b16_pos_tagging", CONV_TAGGED + "SELECT filename, utt_idx, tok_idx, token, pos, upos, lemma FROM tagged")
def b16(spark, sf_dir):
    return T.conv_tagged(spark, sf_dir).select("filename", "utt_idx", "tok_idx", "token", "pos", "upos", "lemma")


@query("b18_pos_frequency", CONV_TAGGED + """
SELECT filename, utt_idx, pos, count(*) AS n FROM tagged GROUP BY filename, utt_idx, pos""")
def b18(spark, sf_dir):
    pf = prep.pos_frequency(T.conv_tagged(spark, sf_dir))
    return pf.select("filename", "utt_idx", F.explode("pos_freq").alias("pos", "n"))


@query("b19_sentence_count", """
SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '')) AS n_sentences
FROM documents""")
def b19(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", tx.sentence_count("text").alias("n_sentences"))


@query("b20_utterance_count", "SELECT conv_id AS filename, count(*) AS n_utterances "
                              "FROM conversations WHERE role = 'user' GROUP BY conv_id")
def b20(spark, sf_dir):
    return T.conv_utterances(spark, sf_dir).groupBy("filename").agg(F.count("*").alias("n_utterances"))
