"""Registered queries for C (counts, frequencies), D (richness) and E (POS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import lexical as lex
from ..operators import prep
from ..operators import syntax as syn
from ..sources.tables import read
from . import sqlparts as S
from . import transcripts as T
from .registry import query

r6 = S.r6

# Rich tokens with a global position, in SQL.
RICH = f"""rich0 AS (SELECT filename, utt_idx, tok_idx, lower(token) AS term FROM tok
  WHERE NOT regexp_matches(token, '^[^\\p{{L}}\\p{{N}}]$')),
rich AS (SELECT filename, term, CAST(row_number() OVER (PARTITION BY filename ORDER BY utt_idx, tok_idx) - 1 AS BIGINT) AS pos
  FROM rich0)"""
CONV_RICH = S.with_(S.UTT_CONV, S.TOK, RICH)

# Frequency lexicon derived from the benchmark texts.
LEXICON = f"""lexw AS (SELECT lower(t) AS word FROM (SELECT unnest(regexp_extract_all(text, '{tx.TOKEN_RE}')) AS t
  FROM benchmark) WHERE regexp_matches(t, '{tx.WORD_RE}')),
lexicon AS (SELECT word, count(*) * 1e6 / (SELECT count(*) FROM lexw) AS subtlwf, log10(count(*) + 1) AS lg10wf
  FROM lexw GROUP BY word)"""


def _lexicon(spark, sf_dir):
    return lex.frequency_lexicon(spark, read(spark, sf_dir, "benchmark", "text"))


# --- C ---------------------------------------------------------------------

@query("c01_c02_token_counts", S.with_(S.UTT_CONV, S.TOK) + f"""
SELECT filename, count(*) AS n_tokens, count(DISTINCT token) AS n_unique_tokens,
  {r6('count(DISTINCT token) / count(*)')} AS ttr, {r6('avg(length(token))')} AS mean_token_length
FROM tok GROUP BY filename""")
def c01(spark, sf_dir):
    return lex.token_counts(T.conv_tokens(spark, sf_dir))


@query("c03_unique_lemmas", S.with_(S.UTT_CONV, S.TOK, S.TAGGED) + """
SELECT filename, count(DISTINCT lemma) AS n_unique_lemmas FROM tagged GROUP BY filename""")
def c03(spark, sf_dir):
    return lex.lemma_counts(T.conv_tagged(spark, sf_dir))


@query("c04_pos_shares", S.with_(S.UTT_CONV, S.TOK, S.TAGGED) + "SELECT filename, count(*) AS n_tokens, "
       + ", ".join(f"{r6(f'count_if(upos = {lx.sql_str(t)}) / count(*)')} AS share_{t}" for t in lx.UNIVERSAL_TAGS)
       + " FROM tagged GROUP BY filename")
def c04(spark, sf_dir):
    return lex.pos_shares(T.conv_tagged(spark, sf_dir))


ENTITIES = f"""g AS (SELECT filename, utt_idx, tok_idx, token, lower(token) AS g1,
    lower(token) || ' ' || lower(lead(token, 1) OVER w) AS g2,
    lower(token) || ' ' || lower(lead(token, 1) OVER w) || ' ' || lower(lead(token, 2) OVER w) AS g3
  FROM tok WINDOW w AS (PARTITION BY filename, utt_idx ORDER BY tok_idx)),
gaz AS (SELECT * FROM {lx.values_sql(lx.GAZETTEER, ['gram', 'label'])}),
cand AS (
  SELECT filename, utt_idx, tok_idx, gram AS entity, label, 3 AS n FROM g JOIN gaz ON g.g3 = gaz.gram
  UNION ALL SELECT filename, utt_idx, tok_idx, gram, label, 2 FROM g JOIN gaz ON g.g2 = gaz.gram
  UNION ALL SELECT filename, utt_idx, tok_idx, gram, label, 1 FROM g JOIN gaz ON g.g1 = gaz.gram
  UNION ALL SELECT filename, utt_idx, tok_idx, g1, 'CARDINAL', 1 FROM g WHERE regexp_matches(token, '^\\p{{N}}+$')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, utt_idx, tok_idx ORDER BY n DESC, label) AS r
  FROM cand) WHERE r = 1),
-- From left to right: the first match of an utterance, then the next one after its end.
nxt AS (SELECT a.*, b.tok_idx AS nxt FROM best a ASOF LEFT JOIN best b
  ON a.filename = b.filename AND a.utt_idx = b.utt_idx AND a.tok_idx + a.n <= b.tok_idx),
walk AS (SELECT nxt.* FROM nxt JOIN (SELECT filename, utt_idx, min(tok_idx) AS tok_idx FROM best GROUP BY ALL) USING (filename, utt_idx, tok_idx)
  UNION ALL SELECT m.* FROM walk w JOIN nxt m ON w.filename = m.filename AND w.utt_idx = m.utt_idx AND w.nxt = m.tok_idx),
ent AS (SELECT filename, utt_idx, tok_idx, entity, label, n FROM walk)"""


@query("b17_entity_mentions", S.with_recursive(S.UTT_DOCS, S.TOK, ENTITIES) + "SELECT * FROM ent")
def b17(spark, sf_dir):
    return prep.entity_mentions(spark, T.doc_tokens(spark, sf_dir))


@query("c05_c06_entity_features", S.with_recursive(S.UTT_DOCS, S.TOK, ENTITIES) + """
, agg AS (SELECT filename, count(*) AS n_entities, count(DISTINCT entity) AS n_unique_entities, """
       + ", ".join(f"{r6(f'count_if(label = {lx.sql_str(l)}) / count(*)')} AS ent_{l}" for l in lx.ENTITY_LABELS)
       + """ FROM ent GROUP BY filename)
SELECT f.filename, coalesce(n_entities, 0) AS n_entities, coalesce(n_unique_entities, 0) AS n_unique_entities, """
       + ", ".join(f"coalesce(ent_{l}, 0.0) AS ent_{l}" for l in lx.ENTITY_LABELS)
       + " FROM (SELECT DISTINCT filename FROM utt) f LEFT JOIN agg ON f.filename = agg.filename")
def c05(spark, sf_dir):
    utts = T.doc_utterances(spark, sf_dir)
    m = prep.entity_mentions(spark, prep.token_table(utts))
    return lex.entity_features(m, utts)


@query("c07_corpus_token_frequency", S.with_(S.UTT_DOCS, S.TOK) + """
SELECT token, count(*) AS count FROM tok GROUP BY token""")
def c07(spark, sf_dir):
    return lex.corpus_frequency(T.doc_tokens(spark, sf_dir), "token")


@query("c07_corpus_lemma_frequency", S.with_(S.UTT_DOCS, S.TOK, S.TAGGED) + """
SELECT lemma, count(*) AS count FROM tagged GROUP BY lemma""")
def c07_lemma(spark, sf_dir):
    return lex.corpus_frequency(T.doc_tagged(spark, sf_dir), "lemma")


@query("c07_corpus_pos_frequency", S.with_(S.UTT_DOCS, S.TOK, S.TAGGED) + """
SELECT pos, count(*) AS count FROM tagged GROUP BY pos""")
def c07_pos(spark, sf_dir):
    return lex.corpus_frequency(T.doc_tagged(spark, sf_dir), "pos")


@query("c07_corpus_entity_label_frequency", S.with_recursive(S.UTT_DOCS, S.TOK, ENTITIES) + """
SELECT label, count(*) AS count FROM ent GROUP BY label""")
def c07_ent(spark, sf_dir):
    return lex.corpus_frequency(prep.entity_mentions(spark, T.doc_tokens(spark, sf_dir)), "label")


@query("a15_frequency_lexicon", S.with_(LEXICON) + f"""
SELECT word, {r6('subtlwf')} AS subtlwf, {r6('lg10wf')} AS lg10wf FROM lexicon""")
def a15(spark, sf_dir):
    lx_ = _lexicon(spark, sf_dir)
    return lx_.select("word", tx.round6("subtlwf").alias("subtlwf"), tx.round6("lg10wf").alias("lg10wf"))


@query("c08_word_lexical_frequency", S.with_(S.UTT_CONV, S.TOK, LEXICON) + f"""
, w AS (SELECT DISTINCT lower(token) AS word FROM tok WHERE regexp_matches(token, '{tx.WORD_RE}'))
SELECT w.word, {r6('coalesce(l.subtlwf, -1.0)')} AS frequency FROM w LEFT JOIN lexicon l ON w.word = l.word""")
def c08(spark, sf_dir):
    return lex.word_lexical_frequency(prep.words(T.conv_tokens(spark, sf_dir)), _lexicon(spark, sf_dir))


@query("c09_subtl_score", S.with_(S.UTT_CONV, S.TOK, S.TAGGED, S.STOP, LEXICON) + """
, keep AS (SELECT filename, lw AS word FROM tagged WHERE pos NOT IN ('PRP', 'PRP$', 'WP$', 'EX')
           AND NOT starts_with(token, '''') AND lw NOT IN (SELECT word FROM stop))
, sc AS (SELECT k.filename, round(avg(l.subtlwf), 2) AS subtl_score FROM keep k JOIN lexicon l ON k.word = l.word
         GROUP BY k.filename)
SELECT f.filename, coalesce(sc.subtl_score, 0.0) AS subtl_score
FROM (SELECT DISTINCT filename FROM tagged) f LEFT JOIN sc ON f.filename = sc.filename""")
def c09(spark, sf_dir):
    return lex.subtl_score(spark, T.conv_tagged(spark, sf_dir), _lexicon(spark, sf_dir))


DOC_WORD_FREQ = f"""dw AS (SELECT d.doc_id, l.toxic AS cohort, lower(t) AS word FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{tx.TOKEN_RE}')) AS t FROM documents) d
  JOIN labels l ON d.doc_id = l.doc_id WHERE regexp_matches(t, '{tx.WORD_RE}')),
wf AS (SELECT dw.cohort, dw.word, x.subtlwf AS frequency FROM dw JOIN lexicon x ON dw.word = x.word)"""


def _doc_word_freq(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    lab = read(spark, sf_dir, "labels", "doc_id", "toxic")
    w = d.join(lab, "doc_id").select(F.col("toxic").alias("cohort"),
                                     F.explode(tx.tokens("text")).alias("t")).filter(tx.is_word("t"))
    w = w.select("cohort", F.lower("t").alias("word"))
    return w.join(_lexicon(spark, sf_dir).select("word", F.col("subtlwf").alias("frequency")), "word")


@query("c11_cohort_lexical_comparison", S.with_(LEXICON, DOC_WORD_FREQ) + f"""
, g AS (SELECT cohort, avg(frequency) AS m, var_samp(frequency) AS v, count(*) AS n,
        count(DISTINCT word) / count(*) AS ur FROM wf GROUP BY cohort)
SELECT a.cohort AS cohort_a, b.cohort AS cohort_b, {r6('a.m')} AS mean_a, {r6('b.m')} AS mean_b,
  {r6('a.ur')} AS unique_ratio_a, {r6('b.ur')} AS unique_ratio_b,
  {r6('(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)')} AS t,
  {r6('power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1))')} AS df
FROM g a JOIN g b ON a.cohort < b.cohort""")
def c11(spark, sf_dir):
    return lex.cohort_lexical_comparison(_doc_word_freq(spark, sf_dir))


@query("c12_cohort_summary", f"""
SELECT l.toxic, count(d.n_chars) AS n, {r6('avg(d.n_chars)')} AS mean, {r6('stddev_pop(d.n_chars)')} AS std
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic""")
def c12(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "n_chars")
    lab = read(spark, sf_dir, "labels", "doc_id", "toxic")
    return lex.cohort_summary(d.join(lab, "doc_id"), "toxic", "n_chars")


# --- D ---------------------------------------------------------------------

@query("d01_ttr_whitespace", S.with_(S.UTT_CONV) + f"""
, w AS (SELECT filename, unnest(string_split_regex(trim(text), '\\s+')) AS w FROM utt)
SELECT filename, count(*) AS n_words, {r6('count(DISTINCT w) / count(*)')} AS ttr FROM w WHERE w <> ''
GROUP BY filename""")
def d01(spark, sf_dir):
    return lex.whitespace_ttr(T.conv_utterances(spark, sf_dir))


@query("d02_msttr", CONV_RICH + f"""
, s AS (SELECT filename, floor(pos / 3) AS seg, count(*) AS k, count(DISTINCT term) AS v FROM rich GROUP BY ALL)
SELECT filename, {r6('avg(v / 3.0)')} AS msttr FROM s WHERE k = 3 GROUP BY filename""")
def d02(spark, sf_dir):
    return lex.msttr(lex.rich_tokens(T.conv_tokens(spark, sf_dir)), 3)


def _mattr_sql(w: int, pad: bool) -> str:
    short = f"CAST(count(DISTINCT term) AS DOUBLE) / {w}" if pad else "NULL"
    return CONV_RICH + f"""
, n AS (SELECT filename, count(*) AS N, count(DISTINCT term) AS V FROM rich GROUP BY filename)
, win AS (SELECT r.filename, r.pos AS i, count(DISTINCT q.term) AS d FROM rich r JOIN rich q
          ON q.filename = r.filename AND q.pos BETWEEN r.pos - {w - 1} AND r.pos WHERE r.pos >= {w - 1}
          GROUP BY r.filename, r.pos)
SELECT n.filename, {r6(f'CASE WHEN n.N >= {w} THEN (SELECT avg(d) FROM win WHERE win.filename = n.filename) / {w} ELSE ' + ('n.V / ' + str(w) + '.0' if pad else 'NULL') + ' END')} AS mattr_{w}
FROM n"""


@query("d03_mattr", _mattr_sql(3, False))
def d03(spark, sf_dir):
    return lex.mattr(lex.rich_tokens(T.conv_tokens(spark, sf_dir)), 3)


@query("d04_mattr20", _mattr_sql(20, True))
def d04(spark, sf_dir):
    return lex.mattr(lex.rich_tokens(T.conv_tokens(spark, sf_dir)), 20, pad_short=True)


@query("d05_d07_maas_hdd", CONV_RICH + f"""
, tc AS (SELECT filename, term, count(*) AS f FROM rich GROUP BY filename, term)
, n AS (SELECT filename, sum(f) AS N, count(*) AS V FROM tc GROUP BY filename)
, h AS (SELECT tc.filename, sum((1 - ((n.N - f) * (n.N - f - 1)) / (n.N * (n.N - 1))) / 2) AS hdd
        FROM tc JOIN n ON tc.filename = n.filename GROUP BY tc.filename)
SELECT n.filename, CAST(n.N AS BIGINT) AS n_tokens, n.V AS n_types,
  {r6('CASE WHEN n.N > 1 THEN (ln(n.N) - ln(n.V)) / power(ln(n.N), 2) END')} AS maas, {r6('h.hdd')} AS hdd
FROM n JOIN h ON n.filename = h.filename""")
def d05(spark, sf_dir):
    return lex.richness_scalar(lex.rich_terms(T.conv_tokens(spark, sf_dir)))


def _mtld_sql(reverse: bool) -> str:
    order = "pos" if not reverse else "rpos"
    return f"""r_{order}(filename, p, types, n, factors) AS (
  SELECT DISTINCT filename, -1, CAST([] AS VARCHAR[]), 0, 0.0 FROM seq
  UNION ALL
  SELECT filename, p, CASE WHEN len(nt) / nn <= 0.72 THEN CAST([] AS VARCHAR[]) ELSE nt END,
         CASE WHEN len(nt) / nn <= 0.72 THEN 0 ELSE nn END,
         factors + CASE WHEN len(nt) / nn <= 0.72 THEN 1.0 ELSE 0.0 END
  FROM (SELECT r.filename, s.{order} AS p, CASE WHEN list_contains(r.types, s.term) THEN r.types
          ELSE list_append(r.types, s.term) END AS nt, r.n + 1 AS nn, r.factors
        FROM r_{order} r JOIN seq s ON s.filename = r.filename AND s.{order} = r.p + 1))"""


@query("d06_mtld", "WITH RECURSIVE " + S.UTT_CONV + ",\n" + S.TOK + ",\n" + RICH + """,
seq AS (SELECT filename, term, pos, count(*) OVER (PARTITION BY filename) - 1 - pos AS rpos FROM rich),
""" + _mtld_sql(False) + ",\n" + _mtld_sql(True) + """,
lens AS (SELECT filename, count(*) AS N FROM seq GROUP BY filename),
fin AS (SELECT 'f' AS d, r.* FROM r_pos r JOIN lens l ON r.filename = l.filename AND r.p = l.N - 1
        UNION ALL SELECT 'r', r.* FROM r_rpos r JOIN lens l ON r.filename = l.filename AND r.p = l.N - 1),
val AS (SELECT f.filename, l.N / CASE WHEN tot = 0 THEN 1.0 ELSE tot END AS v FROM (
   SELECT filename, factors + CASE WHEN n > 0 THEN (1 - len(types) / n) / (1 - 0.72) ELSE 0.0 END AS tot
   FROM fin) f JOIN lens l ON f.filename = l.filename)
SELECT filename, """ + r6("avg(v)") + " AS mtld FROM val GROUP BY filename")
def d06(spark, sf_dir):
    return lex.mtld(lex.rich_tokens(T.conv_tokens(spark, sf_dir)))


# --- E + per-utterance D ---------------------------------------------------

def _utt_counts_sql():
    def tag_sum(tags):
        return f"sum(CASE WHEN pos IN {S.in_list(tags)} THEN f ELSE 0 END)"
    groups = ", ".join(f"{tag_sum(t)} AS c_{n}" for n, t in syn.TAG_GROUPS.items())
    return f"""f AS (SELECT filename, utt_idx, token, pos, count(*) AS f FROM tagged GROUP BY ALL),
uc AS (SELECT filename, utt_idx, sum(f) AS N, count(*) AS V, count_if(f = 1) AS V1, {groups},
  {tag_sum(syn.PRONOUNS)} AS c_pron, {tag_sum(['IN'])} AS c_in, {tag_sum(['CC'])} AS c_cc,
  sum(f * length(token)) AS len_sum, {tag_sum(['FW'])} AS c_fw,
  sum(CASE WHEN pos = 'FW' AND length(token) > 2 THEN f ELSE 0 END) AS c_nid,
  sum(CASE WHEN token IN ('um', 'uh') THEN f ELSE 0 END) AS c_umuh FROM f GROUP BY filename, utt_idx),
uf AS (SELECT filename, utt_idx, {', '.join(f'c_{n} / N AS {n}' for n in syn.TAG_GROUPS)},
  c_NumNouns / (c_NumVerbs + 1) AS RatioVerb, c_NumNouns / (c_NumNouns + c_NumVerbs + 1) AS RatioNoun,
  c_pron / (c_NumNouns + 1) AS RatioPronoun, c_cc / (c_in + 1) AS RatioCoordinate,
  power(N, V * -0.165) AS BrunetIndex, power(N, power(V, -0.165)) AS brunet_w,
  CASE WHEN V = 0 THEN 0.0 WHEN V1 = V THEN 100 * ln(N) / (2 - V1 / V) ELSE 100 * ln(N) / (1 - V1 / V) END AS HonoreStatistic,
  coalesce(len_sum / N, 0.0) AS MeanWordLength, CAST(c_nid AS DOUBLE) AS NumberOfNID,
  coalesce(c_umuh / N, 0.0) AS DisfluencyFrequency, CAST(N - c_fw - c_umuh AS DOUBLE) AS TotalNumberOfWords
  FROM uc)"""


@query("e01_e13_utterance_pos_features", S.with_(S.UTT_CONV, S.TOK, S.TAGGED, _utt_counts_sql()) +
       "SELECT filename, utt_idx, " + ", ".join(f"{r6(c)} AS {c}" for c in syn.ROLLUP_COLS) + " FROM uf")
def e01(spark, sf_dir):
    u = syn.utterance_features(T.conv_tagged(spark, sf_dir))
    return u.select("filename", "utt_idx", *[tx.round6(c).alias(c) for c in syn.ROLLUP_COLS])


@query("e14_interview_rollup", S.with_(S.UTT_CONV, S.TOK, S.TAGGED, _utt_counts_sql()) +
       "SELECT filename, " + ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in syn.ROLLUP_COLS)
       + " FROM uf GROUP BY filename")
def e14(spark, sf_dir):
    return syn.interview_rollup(T.conv_tagged(spark, sf_dir))


@query("e15_light_verb_share", S.with_(S.UTT_CONV, S.TOK, S.TAGGED) + f"""
SELECT filename, {r6(f"count_if(lower(token) IN {S.in_list(lx.LIGHT_VERBS)}) / nullif(count_if(pos IN {S.in_list(syn.VERBS)}), 0)")} AS light_verb_share
FROM tagged GROUP BY filename""")
def e15(spark, sf_dir):
    return syn.light_verb_share(T.conv_tagged(spark, sf_dir))


@query("d14_mean_sentence_length", S.with_(S.UTT_CONV, S.TOK) + f"""
, s AS (SELECT filename, sum(len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> ''))) AS n_sentences
        FROM utt GROUP BY filename)
, n AS (SELECT filename, count(*) AS n_tokens FROM tok GROUP BY filename)
SELECT s.filename, CAST(s.n_sentences AS BIGINT) AS n_sentences, coalesce(n.n_tokens, 0) AS n_tokens,
  {r6('coalesce(n.n_tokens, 0) / nullif(s.n_sentences, 0)')} AS mean_sentence_length
FROM s LEFT JOIN n ON s.filename = n.filename""")
def d14(spark, sf_dir):
    utts = T.conv_utterances(spark, sf_dir)
    return syn.mean_sentence_length(utts, prep.token_table(utts))
