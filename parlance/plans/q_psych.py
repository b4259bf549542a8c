"""Registered queries for G (psycholinguistic and information-unit features)."""

from __future__ import annotations

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import lexical as lex
from ..operators import prep
from ..operators import psych
from ..sources.tables import read
from . import sqlparts as S
from . import transcripts as T
from .q_features import RICH
from .registry import query

r6 = S.r6

WORDS = f"words AS (SELECT filename, utt_idx, tok_idx, lower(token) AS word FROM tok WHERE regexp_matches(token, '{tx.WORD_RE}'))"
NORMS = f"""bw AS (SELECT item_id, lower(t) AS word, t FROM (SELECT item_id, unnest(regexp_extract_all(text, '{tx.TOKEN_RE}')) AS t
  FROM benchmark) WHERE regexp_matches(t, '{tx.WORD_RE}')),
bg AS (SELECT word, ln(1 + count(*)) AS familiarity, CAST(length(word) AS DOUBLE) AS concreteness,
  CAST(count(DISTINCT item_id) AS DOUBLE) AS imagability, CAST(min(item_id) AS DOUBLE) AS aoa FROM bw GROUP BY word),
norms AS (UNPIVOT bg ON familiarity, concreteness, imagability, aoa INTO NAME measure VALUE score)"""


def _words(spark, sf_dir):
    return prep.words(T.conv_tokens(spark, sf_dir))


@query("a14_norm_lexicon", S.with_(NORMS) + f"SELECT measure, word, {r6('score')} AS score FROM norms")
def a14(spark, sf_dir):
    n = psych.norm_lexicon(read(spark, sf_dir, "benchmark", "item_id", "text"))
    return n.select("measure", "word", tx.round6("score").alias("score"))


@query("g01_psycholinguistic_scores", S.with_(S.UTT_CONV, S.TOK, S.STOP, WORDS, NORMS) + """
, cw AS (SELECT * FROM words WHERE word NOT IN (SELECT word FROM stop))
, j AS (SELECT cw.filename, n.measure, n.score FROM cw JOIN norms n ON cw.word = n.word)
, agg AS (SELECT filename, """ + ", ".join(
    f"sum(CASE WHEN measure = '{m}' THEN score END) AS s_{m}, count_if(measure = '{m}') AS n_{m}"
    for m in lx.PSYCH_MEASURES) + """ FROM j GROUP BY filename)
SELECT f.filename, """ + ", ".join(
    f"{r6(f'coalesce(s_{m}, 0.0) / (1 + coalesce(n_{m}, 0))')} AS {m}" for m in lx.PSYCH_MEASURES) + """
FROM (SELECT DISTINCT filename FROM cw) f LEFT JOIN agg ON f.filename = agg.filename""")
def g01(spark, sf_dir):
    cw = prep.non_stop_words(spark, T.conv_tokens(spark, sf_dir))
    return psych.psycholinguistic_scores(cw, psych.norm_lexicon(read(spark, sf_dir, "benchmark", "item_id", "text")))


KW = f"kw AS (SELECT * FROM {lx.values_sql([r for r in lx.keyword_rows() if r[1] in lx.INFO_UNITS], ['word', 'unit'])})"


@query("g02_g03_info_units", S.with_(S.UTT_CONV, S.TOK, WORDS, KW) + """
, agg AS (SELECT w.filename, """ + ", ".join(f"count_if(unit = '{u}') AS k_{u}" for u in lx.INFO_UNITS) + """
  FROM words w JOIN kw ON w.word = kw.word GROUP BY w.filename)
SELECT f.filename, """ + ", ".join(f"coalesce(k_{u}, 0) AS keyword{u}" for u in lx.INFO_UNITS) + ", "
       + ", ".join(f"CAST(coalesce(k_{u}, 0) > 0 AS INTEGER) AS binary{u}" for u in lx.INFO_UNITS) + """
FROM (SELECT DISTINCT filename FROM utt) f LEFT JOIN agg ON f.filename = agg.filename""")
def g02(spark, sf_dir):
    utts = T.conv_utterances(spark, sf_dir)
    return psych.info_units(spark, prep.words(prep.token_table(utts)), utts)


def _action_sql():
    sets = {**lx.INFO_UNITS, **lx.ACTION_WORDS}
    stem = ("CASE WHEN length(lw) > 4 AND lw LIKE '%ing' THEN substr(lw, 1, length(lw) - 3) "
            "WHEN length(lw) > 3 AND lw LIKE '%ed' THEN substr(lw, 1, length(lw) - 2) "
            "WHEN length(lw) > 3 AND lw LIKE '%s' AND NOT lw LIKE '%ss' THEN substr(lw, 1, length(lw) - 1) ELSE lw END")
    flags = []
    for name, subj_sets, verb_set in lx.ACTION_UNITS:
        subj = list(dict.fromkeys(psych._py_stem(w) for s in subj_sets for w in sets[s]))
        verb = list(dict.fromkeys(psych._py_stem(w) for w in sets[verb_set]))
        flags.append(f"max(CAST(pos IN {S.in_list(lx.NOUN_TAGS)} AND st IN {S.in_list(subj)} AS INTEGER)) * "
                     f"max(CAST(pos IN {S.in_list(lx.VERB_TAGS)} AND st IN {S.in_list(verb)} AS INTEGER)) AS {name}")
    names = [a[0] for a in lx.ACTION_UNITS]
    return (S.with_(S.UTT_CONV, S.TOK, S.TAGGED)
            + f", st AS (SELECT filename, utt_idx, pos, {stem} AS st FROM tagged)"
            + f", pu AS (SELECT filename, utt_idx, {', '.join(flags)} FROM st GROUP BY filename, utt_idx)"
            + " SELECT filename, " + ", ".join(f"CAST(sum({n}) AS BIGINT) AS keywordIUAction{n}" for n in names)
            + ", " + ", ".join(f"CAST(sum({n}) > 0 AS INTEGER) AS binaryIUAction{n}" for n in names)
            + " FROM pu GROUP BY filename")


@query("g04_g05_action_units", _action_sql())
def g04(spark, sf_dir):
    return psych.action_units(T.conv_tagged(spark, sf_dir))


ALLKW = [w for ws in {**lx.INFO_UNITS, **lx.ACTION_WORDS}.values() for w in ws]


@query("g06_g09_general_keywords", S.with_(S.UTT_CONV, S.TOK, WORDS) + f"""
, n AS (SELECT filename, count(*) AS n_words FROM words GROUP BY filename)
, k AS (SELECT filename, count(*) AS kw, count(DISTINCT word) AS kt FROM words
        WHERE word IN {S.in_list(list(dict.fromkeys(ALLKW)))} GROUP BY filename)
SELECT n.filename, coalesce(kw, 0) AS general_count,
  {r6('coalesce(coalesce(kw, 0) / n_words, 0.0)')} AS general_kw_to_w_ratio,
  {r6(f'coalesce(kt, 0) / {len(ALLKW)}.0')} AS prcnt_general_uttered,
  {r6('coalesce(kt / nullif(kw, 0), 0.0)')} AS general_ty_to_tok_ratio
FROM n LEFT JOIN k ON n.filename = k.filename""")
def g06(spark, sf_dir):
    return psych.general_keywords(spark, _words(spark, sf_dir))


def _spatial_sql(split):
    rows = [r for r in lx.region_rows() if r[0] == split]
    regions = list(lx.REGIONS[split])
    size = {r[1]: r[3] for r in rows}
    reg = f"reg AS (SELECT * FROM {lx.values_sql([(w, r) for _, r, w, _ in rows], ['word', 'region'])})"
    aggs = ", ".join(f"count_if(region = '{r}') AS c_{r}, count(DISTINCT CASE WHEN region = '{r}' THEN w.word END) AS d_{r}"
                     for r in regions)
    cols = []
    for r in regions:
        c, d = f"coalesce(c_{r}, 0)", f"coalesce(d_{r}, 0)"
        cols += [f"{c} AS {r}_count", f"{r6(f'coalesce({d} / nullif({c}, 0), 0.0)')} AS {r}_ty_to_tok_ratio",
                 f"{r6(f'CASE WHEN {c} > 0 THEN {c} / n_words ELSE 0.0 END')} AS {r}_kw_to_w_ratio",
                 f"{r6(f'{d} / {size[r]}.0')} AS prcnt_{r}_uttered"]
    return (S.with_(S.UTT_CONV, S.TOK, WORDS, reg)
            + ", n AS (SELECT filename, count(*) AS n_words FROM words GROUP BY filename)"
            + f", a AS (SELECT w.filename, {aggs} FROM words w JOIN reg ON w.word = reg.word GROUP BY w.filename)"
            + " SELECT n.filename, " + ", ".join(cols) + " FROM n LEFT JOIN a ON n.filename = a.filename")


for _split in lx.REGIONS:
    def _q(spark, sf_dir, split=_split):
        return psych.spatial_features(spark, _words(spark, sf_dir), split)
    query(f"g10_spatial_{_split}", _spatial_sql(_split))(_q)


SIDES = f"sides AS (SELECT * FROM {lx.values_sql(lx.side_rows(), ['word', 'side'])})"


@query("g11_side_switches", S.with_(S.UTT_CONV, S.TOK, RICH, SIDES) + f"""
, wp AS (SELECT filename, pos, term AS word FROM rich WHERE regexp_matches(term, '{tx.WORD_RE}'))
, s AS (SELECT wp.filename, pos, side, lag(side) OVER (PARTITION BY wp.filename ORDER BY pos) AS prev
        FROM wp JOIN sides ON wp.word = sides.word)
, sw AS (SELECT filename, count_if(prev IS NOT NULL AND prev <> side) AS ls_rs_switches FROM s GROUP BY filename)
SELECT f.filename, coalesce(sw.ls_rs_switches, 0) AS ls_rs_switches
FROM (SELECT DISTINCT filename FROM wp) f LEFT JOIN sw ON f.filename = sw.filename""")
def g11(spark, sf_dir):
    rich = lex.rich_tokens(T.conv_tokens(spark, sf_dir))
    wp = rich.filter(tx.is_word("term")).withColumnRenamed("term", "word")
    return psych.side_switches(spark, wp)


def _g12_sql():
    from .registry import ORACLE
    return (f"SELECT * FROM ({ORACLE['g02_g03_info_units']}) a LEFT JOIN ({ORACLE['g04_g05_action_units']}) b "
            "USING (filename)")


@query("g12_info_unit_rollup", _g12_sql())
def g12(spark, sf_dir):
    """All information-unit columns (G02–G05) in one row per transcript."""
    utts = T.conv_utterances(spark, sf_dir)
    toks = prep.token_table(utts)
    iu = psych.info_units(spark, prep.words(toks), utts)
    au = psych.action_units(prep.tag_tokens(spark, toks))
    return iu.join(au, "filename", "left")
