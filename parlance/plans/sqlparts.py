"""SQL building blocks for the DuckDB oracle (independent re-statement of the
operators' rules in plain SQL over the driver's views)."""

from __future__ import annotations

from ..functions import lexicons as lx
from ..functions import text as tx

TOKEN_RE = tx.TOKEN_RE
WORD_RE = tx.WORD_RE

# User turns of every conversation = participant utterances.
UTT_CONV = ("utt AS (SELECT conv_id AS filename, turn AS utt_idx, role, text "
            "FROM conversations WHERE role = 'user')")
# Every non-blank line of every document = one utterance.
UTT_DOCS = ("utt AS (SELECT filename, utt_idx, text FROM ("
            "SELECT doc_id AS filename, unnest(range(len(string_split(text, chr(10))))) AS utt_idx, "
            "unnest(string_split(text, chr(10))) AS text FROM documents) WHERE trim(text) <> '')")

TOK = (f"tok AS (SELECT filename, utt_idx, unnest(t) AS token, unnest(range(len(t))) AS tok_idx "
       f"FROM (SELECT filename, utt_idx, regexp_extract_all(text, '{TOKEN_RE}') AS t FROM utt))")


def fallback_tag_sql(t: str = "token") -> str:
    lw = f"lower({t})"
    return f"""CASE
 WHEN regexp_matches({t}, '^\\p{{N}}+$') THEN 'CD'
 WHEN regexp_matches({t}, '^[.!?]$') THEN '.'
 WHEN {t} = ',' THEN ','
 WHEN regexp_matches({t}, '^[:;]$') THEN ':'
 WHEN NOT regexp_matches({t}, '{WORD_RE}') THEN 'SYM'
 WHEN regexp_matches({t}, '[^\\x00-\\x7F]') THEN 'FW'
 WHEN length({lw}) > 4 AND {lw} LIKE '%ing' THEN 'VBG'
 WHEN length({lw}) > 3 AND {lw} LIKE '%ed' THEN 'VBD'
 WHEN length({lw}) > 3 AND {lw} LIKE '%ly' THEN 'RB'
 WHEN length({lw}) > 4 AND ({lw} LIKE '%ous' OR {lw} LIKE '%ful' OR {lw} LIKE '%ive' OR {lw} LIKE '%able') THEN 'JJ'
 WHEN length({lw}) > 3 AND {lw} LIKE '%s' AND NOT {lw} LIKE '%ss' THEN 'NNS'
 ELSE 'NN' END"""


def in_list(values) -> str:
    return "(" + ", ".join(lx.sql_str(v) for v in values) + ")"


TAGGED = f"""tagged0 AS (
  SELECT k.*, lower(k.token) AS lw, coalesce(c.tag, {fallback_tag_sql('k.token')}) AS pos, l.lemma AS lex_lemma
  FROM tok k
  LEFT JOIN {lx.values_sql(lx.CLOSED_CLASS_TAGS, ['w', 'tag']).replace('AS t(', 'AS c(')} ON c.w = lower(k.token)
  LEFT JOIN {lx.values_sql(lx.IRREGULAR_LEMMAS, ['w', 'lemma']).replace('AS t(', 'AS l(')} ON l.w = lower(k.token)
), tagged1 AS (
  SELECT *, coalesce(lex_lemma, CASE
     WHEN pos = 'NNS' AND lw LIKE '%s' THEN substr(lw, 1, length(lw) - 1)
     WHEN pos = 'VBG' AND lw LIKE '%ing' THEN substr(lw, 1, length(lw) - 3)
     WHEN pos = 'VBD' AND lw LIKE '%ed' THEN substr(lw, 1, length(lw) - 2)
     ELSE lw END) AS lemma
  FROM tagged0
), tagged AS (
  SELECT g.* EXCLUDE (lex_lemma), CASE
     WHEN g.pos = 'IN' AND g.lw IN {in_list(lx.SUBORDINATORS)} THEN 'SCONJ'
     WHEN g.pos IN {in_list(lx.VERB_TAGS)} AND g.lemma IN {in_list(lx.AUX_LEMMAS)} THEN 'AUX'
     ELSE coalesce(u.upos, 'X') END AS upos
  FROM tagged1 g
  LEFT JOIN {lx.values_sql(lx.PENN_TO_UNIVERSAL, ['p', 'upos']).replace('AS t(', 'AS u(')} ON u.p = g.pos
)"""

STOP = f"stop AS (SELECT * FROM {lx.values_sql([(w,) for w in dict.fromkeys(lx.STOP_WORDS)], ['word'])})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def with_recursive(*ctes: str) -> str:
    return with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"
