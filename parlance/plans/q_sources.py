"""Registered queries for A (sources) and the file-shaped B operators (CHAT
tiers, repeat markers, transcript assembly)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import prep
from ..sources import io
from ..sources.tables import read
from . import sqlparts as S
from . import transcripts as T
from .registry import query

r6 = S.r6


@query("a05_key_parse", r"""
WITH k AS (SELECT page_id, regexp_extract(url, '/(\d+)', 1) || '-' || regexp_extract(url, 'page=(\d+)', 1) AS key
  FROM pages WHERE regexp_matches(url, 'page=\d+'))
SELECT page_id, key, string_split(key, '-')[1] AS id, TRY_CAST(string_split(key, '-')[2] AS INTEGER) AS visit FROM k""")
def a05(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url").filter(F.col("url").rlike(r"page=\d+"))
    k = p.select("page_id", F.concat(F.regexp_extract("url", r"/(\d+)", 1), F.lit("-"),
                                     F.regexp_extract("url", r"page=(\d+)", 1)).alias("key"))
    id_, visit = io.parse_key(F.col("key"))
    return k.select("page_id", "key", id_, F.element_at(F.split("key", "-"), 2).try_cast("int").alias("visit"))


def _literal(col):
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        col, r"\\", r"\\\\"), "'", r"\\'"), "\n", r"\\n"), "\t", r"\\t")
    return F.concat(F.lit("'"), esc, F.lit("'"))


@query("a07_list_literal_parse", """
SELECT conv_id AS filename, count(*) AS n_items, sum(length(text)) AS n_chars FROM conversations
WHERE role = 'user' GROUP BY conv_id""")
def a07(spark, sf_dir):
    """Utterance lists written as Python list literals (as the reference
    stores them) and parsed back."""
    u = T.conv_utterances(spark, sf_dir)
    lit = u.groupBy("filename").agg(F.concat(F.lit("["), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("utt_idx", "text"))), lambda s: _literal(s["text"])), ", "),
        F.lit("]")).alias("literal"))
    parsed = lit.select("filename", F.from_json("literal", "array<string>", {
        "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true",
        "allowUnquotedControlChars": "true"}).alias("items"))
    return parsed.select("filename", F.size("items").cast("bigint").alias("n_items"),
                         F.aggregate("items", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t)).alias("n_chars"))


@query("a11_processed_ledger", "SELECT doc_id AS filename FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a11(spark, sf_dir):
    """Documents still to process given a ledger of processed ids (the
    labelled documents play the ledger)."""
    docs = read(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "filename")
    ledger = read(spark, sf_dir, "labels", "doc_id").withColumnRenamed("doc_id", "filename")
    return io.unprocessed(docs, ledger)


@query("a13_quarantine", S.with_(S.UTT_DOCS) + f"""
SELECT filename, utt_idx, text FROM utt
WHERE len(list_filter(regexp_extract_all(text, '{tx.TOKEN_RE}'), lambda t: regexp_matches(t, '{tx.WORD_RE}'))) = 0""")
def a13(spark, sf_dir):
    """Lines without a single word go to quarantine (file, line, text kept)."""
    u = T.doc_utterances(spark, sf_dir)
    ok = F.size(F.filter(tx.tokens("text"), lambda t: t.rlike(tx.WORD_RE))) > 0
    _, bad = io.quarantine_split(u, ok)
    return bad.select("filename", "utt_idx", "text")


# --- B01: CHAT tiers -------------------------------------------------------

def chat_files(spark, sf_dir):
    """CHAT-format files built from the turn table: ``*PAR:`` / ``*INV:``
    speaker lines, tab-indented continuation lines and a ``%mor`` tier."""
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    ls = F.split("text", "\n")
    spk = F.when(F.col("role") == "user", "PAR").otherwise("INV")
    rest = F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0)))
    turn = F.concat(F.lit("*"), spk, F.lit(":\t"), F.element_at(ls, 1),
                    F.when(F.size(ls) > 1, F.concat(F.lit("\n"), F.array_join(
                        F.transform(rest, lambda x: F.concat(F.lit("\t"), x)), "\n"))).otherwise(F.lit("")),
                    F.lit("\n%mor:\t"), F.lower(F.element_at(ls, 1)))
    t = c.select(F.col("conv_id").alias("filename"), "turn", turn.alias("t"))
    f = t.groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))),
                                                           lambda s: s["t"]), "\n").alias("body"))
    return f.select("filename", F.concat(F.lit("@Begin\n"), F.col("body"), F.lit("\n@End")).alias("text"))


CHAT_SQL = r"""turns AS (SELECT conv_id AS filename, turn, CASE WHEN role = 'user' THEN 'PAR' ELSE 'INV' END AS spk,
    string_split(text, chr(10)) AS ls FROM conversations),
tt AS (SELECT filename, turn, '*' || spk || ':' || chr(9) || ls[1] ||
    CASE WHEN len(ls) > 1 THEN chr(10) || array_to_string(list_transform(ls[2:], lambda x: chr(9) || x), chr(10)) ELSE '' END
    || chr(10) || '%mor:' || chr(9) || lower(ls[1]) AS t FROM turns),
files AS (SELECT filename, '@Begin' || chr(10) || string_agg(t, chr(10) ORDER BY turn) || chr(10) || '@End' AS text
    FROM tt GROUP BY filename),
lines AS (SELECT filename, unnest(range(len(string_split(text, chr(10))))) AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM files),
l1 AS (SELECT * FROM (SELECT *, max(CASE WHEN starts_with(line, '@End') THEN 1 ELSE 0 END) OVER (PARTITION BY filename
    ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ended FROM lines) WHERE ended = 0),
l2 AS (SELECT *, CASE WHEN regexp_matches(line, '^\*[A-Za-z]+:') OR starts_with(line, '@End') THEN 1 ELSE 0 END AS st,
    CASE WHEN regexp_matches(line, '^\*[A-Za-z]+:') THEN 'text' WHEN starts_with(line, '%mor:') THEN 'mor'
      WHEN starts_with(line, '%gra:') THEN 'gra' WHEN starts_with(line, '@End') THEN 'end'
      WHEN starts_with(line, '@') OR starts_with(line, '%') THEN 'other' END AS kind0 FROM l1),
l3 AS (SELECT *, sum(st) OVER w AS grp, last_value(kind0 IGNORE NULLS) OVER w AS kind,
    regexp_replace(regexp_replace(line, '^[*%][A-Za-z]+:', ''), '^\s+|\s+$', '', 'g') AS body,
    regexp_extract(line, '^\*([A-Za-z]+):', 1) AS spk
    FROM l2 WINDOW w AS (PARTITION BY filename ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


@query("b01_chat_tiers", "WITH " + CHAT_SQL + """
SELECT filename, CAST(grp AS BIGINT) AS utt_idx, max(CASE WHEN spk <> '' THEN spk END) AS speaker,
  coalesce(string_agg(CASE WHEN kind = 'text' THEN body END, ' ' ORDER BY line_no), '') AS text,
  coalesce(string_agg(CASE WHEN kind = 'mor' THEN body END, ' ' ORDER BY line_no), '') AS mor,
  coalesce(string_agg(CASE WHEN kind = 'gra' THEN body END, ' ' ORDER BY line_no), '') AS gra
FROM l3 WHERE grp > 0 GROUP BY filename, grp HAVING max(CASE WHEN spk <> '' THEN spk END) IS NOT NULL""")
def b01(spark, sf_dir):
    return prep.chat_tiers(prep.chat_lines(chat_files(spark, sf_dir))).select(
        "filename", F.col("utt_idx").cast("bigint"), "speaker", "text", "mor", "gra")


@query("b04_repeat_markers", S.with_(S.UTT_CONV) + r"""
, t AS (SELECT filename, utt_idx, regexp_extract_all(text, '\[x ?\d+\]|\S+') AS t FROM utt)
SELECT filename, utt_idx, array_to_string(flatten(list_transform(t, lambda x, i:
  CASE WHEN regexp_matches(x, '^\[x ?\d+\]$') THEN CAST([] AS VARCHAR[])
       WHEN i < len(t) AND regexp_matches(t[i + 1], '^\[x ?\d+\]$')
         THEN list_transform(range(CAST(regexp_extract(t[i + 1], '^\[x ?(\d+)\]$', 1) AS INTEGER)), lambda k: x)
       ELSE [x] END)), ' ') AS resolved FROM t""")
def b04(spark, sf_dir):
    u = T.conv_utterances(spark, sf_dir)
    return u.select("filename", "utt_idx", prep.resolve_repeats("text").alias("resolved"))


@query("b07_transcript_assembly", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/\d+', 1) AS lang,
    TRY_CAST(regexp_extract(url, '/[a-z]{2}/(\d+)', 1) AS BIGINT) AS id FROM pages
    WHERE contains(url, 'example') AND contains(url, 'page=')),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_id) AS r FROM p WHERE id IS NOT NULL) WHERE r = 1),
c AS (SELECT * FROM (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY doc_id ORDER BY source) AS r FROM documents)
    WHERE r = 1)
SELECT f.id, f.page_id, CAST(f.lang <> 'en' AS INTEGER) AS label, c.source FROM f LEFT JOIN c ON f.id = c.id""")
def b07(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    cohort = read(spark, sf_dir, "documents", "doc_id", "source").withColumnRenamed("doc_id", "id")
    return prep.assemble_transcripts(pages, cohort)
