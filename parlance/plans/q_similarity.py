"""Registered queries for H (pairwise utterance similarity).

The oracle computes every pair's TF-IDF vectors directly (all pairs of a
transcript, full outer term alignment) — a brute-force check of the
closed-form posting-list join used on the Spark side.
"""

from __future__ import annotations

import math

from ..functions import text as tx
from ..operators import similarity as sim
from . import sqlparts as S
from . import transcripts as T
from .registry import query

r6 = S.r6
C = 1.0 + math.log(1.5)

TERMS = f"""tw AS (SELECT filename, utt_idx, unnest(regexp_extract_all(lower(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g')),
  '{tx.TOKEN_RE}')) AS w FROM utt),
ts AS (SELECT filename, utt_idx, CASE WHEN length(w) > 4 AND w LIKE '%ing' THEN substr(w, 1, length(w) - 3)
  WHEN length(w) > 3 AND w LIKE '%ed' THEN substr(w, 1, length(w) - 2)
  WHEN length(w) > 3 AND w LIKE '%s' AND NOT w LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END AS term FROM tw),
tf AS (SELECT filename, utt_idx, term, count(*) AS tf FROM ts WHERE term NOT IN (SELECT word FROM stop)
  GROUP BY filename, utt_idx, term),
pairs AS (SELECT a.filename, a.utt_idx AS utt_a, b.utt_idx AS utt_b FROM utt a JOIN utt b
  ON a.filename = b.filename AND a.utt_idx < b.utt_idx),
pt AS (SELECT p.filename, p.utt_a, p.utt_b, x.term, x.tf AS tfa, coalesce(y.tf, 0) AS tfb, y.tf IS NOT NULL AS both_sides
  FROM pairs p JOIN tf x ON x.filename = p.filename AND x.utt_idx = p.utt_a
  LEFT JOIN tf y ON y.filename = p.filename AND y.utt_idx = p.utt_b AND y.term = x.term
  UNION ALL
  SELECT p.filename, p.utt_a, p.utt_b, y.term, 0, y.tf, FALSE
  FROM pairs p JOIN tf y ON y.filename = p.filename AND y.utt_idx = p.utt_b
  WHERE NOT EXISTS (SELECT 1 FROM tf x WHERE x.filename = p.filename AND x.utt_idx = p.utt_a AND x.term = y.term)),
vec AS (SELECT filename, utt_a, utt_b, tfa * CASE WHEN both_sides THEN 1.0 ELSE {C!r} END AS wa,
         tfb * CASE WHEN both_sides THEN 1.0 ELSE {C!r} END AS wb FROM pt),
cos AS (SELECT filename, utt_a, utt_b, CASE WHEN sum(wa * wa) = 0 OR sum(wb * wb) = 0 THEN 0.0
    ELSE sum(wa * wb) / (sqrt(sum(wa * wa)) * sqrt(sum(wb * wb))) END AS cosine
  FROM vec WHERE filename IS NOT NULL GROUP BY filename, utt_a, utt_b)"""


def _features_sql(utt_cte):
    return S.with_(utt_cte, S.STOP, TERMS) + f"""
, n AS (SELECT filename, count(*) AS n FROM utt GROUP BY filename)
, allp AS (SELECT p.filename, coalesce(c.cosine, 0.0) AS s FROM pairs p LEFT JOIN cos c
  ON c.filename = p.filename AND c.utt_a = p.utt_a AND c.utt_b = p.utt_b)
, agg AS (SELECT filename, sum(s) AS ss, min(s) AS mn, count_if(s <= 0.0) AS l0, count_if(s <= 0.3) AS l3,
  count_if(s <= 0.5) AS l5 FROM allp GROUP BY filename)
SELECT n.filename, CAST(n.n * (n.n - 1) / 2 AS BIGINT) AS n_pairs,
  {r6('agg.ss / nullif(n.n * (n.n - 1) / 2, 0)')} AS avg_cos_dist, {r6('agg.mn')} AS min_cos_dist,
  {r6('agg.l0 / nullif(n.n * (n.n - 1) / 2, 0)')} AS proportion_below_threshold_0,
  {r6('agg.l3 / nullif(n.n * (n.n - 1) / 2, 0)')} AS proportion_below_threshold_0_3,
  {r6('agg.l5 / nullif(n.n * (n.n - 1) / 2, 0)')} AS proportion_below_threshold_0_5
FROM n LEFT JOIN agg ON n.filename = agg.filename"""


@query("h01_pair_cosine", S.with_(S.UTT_CONV, S.STOP, TERMS) + f"""
SELECT filename, utt_a, utt_b, {r6('cosine')} AS cosine FROM cos WHERE cosine > 0""")
def h01(spark, sf_dir):
    utts = T.conv_utterances(spark, sf_dir)
    p = sim.pair_cosine(sim.utterance_terms(spark, utts))
    return p.select("filename", "utt_a", "utt_b", S_round("cosine"))


def S_round(c):
    return tx.round6(c).alias(c)


@query("h02_h05_distance_features", _features_sql(S.UTT_CONV))
def h02(spark, sf_dir):
    return sim.utterance_distances(spark, T.conv_utterances(spark, sf_dir))


@query("h02_h05_distance_features_documents", _features_sql(S.UTT_DOCS))
def h02_docs(spark, sf_dir):
    """The same roll-up with every line of a document as an utterance (long
    transcripts with repeated and near-copied lines)."""
    return sim.utterance_distances(spark, T.doc_utterances(spark, sf_dir).select("filename", "utt_idx", "text"))
