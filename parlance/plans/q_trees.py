"""Registered queries for F (trees): built from the participant turns'
tagged tokens, parsed back into nodes, and summarised."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.frames import cut_lineage
from ..operators import trees as tr
from . import sqlparts as S
from . import transcripts as T
from .registry import query

r6 = S.r6
KEYS = ["filename", "utt_idx", "tree_idx"]


def _cls_sql():
    return "CASE " + " ".join(f"WHEN pos IN {S.in_list(tags)} THEN '{c}'" for c, tags in tr.PHRASE_OF_TAG.items()) + " END"


def _esc(x):
    return f"replace(replace({x}, '(', '-LRB-'), ')', '-RRB-')"


TREES = f"""tt0 AS (SELECT *, tok_idx // {tr.TREE_WORDS} AS tree_idx FROM tagged),
tt AS (SELECT filename, utt_idx, tree_idx, tok_idx, {_cls_sql()} AS cls, '(' || {_esc('pos')} || ' ' || {_esc('token')} || ')' AS leaf,
    lag({_cls_sql()}) OVER (PARTITION BY filename, utt_idx, tree_idx ORDER BY tok_idx) AS lag_cls FROM tt0),
tc AS (SELECT *, sum(CASE WHEN cls IS NULL OR lag_cls IS NULL OR lag_cls <> cls THEN 1 ELSE 0 END)
    OVER (PARTITION BY filename, utt_idx, tree_idx ORDER BY tok_idx ROWS UNBOUNDED PRECEDING) AS chunk FROM tt),
ch AS (SELECT filename, utt_idx, tree_idx, chunk, max(cls) AS cls, string_agg(leaf, ' ' ORDER BY tok_idx) AS leaves
    FROM tc GROUP BY filename, utt_idx, tree_idx, chunk),
ch2 AS (SELECT *, lead(cls) OVER w AS next_cls, lag(cls) OVER w AS prev_cls,
    lead('(NP ' || leaves || ')') OVER w AS next_str FROM ch WINDOW w AS (PARTITION BY filename, utt_idx, tree_idx ORDER BY chunk)),
ch3 AS (SELECT filename, utt_idx, tree_idx, chunk, CASE WHEN cls IS NULL THEN leaves
    WHEN cls = 'PP' AND next_cls = 'NP' THEN '(PP ' || leaves || ' ' || next_str || ')'
    ELSE '(' || cls || ' ' || leaves || ')' END AS s FROM ch2
    WHERE NOT coalesce(cls = 'NP' AND prev_cls = 'PP', FALSE)),
trees AS (SELECT filename, utt_idx, tree_idx, '(ROOT (S ' || string_agg(s, ' ' ORDER BY chunk) || '))' AS tree
    FROM ch3 GROUP BY filename, utt_idx, tree_idx)"""

NODES = f"""bt AS (SELECT filename, utt_idx, tree_idx, unnest(b) AS tok, unnest(range(len(b))) AS p FROM (
    SELECT filename, utt_idx, tree_idx, regexp_extract_all(tree, '{tr.BRACKET_RE}') AS b FROM trees)),
bd AS (SELECT *, tok = ')' AS is_close, coalesce(sum(CASE WHEN tok = ')' THEN -1 ELSE 1 END) OVER (
    PARTITION BY filename, utt_idx, tree_idx ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM bt),
op AS (SELECT filename, utt_idx, tree_idx, p, CAST(depth AS INTEGER) AS depth, regexp_extract(tok, '^\\(([^\\s()]+)', 1) AS label,
    nullif(regexp_extract(tok, '^\\([^\\s()]+ ([^\\s()]+)$', 1), '') AS word,
    CAST(row_number() OVER (PARTITION BY filename, utt_idx, tree_idx ORDER BY p) - 1 AS INTEGER) AS node_id FROM bd WHERE NOT is_close),
cl AS (SELECT filename, utt_idx, tree_idx, p, depth FROM bd WHERE is_close),
nodes AS (SELECT o.*, (SELECT min(c.p) FROM cl c WHERE c.filename = o.filename AND c.utt_idx = o.utt_idx
      AND c.tree_idx = o.tree_idx AND c.p > o.p AND c.depth = o.depth + 1) AS endp,
    CAST(coalesce((SELECT arg_max(a.node_id, a.p) FROM op a WHERE a.filename = o.filename AND a.utt_idx = o.utt_idx
      AND a.tree_idx = o.tree_idx AND a.depth = o.depth - 1 AND a.p < o.p), -1) AS INTEGER) AS parent_id FROM op o)"""

DEPS = f"""deps AS (SELECT filename, utt_idx, tok_idx // {tr.TREE_WORDS} AS tree_idx, tok_idx, token, CASE
    WHEN lemma = 'be' AND nxt IN ('JJ', 'JJR', 'JJS', 'NN', 'NNS', 'NNP', 'NNPS') THEN 'cop'
    WHEN lemma = 'be' AND nxt = 'VBN' THEN 'auxpass'
    WHEN upos = 'AUX' AND nxt IN {S.in_list(lx.VERB_TAGS)} THEN 'aux'
    WHEN pos = 'VB' AND prv = 'to' THEN 'xcomp' END AS dep
  FROM (SELECT *, lead(pos) OVER w AS nxt, lag(lw) OVER w AS prv FROM tagged
        WINDOW w AS (PARTITION BY filename, utt_idx ORDER BY tok_idx)))"""

BASE = S.with_(S.UTT_CONV, S.TOK, S.TAGGED, TREES)
BASE_NODES = S.with_(S.UTT_CONV, S.TOK, S.TAGGED, TREES, NODES)


def _trees(spark, sf_dir):
    return tr.build_trees(T.conv_tagged(spark, sf_dir))


def _nodes(spark, sf_dir):
    return tr.tree_nodes(_trees(spark, sf_dir))


def _hub_nodes(tagged):
    """Node table read by several branches of one plan: checkpointed once."""
    return cut_lineage(tr.tree_nodes(tr.build_trees(tagged)))


@query("f00_build_trees", BASE + "SELECT filename, utt_idx, tree_idx, tree FROM trees")
def f00(spark, sf_dir):
    return _trees(spark, sf_dir)


@query("f01_tree_nodes", BASE_NODES + "SELECT filename, utt_idx, tree_idx, node_id, parent_id, depth, label, word FROM nodes")
def f01(spark, sf_dir):
    return _nodes(spark, sf_dir).select(*KEYS, "node_id", "parent_id", "depth", "label", "word")


SIZE_SQL = ("sz AS (SELECT filename, utt_idx, tree_idx, count(*) AS n_nodes, max(depth) + 1 AS height FROM nodes "
            "GROUP BY filename, utt_idx, tree_idx)")


@query("f02_f03_tree_size", BASE_NODES + ", " + SIZE_SQL + " SELECT * FROM sz")
def f02(spark, sf_dir):
    return tr.tree_size(_nodes(spark, sf_dir))


def _rules_sql():
    single = [(n, p, c[0]) for n, p, c in lx.TREE_RULES if len(c) == 1]
    multi = [(n, p, c) for n, p, c in lx.TREE_RULES if len(c) > 1]
    e = ", ".join(f"count_if(pa.label = '{p}' AND ch.label = '{c}') AS {n}" for n, p, c in single)
    m = ", ".join(f"count_if(label = '{p}' AND " + " AND ".join(f"list_contains(kids, '{c}')" for c in cs) + f") AS {n}"
                  for n, p, cs in multi)
    names = [r[0] for r in lx.TREE_RULES]
    return f"""eg AS (SELECT ch.filename, ch.utt_idx, ch.tree_idx, {e} FROM nodes ch JOIN nodes pa ON ch.filename = pa.filename
    AND ch.utt_idx = pa.utt_idx AND ch.tree_idx = pa.tree_idx AND ch.parent_id = pa.node_id GROUP BY ch.filename, ch.utt_idx, ch.tree_idx),
pk AS (SELECT pa.filename, pa.utt_idx, pa.tree_idx, pa.node_id, pa.label, list(DISTINCT ch.label) AS kids FROM nodes pa JOIN nodes ch
    ON ch.filename = pa.filename AND ch.utt_idx = pa.utt_idx AND ch.tree_idx = pa.tree_idx AND ch.parent_id = pa.node_id
    GROUP BY pa.filename, pa.utt_idx, pa.tree_idx, pa.node_id, pa.label),
ms AS (SELECT filename, utt_idx, tree_idx, {m} FROM pk GROUP BY filename, utt_idx, tree_idx),
rules AS (SELECT b.filename, b.utt_idx, b.tree_idx, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)}
  FROM (SELECT DISTINCT filename, utt_idx, tree_idx FROM nodes) b LEFT JOIN eg ON b.filename = eg.filename
  AND b.utt_idx = eg.utt_idx AND b.tree_idx = eg.tree_idx
  LEFT JOIN ms ON b.filename = ms.filename AND b.utt_idx = ms.utt_idx AND b.tree_idx = ms.tree_idx)"""


@query("f04_f06_named_rules", BASE_NODES + ", " + _rules_sql() + " SELECT * FROM rules")
def f04(spark, sf_dir):
    return tr.named_rules(_hub_nodes(T.conv_tagged(spark, sf_dir)))


AUX_SQL = f"""auxw AS (SELECT DISTINCT filename, utt_idx, tree_idx, token AS word FROM deps WHERE dep IN {S.in_list(lx.AUX_DEPENDENCIES)}),
na AS (SELECT filename, utt_idx, tree_idx, count_if(dep IN {S.in_list(lx.AUX_DEPENDENCIES)}) AS VP_to_AUX FROM deps
  GROUP BY filename, utt_idx, tree_idx),
pv AS (SELECT v.filename, v.utt_idx, v.tree_idx, v.node_id, max(CASE WHEN aw.word IS NOT NULL THEN 1 ELSE 0 END) AS has_aux,
    max(CASE WHEN c.label = 'VP' THEN 1 ELSE 0 END) AS has_vp, max(CASE WHEN c.label = 'ADJP' THEN 1 ELSE 0 END) AS has_adjp
  FROM nodes v JOIN nodes c ON c.filename = v.filename AND c.utt_idx = v.utt_idx AND c.tree_idx = v.tree_idx
    AND c.parent_id = v.node_id
  LEFT JOIN auxw aw ON aw.filename = c.filename AND aw.utt_idx = c.utt_idx AND aw.tree_idx = c.tree_idx AND aw.word = c.word
  WHERE v.label = 'VP' GROUP BY v.filename, v.utt_idx, v.tree_idx, v.node_id),
f08 AS (SELECT filename, utt_idx, tree_idx, sum(has_aux * has_vp) AS VP_to_AUX_VP, sum(has_aux * has_adjp) AS VP_to_AUX_ADJP
  FROM pv GROUP BY filename, utt_idx, tree_idx),
aux AS (SELECT b.filename, b.utt_idx, b.tree_idx, coalesce(na.VP_to_AUX, 0) AS VP_to_AUX,
  CAST(coalesce(f08.VP_to_AUX_VP, 0) AS BIGINT) AS VP_to_AUX_VP, CAST(coalesce(f08.VP_to_AUX_ADJP, 0) AS BIGINT) AS VP_to_AUX_ADJP
  FROM (SELECT DISTINCT filename, utt_idx, tree_idx FROM nodes) b
  LEFT JOIN na ON b.filename = na.filename AND b.utt_idx = na.utt_idx AND b.tree_idx = na.tree_idx
  LEFT JOIN f08 ON b.filename = f08.filename AND b.utt_idx = f08.utt_idx AND b.tree_idx = f08.tree_idx)"""


def _aux(spark, sf_dir):
    tagged = T.conv_tagged(spark, sf_dir)
    nodes = _hub_nodes(tagged)
    return nodes, tr.vp_aux(nodes, tr.aux_dependencies(tagged))


@query("f07_f08_auxiliary_rules", BASE_NODES + ", " + DEPS + ", " + AUX_SQL + " SELECT * FROM aux")
def f07(spark, sf_dir):
    return _aux(spark, sf_dir)[1]


ROLL_COLS = ["height"] + [r[0] for r in lx.TREE_RULES] + ["VP_to_AUX", "VP_to_AUX_VP", "VP_to_AUX_ADJP"]


@query("f09_tree_rollup", BASE_NODES + ", " + DEPS + ", " + AUX_SQL + ", " + SIZE_SQL + ", " + _rules_sql() + """
, pt AS (SELECT * FROM sz JOIN rules USING (filename, utt_idx, tree_idx) JOIN aux USING (filename, utt_idx, tree_idx))
SELECT filename, """ + ", ".join(f"{r6(f'sum({c}) / nullif(sum(n_nodes), 0)')} AS {c if c != 'height' else 'tree_height'}"
                                for c in ROLL_COLS) + " FROM pt GROUP BY filename")
def f09(spark, sf_dir):
    tagged = cut_lineage(T.conv_tagged(spark, sf_dir))
    nodes = _hub_nodes(tagged)
    return tr.tree_rollup(nodes, tr.named_rules(nodes), tr.vp_aux(nodes, tr.aux_dependencies(tagged)))


@query("f10_constituent_shares", BASE_NODES + " SELECT filename, " + ", ".join(
    f"{r6(f'count_if(label = {lx.sql_str(l)}) / count(*)')} AS {l}" for l in lx.CFG_LABELS) + " FROM nodes GROUP BY filename")
def f10(spark, sf_dir):
    return tr.constituent_shares(_nodes(spark, sf_dir))


def _phrase_sql():
    anc = ", ".join(f"(SELECT count(*) FROM nodes a WHERE a.filename = q.filename AND a.utt_idx = q.utt_idx "
                    f"AND a.tree_idx = q.tree_idx "
                    f"AND a.label = '{t}' AND a.p < q.p AND a.endp > q.p) AS anc_{t}" for t in tr.PHRASE_TYPES)
    aggs = ["count_if(word IS NOT NULL) AS words"]
    for t in tr.PHRASE_TYPES:
        aggs += [f"sum(CASE WHEN word IS NOT NULL THEN anc_{t} ELSE 0 END) AS len_{t}",
                 f"count_if(label = '{t}') AS emb_{t}", f"count_if(label = '{t}' AND anc_{t} = 0) AS out_{t}"]
    cols = []
    for t, pre in (("NP", "NP"), ("VP", "VP"), ("PP", "P")):
        cols += [f"coalesce(len_{t} / nullif(words, 0), 0.0) AS {pre}Proportion",
                 f"coalesce(len_{t} / nullif(emb_{t}, 0), 0.0) AS Avg{t}TypeLengthEmbedded",
                 f"coalesce(len_{t} / nullif(out_{t}, 0), 0.0) AS Avg{t}TypeLengthNonEmbedded",
                 f"coalesce(out_{t} / nullif(words, 0), 0.0) AS {t}TypeRate"]
    return (f"na AS (SELECT q.*, {anc} FROM nodes q), "
            f"pg AS (SELECT filename, utt_idx, tree_idx, {', '.join(aggs)} FROM na GROUP BY filename, utt_idx, tree_idx), "
            f"pf AS (SELECT filename, utt_idx, tree_idx, {', '.join(cols)} FROM pg)")


@query("f11_f17_phrase_features", BASE_NODES + ", " + _phrase_sql() + " SELECT filename, utt_idx, tree_idx, "
       + ", ".join(f"{r6(c)} AS {c}" for c in tr.PHRASE_COLS) + " FROM pf")
def f11(spark, sf_dir):
    p = tr.phrase_features(_nodes(spark, sf_dir))
    return p.select(*KEYS, *[F.round(c, 6).alias(c) for c in tr.PHRASE_COLS])


@query("f14_f17_phrase_rollup", BASE_NODES + ", " + _phrase_sql() + " SELECT filename, "
       + ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in tr.PHRASE_COLS) + " FROM pf GROUP BY filename")
def f14(spark, sf_dir):
    return tr.phrase_rollup(tr.phrase_features(_nodes(spark, sf_dir)))
