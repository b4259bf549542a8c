"""F: constituency-tree features.

Trees arrive as bracket strings (``(ROOT (S (NP (DT the) (NN boy)) ...))``).
F01 turns each tree into a long node table with one ``aggregate`` over the
tree's bracket tokens carrying a stack — linear work per tree, one row in, no
shuffle, no recursive self-join. Every node records its parent, depth and the
labels of its ancestors, so the phrase features are plain aggregates.

The driver tables hold no parses, so ``build_trees`` derives them from tagged
tokens by a fixed chunking rule (consecutive tokens of one phrase class form
a chunk; a PP chunk takes the NP chunk that follows it). The rule uses only
windows and string aggregation, so the SQL oracle can rebuild the same trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx

# Fixed phrase class of each Penn tag for the tree builder.
PHRASE_OF_TAG = {
    "NP": ["DT", "PDT", "PRP$", "JJ", "JJR", "JJS", "NN", "NNS", "NNP", "NNPS", "CD", "PRP", "EX", "WP", "WP$"],
    "VP": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD", "RB", "RBR", "RBS", "TO"],
    "PP": ["IN"],
    "INTJ": ["UH"],
}
PHRASE_TYPES = ["NP", "VP", "PP"]
# Words per parsed chunk (the reference hands the parser at most 50 words at
# a time); bounds every tree, and so the per-tree array fold, by a constant.
TREE_WORDS = 50
TREE_KEYS = ("filename", "utt_idx", "tree_idx")
BRACKET_RE = r"\([^\s()]+(?: [^\s()]+)?|\)"


def phrase_class(pos_col="pos"):
    e = None
    for cls, tags in PHRASE_OF_TAG.items():
        cond = F.col(pos_col).isin(tags)
        e = F.when(cond, cls) if e is None else e.when(cond, cls)
    return e


def _escape(c):
    return F.regexp_replace(F.regexp_replace(c, r"\(", "-LRB-"), r"\)", "-RRB-")


def build_trees(tagged: DataFrame) -> DataFrame:
    """(filename, utt_idx, tree_idx, tree) from tagged tokens (see module
    doc); one tree per consecutive ``TREE_WORDS``-token chunk of an
    utterance."""
    k = list(TREE_KEYS)
    tagged = tagged.withColumn("tree_idx", F.floor(F.col("tok_idx") / TREE_WORDS))
    w = Window.partitionBy(*k).orderBy("tok_idx")
    t = tagged.select(*k, "tok_idx", phrase_class().alias("cls"),
                      F.concat(F.lit("("), _escape(F.col("pos")), F.lit(" "), _escape(F.col("token")),
                               F.lit(")")).alias("leaf"))
    new = (F.col("cls").isNull() | F.lag("cls").over(w).isNull() | (F.lag("cls").over(w) != F.col("cls")))
    t = t.withColumn("chunk", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ch = t.groupBy(*k, "chunk").agg(
        F.first("cls").alias("cls"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "leaf"))),
                                 lambda s: s["leaf"]), " ").alias("leaves"))
    wc = Window.partitionBy(*k).orderBy("chunk")
    ch = ch.withColumn("next_cls", F.lead("cls").over(wc)).withColumn("prev_cls", F.lag("cls").over(wc))
    ch = ch.withColumn("next_str", F.lead(F.concat(F.lit("(NP "), F.col("leaves"), F.lit(")"))).over(wc))
    absorbed = (F.col("cls") == "NP") & (F.col("prev_cls") == "PP")
    s = (F.when(F.col("cls").isNull(), F.col("leaves"))
         .when((F.col("cls") == "PP") & (F.col("next_cls") == "NP"),
               F.concat(F.lit("(PP "), F.col("leaves"), F.lit(" "), F.col("next_str"), F.lit(")")))
         .otherwise(F.concat(F.lit("("), F.col("cls"), F.lit(" "), F.col("leaves"), F.lit(")"))))
    ch = ch.filter(~F.coalesce(absorbed, F.lit(False))).select(*k, "chunk", s.alias("s"))
    tr = ch.groupBy(*k).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s"))), lambda x: x["s"]),
                     " ").alias("body"))
    return tr.select(*k, F.concat(F.lit("(ROOT (S "), F.col("body"), F.lit("))")).alias("tree"))


def tree_nodes(trees: DataFrame, tree_col: str = "tree", keys=TREE_KEYS) -> DataFrame:
    """one row per node — (keys, node_id, parent_id, depth, label, word,
    anc) with ``anc`` the ancestor labels root-first; leaves carry the word.
    Unbalanced closing brackets are ignored (the stack never goes below 0)."""
    toks = F.regexp_extract_all(F.col(tree_col), F.lit(BRACKET_RE), 0)
    node_t = "struct<id:int,parent:int,depth:int,label:string,word:string,anc:array<string>>"
    init = F.struct(F.array().cast("array<struct<id:int,label:string>>").alias("stack"),
                    F.array().cast(f"array<{node_t}>").alias("nodes"),
                    F.lit(0).alias("next"))

    def step(acc, tok):
        is_close = tok == ")"
        stack = acc["stack"]
        n = F.size(stack)
        label = F.regexp_extract(tok, r"^\(([^\s()]+)", 1)
        word = F.nullif(F.regexp_extract(tok, r"^\([^\s()]+ ([^\s()]+)$", 1), F.lit(""))
        parent = F.when(n > 0, F.element_at(stack, -1)["id"]).otherwise(F.lit(-1))
        node = F.struct(acc["next"].alias("id"), parent.alias("parent"), n.alias("depth"), label.alias("label"),
                        word.alias("word"), F.transform(stack, lambda s: s["label"]).alias("anc"))
        opened = F.struct(F.array_append(stack, F.struct(acc["next"].alias("id"), label.alias("label"))).alias("stack"),
                          F.array_append(acc["nodes"], node).alias("nodes"),
                          (acc["next"] + 1).alias("next"))
        closed = F.struct(F.when(n > 0, F.slice(stack, 1, n - 1)).otherwise(stack).alias("stack"),
                          acc["nodes"].alias("nodes"), acc["next"].alias("next"))
        return F.when(is_close, closed).otherwise(opened)

    nodes = F.aggregate(toks, init, step, lambda a: a["nodes"])
    return trees.select(*keys, F.explode(nodes).alias("n")).select(*keys, "n.*").withColumnRenamed(
        "id", "node_id").withColumnRenamed("parent", "parent_id")


def tree_size(nodes: DataFrame, keys=TREE_KEYS) -> DataFrame:
    """F02 node count and F03 height (longest root-to-leaf path, in nodes)."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"), (F.max("depth") + 1).alias("height"))


def children_labels(nodes: DataFrame, keys=TREE_KEYS) -> DataFrame:
    """Per parent node: label and the set of child labels (self equi-join on
    (tree, parent_id = node_id), then one grouped collect per parent — a
    node's children, bounded by the tree)."""
    kids = nodes.select(*keys, F.col("parent_id").alias("node_id"), F.col("label").alias("child"))
    par = nodes.select(*keys, "node_id", "label")
    return par.join(kids, [*keys, "node_id"]).groupBy(*keys, "node_id", "label").agg(
        F.collect_set("child").alias("children"), F.count("*").alias("n_children"))


def named_rules(nodes: DataFrame, keys=TREE_KEYS) -> DataFrame:
    """Per tree, number of parents of type P whose child labels
    include the rule's children (one child: an edge count, F04; several: a
    set test, F05). Quirk 13 fixed: ADVP→RB, two-child rules by set test."""
    ch = children_labels(nodes, keys)
    edges = nodes.select(*keys, F.col("parent_id").alias("node_id"), F.col("label").alias("child")).join(
        nodes.select(*keys, "node_id", F.col("label").alias("plabel")), [*keys, "node_id"])
    aggs_e, aggs_s = [], []
    for name, parent, childs in lx.TREE_RULES:
        if len(childs) == 1:
            aggs_e.append(F.count_if((F.col("plabel") == parent) & (F.col("child") == childs[0])).alias(name))
        else:
            need = F.array(*[F.lit(c) for c in childs])
            aggs_s.append(F.count_if((F.col("label") == parent)
                                     & (F.size(F.array_except(need, F.col("children"))) == 0)).alias(name))
    base = nodes.select(*keys).distinct()
    e = edges.groupBy(*keys).agg(*aggs_e)
    s = ch.groupBy(*keys).agg(*aggs_s)
    return base.join(e, list(keys), "left").join(s, list(keys), "left").fillna(0)


def aux_dependencies(tagged: DataFrame) -> DataFrame:
    """F07 stand-in for a dependency parse: a token's relation to its head by
    fixed rules — a form of be followed by an adjective or noun is ``cop``;
    a be-form followed by a past participle ``auxpass``; other auxiliaries
    and modals ``aux``; a base verb after ``to`` ``xcomp``."""
    w = Window.partitionBy("filename", "utt_idx").orderBy("tok_idx")
    nxt, prv = F.lead("pos").over(w), F.lag("lw").over(w)
    be = F.col("lemma") == "be"
    dep = (F.when(be & nxt.isin("JJ", "JJR", "JJS", "NN", "NNS", "NNP", "NNPS"), "cop")
           .when(be & (nxt == "VBN"), "auxpass")
           .when((F.col("upos") == "AUX") & nxt.isin(lx.VERB_TAGS), "aux")
           .when((F.col("pos") == "VB") & (prv == "to"), "xcomp"))
    return tagged.select("filename", "utt_idx", F.floor(F.col("tok_idx") / TREE_WORDS).alias("tree_idx"),
                         "tok_idx", "token", dep.alias("dep"))


def vp_aux(nodes: DataFrame, deps: DataFrame, keys=TREE_KEYS) -> DataFrame:
    """F07 count of auxiliary relations and F08 VP→AUX VP / VP→AUX ADJP: VP
    nodes with a leaf child whose word is an auxiliary dependent of the same
    utterance and a child labelled VP / ADJP."""
    auxw = deps.filter(F.col("dep").isin(lx.AUX_DEPENDENCIES)).select(*keys, F.col("token").alias("word")).distinct()
    n_aux = deps.groupBy(*keys).agg(F.count_if(F.col("dep").isin(lx.AUX_DEPENDENCIES)).alias("VP_to_AUX"))
    kids = nodes.select(*keys, F.col("parent_id").alias("node_id"), F.col("label").alias("child"), "word")
    kids = kids.join(auxw.withColumn("is_aux", F.lit(True)), [*keys, "word"], "left")
    vps = nodes.filter(F.col("label") == "VP").select(*keys, "node_id")
    per_vp = vps.join(kids, [*keys, "node_id"]).groupBy(*keys, "node_id").agg(
        F.max(F.coalesce("is_aux", F.lit(False)).cast("int")).alias("has_aux"),
        F.max((F.col("child") == "VP").cast("int")).alias("has_vp"),
        F.max((F.col("child") == "ADJP").cast("int")).alias("has_adjp"))
    f08 = per_vp.groupBy(*keys).agg(F.sum(F.col("has_aux") * F.col("has_vp")).alias("VP_to_AUX_VP"),
                                    F.sum(F.col("has_aux") * F.col("has_adjp")).alias("VP_to_AUX_ADJP"))
    base = nodes.select(*keys).distinct()
    return base.join(n_aux, list(keys), "left").join(f08, list(keys), "left").fillna(0)


def tree_rollup(nodes: DataFrame, rules: DataFrame, aux: DataFrame) -> DataFrame:
    """per transcript, sums over its trees of height, named rules and
    auxiliary counts, each ÷ total nodes (Quirk 14 fixed: per-tree pairing)."""
    size = tree_size(nodes)
    per_tree = size.join(rules, list(TREE_KEYS)).join(aux, list(TREE_KEYS))
    cols = ["height"] + [r[0] for r in lx.TREE_RULES] + ["VP_to_AUX", "VP_to_AUX_VP", "VP_to_AUX_ADJP"]
    g = per_tree.groupBy("filename").agg(F.sum("n_nodes").alias("nodes"), *[F.sum(c).alias(c) for c in cols])
    return g.select("filename", *[tx.round6(tx.safe_div(c, "nodes")).alias(c if c != "height" else "tree_height")
                                  for c in cols])


def constituent_shares(nodes: DataFrame) -> DataFrame:
    """count of each of the 21 constituent labels ÷ total nodes."""
    n = F.count("*")
    return nodes.groupBy("filename").agg(*[tx.round6(F.count_if(F.col("label") == l) / n).alias(l)
                                           for l in lx.CFG_LABELS])


def phrase_features(nodes: DataFrame, keys=TREE_KEYS) -> DataFrame:
    """F11–F17 per tree: phrase length (words × enclosing phrases of the type,
    Quirk 16 fixed), embedded and outermost counts, proportions, average
    lengths (Quirk 18 fixed) and type rates."""
    leaf = F.col("word").isNotNull()
    aggs = [F.count_if(leaf).alias("words")]
    for t in PHRASE_TYPES:
        aggs += [F.sum(F.when(leaf, F.size(F.filter("anc", lambda a: a == t))).otherwise(0)).alias(f"len_{t}"),
                 F.count_if(F.col("label") == t).alias(f"emb_{t}"),
                 F.count_if((F.col("label") == t) & ~F.array_contains("anc", t)).alias(f"out_{t}")]
    g = nodes.groupBy(*keys).agg(*aggs)
    cols = []
    for t, pre in (("NP", "NP"), ("VP", "VP"), ("PP", "P")):
        cols += [F.coalesce(tx.safe_div(f"len_{t}", "words"), F.lit(0.0)).alias(f"{pre}Proportion"),
                 F.coalesce(tx.safe_div(f"len_{t}", f"emb_{t}"), F.lit(0.0)).alias(f"Avg{t}TypeLengthEmbedded"),
                 F.coalesce(tx.safe_div(f"len_{t}", f"out_{t}"), F.lit(0.0)).alias(f"Avg{t}TypeLengthNonEmbedded"),
                 F.coalesce(tx.safe_div(f"out_{t}", "words"), F.lit(0.0)).alias(f"{t}TypeRate")]
    return g.select(*keys, *[f"len_{t}" for t in PHRASE_TYPES], *[f"emb_{t}" for t in PHRASE_TYPES],
                    *[f"out_{t}" for t in PHRASE_TYPES], *cols)


PHRASE_COLS = [f"{pre}Proportion" for pre in ("NP", "VP", "P")] + [
    f"Avg{t}TypeLength{k}" for t in PHRASE_TYPES for k in ("Embedded", "NonEmbedded")] + [
    f"{t}TypeRate" for t in PHRASE_TYPES]


def phrase_rollup(per_tree: DataFrame) -> DataFrame:
    """Per transcript mean over its trees (the interview roll-up of F14–F17)."""
    return per_tree.groupBy("filename").agg(*[tx.round6(F.avg(c)).alias(c) for c in PHRASE_COLS])
