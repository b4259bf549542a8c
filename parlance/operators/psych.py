"""G: psycholinguistic norms, information units, picture regions, side switches.

Word look-ups are broadcast equi-joins to the fixed keyword tables (size bound
= the literal sets in ``functions.lexicons``); per-transcript results are
conditional aggregates over a known list of units/regions, so no pivot value
discovery pass is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.frames import running


def norm_lexicon(source: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """A14 stand-in: (measure, word, score) norms derived from a word-list table.

    familiarity = log(1 + occurrences), concreteness = word length,
    imagability = number of items using the word, aoa = first item using it.
    The long layout matches the ``score word`` files read by
    ``sources.io.read_norms``.
    """
    w = source.select(id_col, F.explode(tx.tokens(text_col)).alias("t")).filter(tx.is_word("t"))
    g = w.groupBy(F.lower("t").alias("word")).agg(
        F.log1p(F.count("*")).alias("familiarity"), F.length(F.first(F.lower("t"))).cast("double").alias("concreteness"),
        F.count_distinct(id_col).cast("double").alias("imagability"), F.min(id_col).cast("double").alias("aoa"))
    return g.select("word", F.expr("stack(4, 'familiarity', familiarity, 'concreteness', concreteness, "
                                   "'imagability', imagability, 'aoa', aoa) AS (measure, score)"))


def psycholinguistic_scores(content_words: DataFrame, norms: DataFrame) -> DataFrame:
    """Per measure, sum of scores of known non-stop words / (1 + known)."""
    counts = content_words.groupBy("filename", "word").agg(F.count("*").alias("k"))
    j = counts.join(norms, "word", "inner")
    agg = j.groupBy("filename").agg(*[
        F.sum(F.when(F.col("measure") == m, F.col("k") * F.col("score"))).alias(f"s_{m}") for m in lx.PSYCH_MEASURES],
        *[F.sum(F.when(F.col("measure") == m, F.col("k"))).alias(f"n_{m}") for m in lx.PSYCH_MEASURES])
    base = content_words.select("filename").distinct().join(agg, "filename", "left")
    return base.select("filename", *[
        tx.round6(F.coalesce(F.col(f"s_{m}"), F.lit(0.0)) / (1 + F.coalesce(F.col(f"n_{m}"), F.lit(0))))
        .alias(m) for m in lx.PSYCH_MEASURES])


def info_units(spark: SparkSession, words_df: DataFrame, transcripts: DataFrame) -> DataFrame:
    """G02 + G03: occurrences of each of the 16 unit sets, and their binaries."""
    kw = lx.table(spark, [(w, u) for w, u in lx.keyword_rows() if u in lx.INFO_UNITS], ["word", "unit"])
    j = words_df.select("filename", "word").join(kw, "word", "inner")
    agg = j.groupBy("filename").agg(*[F.count_if(F.col("unit") == u).alias(f"keyword{u}") for u in lx.INFO_UNITS])
    out = transcripts.select("filename").distinct().join(agg, "filename", "left").fillna(
        0, [f"keyword{u}" for u in lx.INFO_UNITS])
    return out.select("filename", *[f"keyword{u}" for u in lx.INFO_UNITS],
                      *[(F.col(f"keyword{u}") > 0).cast("int").alias(f"binary{u}") for u in lx.INFO_UNITS])


def action_units(tagged: DataFrame) -> DataFrame:
    """G04 + G05: utterances holding a noun-tagged subject word and a
    verb-tagged action word (both compared by stem), counted per transcript."""
    stem = tx.light_stem(F.col("lw"))
    t = tagged.select("filename", "utt_idx", stem.alias("st"),
                      F.col("pos").isin(lx.NOUN_TAGS).alias("is_noun"),
                      F.col("pos").isin(lx.VERB_TAGS).alias("is_verb"))
    sets = {**lx.INFO_UNITS, **lx.ACTION_WORDS}

    def stems(words):
        return [w for w in dict.fromkeys(_py_stem(x) for x in words)]

    flags = []
    for name, subj_sets, verb_set in lx.ACTION_UNITS:
        subj = stems([w for s in subj_sets for w in sets[s]])
        verb = stems(sets[verb_set])
        flags.append((F.max((F.col("is_noun") & F.col("st").isin(subj)).cast("int"))
                      * F.max((F.col("is_verb") & F.col("st").isin(verb)).cast("int"))).alias(name))
    per_utt = t.groupBy("filename", "utt_idx").agg(*flags)
    names = [a[0] for a in lx.ACTION_UNITS]
    agg = per_utt.groupBy("filename").agg(*[F.sum(n).cast("bigint").alias(f"keywordIUAction{n}") for n in names])
    return agg.select("filename", *[f"keywordIUAction{n}" for n in names],
                      *[(F.col(f"keywordIUAction{n}") > 0).cast("int").alias(f"binaryIUAction{n}") for n in names])


def _py_stem(w: str) -> str:
    """The light stem rule applied to the fixed keyword lists (same rule as
    ``functions.text.light_stem``)."""
    n = len(w)
    if n > 4 and w.endswith("ing"):
        return w[:-3]
    if n > 3 and w.endswith("ed"):
        return w[:-2]
    if n > 3 and w.endswith("s") and not w.endswith("ss"):
        return w[:-1]
    return w


def general_keywords(spark: SparkSession, words_df: DataFrame) -> DataFrame:
    """G06–G09 over the whole keyword set (all 20 sets, duplicates kept in
    the set size): count, keyword share, coverage and keyword TTR."""
    allw = [w for ws in {**lx.INFO_UNITS, **lx.ACTION_WORDS}.values() for w in ws]
    kw = lx.table(spark, [(w,) for w in dict.fromkeys(allw)], ["word"])
    n = words_df.groupBy("filename").agg(F.count("*").alias("n_words"))
    k = words_df.join(kw, "word", "inner").groupBy("filename").agg(
        F.count("*").alias("kw"), F.count_distinct("word").alias("kw_types"))
    j = n.join(k, "filename", "left").fillna(0, ["kw", "kw_types"])
    return j.select("filename", F.col("kw").alias("general_count"),
                    tx.round6(F.coalesce(tx.safe_div("kw", "n_words"), F.lit(0.0))).alias("general_kw_to_w_ratio"),
                    tx.round6(F.col("kw_types") / F.lit(len(allw))).alias("prcnt_general_uttered"),
                    tx.round6(F.coalesce(tx.safe_div("kw_types", "kw"), F.lit(0.0))).alias("general_ty_to_tok_ratio"))


def spatial_features(spark: SparkSession, words_df: DataFrame, split: str) -> DataFrame:
    """G06–G09 for each region of a picture split (halves, strips,
    quadrants); any other split is an error."""
    if split not in lx.REGIONS:
        raise ValueError(f"split must be one of {sorted(lx.REGIONS)}, not {split!r}")
    rows = [r for r in lx.region_rows() if r[0] == split]
    regions = list(lx.REGIONS[split])
    size = {r[1]: r[3] for r in rows}
    reg = lx.table(spark, [(w, r) for _, r, w, _ in rows], ["word", "region"])
    n = words_df.groupBy("filename").agg(F.count("*").alias("n_words"))
    hits = words_df.select("filename", "word").join(reg, "word", "inner")
    agg = hits.groupBy("filename").agg(
        *[F.count_if(F.col("region") == r).alias(f"c_{r}") for r in regions],
        *[F.count_distinct(F.when(F.col("region") == r, F.col("word"))).alias(f"d_{r}") for r in regions])
    j = n.join(agg, "filename", "left").fillna(0)
    cols = []
    for r in regions:
        c, d = F.col(f"c_{r}"), F.col(f"d_{r}")
        cols += [c.alias(f"{r}_count"),
                 tx.round6(F.coalesce(tx.safe_div(d, c), F.lit(0.0))).alias(f"{r}_ty_to_tok_ratio"),
                 tx.round6(F.when(c > 0, c / F.col("n_words")).otherwise(0.0)).alias(f"{r}_kw_to_w_ratio"),
                 tx.round6(d / F.lit(size[r])).alias(f"prcnt_{r}_uttered")]
    return j.select("filename", *cols)


def side_switches(spark: SparkSession, words_pos: DataFrame) -> DataFrame:
    """Changes of picture side along the word order (a word on both
    sides counts as right). Needs ``pos`` (transcript order)."""
    sides = lx.table(spark, lx.side_rows(), ["word", "side"])
    s = words_pos.select("filename", "pos", "word").join(sides, "word", "inner")
    s = running(s, ["pos"], "filename", earlier={"prev": "side"})
    sw = s.groupBy("filename").agg(
        F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col("side"))).alias("ls_rs_switches"))
    return words_pos.select("filename").distinct().join(sw, "filename", "left").fillna(0, ["ls_rs_switches"])
