"""C and D: counts, shares, corpus frequencies and vocabulary richness.

All per-transcript features are grouped aggregates keyed by ``filename``
(partial aggregation before the shuffle); the richness measures that need a
per-type count first aggregate by (filename, term), which also spreads a very
large transcript over many tasks. Sequence measures use windows keyed by
(filename, term) or by (filename, segment), never a whole transcript in one
task. MTLD (D06) folds short transcripts as arrays; ``mtld`` has the form for
transcripts of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.frames import grouped_prefix_sum
from .prep import tag_types

WORDS = 2_000_000  # words of a task that are listed together


def token_types(toks: DataFrame) -> DataFrame:
    """(filename, token, f): every distinct token of a transcript once, with
    its frequency — what the order-free measures need of the tokens."""
    return toks.groupBy("filename", "token").agg(F.count("*").alias("f"))


def rich_terms(toks: DataFrame) -> DataFrame:
    """Lower-cased tokens without one-character punctuation (B11), without
    positions — enough for the order-free measures (Maas, HD-D). The
    frequency of ``token_types`` is kept."""
    f = ["f"] if "f" in toks.columns else []
    return toks.filter(~tx.is_punct_token("token")).select("filename", F.lower("token").alias("term"), *f)


def rich_tokens(toks: DataFrame) -> DataFrame:
    """Lower-cased tokens without one-character punctuation (B11), with a
    global position ``pos`` in transcript order (utterance, then token)."""
    t = toks.filter(~tx.is_punct_token("token")).select(
        "filename", "utt_idx", "tok_idx", F.lower("token").alias("term"))
    # Offsets: per-utterance token counts, exclusive running sum over the
    # utterances of each transcript (distributed prefix sum, so one huge
    # transcript does not pin a single task).
    per_utt = t.groupBy("filename", "utt_idx").agg(F.count("*").alias("k"))
    offs = grouped_prefix_sum(per_utt, "filename", "utt_idx", "k", out_col="off").drop("k")
    rn = Window.partitionBy("filename", "utt_idx").orderBy("tok_idx")
    return (t.withColumn("i", F.row_number().over(rn) - 1)
             .join(offs, ["filename", "utt_idx"])
             .withColumn("pos", F.col("off") + F.col("i")).drop("off", "i"))


def token_counts(toks: DataFrame) -> DataFrame:
    """C01, C02, D01-style TTR and D10 mean token length per transcript.

    Two-level aggregate: per (filename, token) first, then per filename — no
    distinct-aggregate row expansion, and a very long transcript is spread
    over many tasks by the first level.
    """
    per_type = toks.groupBy("filename", "token").agg(F.count("*").alias("f"))
    g = per_type.groupBy("filename").agg(F.sum("f").alias("n_tokens"), F.count("*").alias("n_unique_tokens"),
                                         F.sum(F.col("f") * F.length("token")).alias("chars"))
    return g.select("filename", "n_tokens", "n_unique_tokens",
                    tx.round6(F.try_divide(F.col("n_unique_tokens").cast("double"), F.col("n_tokens"))).alias("ttr"),
                    tx.round6(F.try_divide(F.col("chars").cast("double"), F.col("n_tokens"))).alias("mean_token_length"))


def token_profile(tagged: DataFrame) -> DataFrame:
    """C01 + C02 + D10 + C04 in one aggregate over tagged tokens: per
    (filename, token, upos) — the tag is a function of the token — then per
    (filename, upos), then per filename. Same values as ``token_counts`` + ``pos_shares`` with one
    pass over the tokens instead of two. Tagged ``token_types`` have the first
    level behind them."""
    per_type = tagged if "f" in tagged.columns else tagged.groupBy("filename", "token", "upos").agg(F.count("*").alias("f"))
    # A row a tag, before the tags become columns: three sums a type, not 20.
    tags = per_type.groupBy("filename", "upos").agg(F.sum("f").alias("f"), F.count("*").alias("v"), F.sum(F.col("f") * F.length("token")).alias("ch"))
    g = tags.groupBy("filename").agg(
        F.sum("f").alias("n_tokens"), F.sum("v").alias("n_unique_tokens"), F.sum("ch").alias("chars"),
        *[F.sum(F.when(F.col("upos") == t, F.col("f")).otherwise(0)).alias(f"c_{t}") for t in lx.UNIVERSAL_TAGS])
    return g.select("filename", *_profile_columns())


def _profile_columns() -> list:
    n = F.col("n_tokens")
    return [n, F.col("n_unique_tokens"),
            tx.round6(F.try_divide(F.col("n_unique_tokens").cast("double"), n)).alias("ttr"),
            tx.round6(F.try_divide(F.col("chars").cast("double"), n)).alias("mean_token_length"),
            *[tx.round6(F.col(f"c_{t}") / n).alias(f"share_{t}") for t in lx.UNIVERSAL_TAGS]]


def _word_lists(batches, size: int):
    """(g, word, filename, f): every distinct word of a run of rows once, with
    the transcripts that hold it and how often. A run ``g`` is of batches with
    about ``size`` words."""
    def lists(g, names, words):
        names, words = pa.concat_arrays(names), pa.concat_arrays(words).dictionary_encode()
        name = names.dictionary_encode()
        key = words.indices.to_numpy().astype(np.int64) << 32 | name.indices.to_numpy()
        key, f = np.unique(key, return_counts=True)
        at = np.searchsorted(key >> 32, np.arange(len(words.dictionary) + 1)).astype(np.int32)
        held = name.dictionary.take(pa.array(key & 0xFFFFFFFF))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(words.dictionary), g)), words.dictionary, pa.ListArray.from_arrays(at, held),
             pa.ListArray.from_arrays(at, pa.array(f.astype(np.int64)))], names=["g", "word", "filename", "f"])

    g, n, names, words = 0, 0, [], []
    for b in batches:
        found = pc.ascii_split_whitespace(b.column("text"))  # the \s of TOKEN_RE
        names.append(b.column("filename").take(pc.list_parent_indices(found)))
        words.append(found.flatten())
        n += len(words[-1])
        if n >= size:
            yield lists(g, names, words)
            g, n, names, words = g + 1, 0, [], []
    if n:
        yield lists(g, names, words)


def _word_sums(batches, tags: list[str]):
    """A row a transcript with the sums of its types, from tagged tokens with
    lists of transcripts. The rows of a run lie one after the other and the
    transcripts of a partition ascend over its runs; of the last one of a run,
    which may go on in the next, the types are kept."""
    def sums(t):
        """t: rows (filename, token, term, upos, rich, f)."""
        t = t.unify_dictionaries()
        name, token, term = (t.column(c).combine_chunks() for c in ("filename", "token", "term"))
        d, size, upos = name.indices.to_numpy(), len(name.dictionary), t.column("upos").to_numpy()
        key, first, of = np.unique(d.astype(np.int64) << 32 | token.indices.to_numpy(), return_index=True, return_inverse=True)
        f, d, upos = np.bincount(of, t.column("f").to_numpy()), d[first], upos[first]
        chars = pc.utf8_length(token.dictionary).to_numpy()[key & 0xFFFFFFFF]
        by_tag = np.bincount(d * (len(tags) + 1) + upos, f, size * (len(tags) + 1)).reshape(size, -1)
        rich = np.flatnonzero(t.column("rich").to_numpy()[first])
        key, of = np.unique(d[rich].astype(np.int64) << 32 | term.indices.to_numpy()[first[rich]], return_inverse=True)
        rf, rd = np.bincount(of, f[rich], len(key)), key >> 32
        cols = [np.bincount(d, f, size), np.bincount(d, minlength=size), np.bincount(d, f * chars, size), *by_tag.T[:-1],
                np.bincount(rd, rf, size), np.bincount(rd, minlength=size)]
        return pa.RecordBatch.from_arrays(
            [name.dictionary, *[pa.array(c.astype(np.int64)) for c in cols], pa.array(np.bincount(rd, rf * rf, size))],
            names=["filename", "n_tokens", "n_unique_tokens", "chars", *[f"c_{t}" for t in tags], "N", "V", "F2"])

    kept, encoded = None, ("filename", "token", "term")  # the types of the last transcript

    def closed(parts):
        nonlocal kept
        t = pa.Table.from_batches(parts)
        names, f = (t.column(c).combine_chunks() for c in ("filename", "f"))
        at, upos = pc.list_parent_indices(names), pc.fill_null(pc.index_in(t.column("upos").combine_chunks(), pa.array(tags)), len(tags))
        names = names.flatten()
        own = {c: t.column(c).combine_chunks().dictionary_encode().take(at) for c in ("token", "term")}
        t = pa.table({"filename": names.dictionary_encode(), **own, "upos": upos.take(at), "rich": t.column("rich").combine_chunks().take(at), "f": f.flatten()})
        t = t if kept is None else pa.concat_tables([kept, t])
        newest = pc.max(names)  # not before the one that was kept
        last = pc.equal(t.column("filename").cast(names.type), newest)
        plain = t.filter(last)
        plain = pa.table({c: plain.column(c).cast(plain.schema.field(c).type.value_type) if c in encoded else plain.column(c) for c in plain.column_names})
        plain = plain.group_by(["filename", "token", "term", "upos", "rich"]).aggregate([("f", "sum")])
        kept = pa.table({c: plain.column("f_sum" if c == "f" else c).combine_chunks() for c in t.column_names})
        kept = pa.table({c: kept.column(c).dictionary_encode() if c in encoded else kept.column(c) for c in t.column_names})
        return t.filter(pc.invert(last))

    held, at = [], None
    for b in batches:
        run = b.column("g").to_numpy()
        for part in np.split(np.arange(len(run)), np.flatnonzero(np.diff(run)) + 1):
            if not len(part):
                continue
            if held and run[part[0]] != at:
                t = closed(held)
                held = []
                if len(t):
                    yield sums(t)
            at = run[part[0]]
            held.append(b.slice(int(part[0]), len(part)))
    if held:
        t = closed(held)
        if len(t):
            yield sums(t)
        yield sums(kept)


def text_profile(spark: SparkSession, utts: DataFrame, words: int = WORDS) -> DataFrame:
    """``token_profile`` and ``richness_scalar`` of the transcripts that have
    both, in one pass over the texts. No token contains white space, so a
    token is made, tagged and put into lower case once for each distinct word
    of a run of texts, not once for each occurrence; counts follow as sums of
    integers. The texts are shuffled by transcript once."""
    kind = utts.schema["filename"].dataType.simpleString()
    dealt = utts.filter("filename IS NOT NULL AND text IS NOT NULL").select("filename", "text").repartition("filename").sortWithinPartitions("filename")
    listed = dealt.mapInArrow(lambda b: _word_lists(b, words), f"g long, word string, filename array<{kind}>, f array<long>")
    tagged = tag_types(spark, listed.select("g", F.explode(tx.tokens("word")).alias("token"), "filename", "f"))
    tagged = tagged.select("g", "token", F.col("lw").alias("term"), "upos", (~tx.is_punct_token("token")).alias("rich"), "filename", "f")
    tags = list(lx.UNIVERSAL_TAGS)
    sums = ["n_tokens", "n_unique_tokens", "chars", *[f"c_{t}" for t in tags], "N", "V"]
    g = tagged.mapInArrow(lambda b: _word_sums(b, tags), f"filename {kind}, " + ", ".join(f"{c} long" for c in sums) + ", F2 double")
    return g.filter("N > 0").select("filename", *_profile_columns(), *_richness_columns())


def whitespace_ttr(utts: DataFrame) -> DataFrame:
    """Types / tokens over the raw whitespace split; null when empty."""
    w = utts.select("filename", F.explode(F.split(F.trim("text"), r"\s+")).alias("w")).filter("w <> ''")
    return w.groupBy("filename").agg(
        F.count("*").alias("n_words"),
        tx.round6(F.try_divide(F.count_distinct("w").cast("double"), F.count("*"))).alias("ttr"))


def lemma_counts(tagged: DataFrame) -> DataFrame:
    """Distinct lemmas per transcript."""
    return tagged.groupBy("filename").agg(F.count_distinct("lemma").alias("n_unique_lemmas"))


def pos_shares(tagged: DataFrame) -> DataFrame:
    """Share of each of the 17 universal tags; 0.0 when absent."""
    n = F.count("*")
    cols = [tx.round6(F.count_if(F.col("upos") == t) / n).alias(f"share_{t}") for t in lx.UNIVERSAL_TAGS]
    return tagged.groupBy("filename").agg(n.alias("n_tokens"), *cols)


def entity_features(mentions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """C05 + C06: entity count, distinct entities and the share of each of the
    18 labels; transcripts without entities get zeros (Quirk 4)."""
    n = F.count("*")
    agg = mentions.groupBy("filename").agg(
        n.alias("n_entities"), F.count_distinct("entity").alias("n_unique_entities"),
        *[tx.round6(F.count_if(F.col("label") == l) / n).alias(f"ent_{l}") for l in lx.ENTITY_LABELS])
    out = transcripts.select("filename").distinct().join(agg, "filename", "left")
    return out.fillna(0, subset=["n_entities", "n_unique_entities"]).fillna(
        0.0, subset=[f"ent_{l}" for l in lx.ENTITY_LABELS])


def corpus_frequency(df: DataFrame, column: str) -> DataFrame:
    """Global frequency table, most frequent first (value breaks ties)."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def frequency_lexicon(spark: SparkSession, source: DataFrame, text_col: str = "text") -> DataFrame:
    """A15 stand-in: word -> (SUBTLWF per million words, Lg10WF) derived from a
    reference text table, first spelling per lower-cased word."""
    w = source.select(F.explode(tx.tokens(text_col)).alias("t")).filter(tx.is_word("t"))
    c = w.groupBy(F.lower("t").alias("word")).agg(F.count("*").alias("n"))
    total = w.agg(F.count("*").alias("total"))
    return tx.attach_scalar(c, total).select(
        "word", (F.col("n") * 1e6 / F.col("total")).alias("subtlwf"),
        F.log10(F.col("n") + 1).alias("lg10wf"))


def word_lexical_frequency(words_df: DataFrame, lexicon: DataFrame, value: str = "subtlwf") -> DataFrame:
    """Frequency of each distinct lower-cased word, -1 when unknown."""
    d = words_df.select("word").distinct()
    return d.join(lexicon.select("word", value), "word", "left").select(
        "word", tx.round6(F.coalesce(F.col(value), F.lit(-1.0))).alias("frequency"))


def subtl_score(spark: SparkSession, tagged: DataFrame, lexicon: DataFrame) -> DataFrame:
    """C09 + C10: mean frequency of known tokens that are not stop words, not
    clitics and not tagged PRP, PRP$, WP$ or EX, rounded to 2; the stop list
    grows per transcript only (Quirk 6 fixed); 0.0 for no known word."""
    keep = tagged.filter(~F.col("pos").isin("PRP", "PRP$", "WP$", "EX") & ~F.col("token").startswith("'"))
    # Counted per (transcript, word) first: a frequent word is one row a
    # transcript in the lexicon join, not one row a token.
    counts = keep.groupBy("filename", F.col("lw").alias("word")).agg(F.count("*").alias("k"))
    known = (counts.join(lx.stop_words_df(spark), "word", "left_anti")
             .join(lexicon.select("word", "subtlwf"), "word", "inner"))
    score = known.groupBy("filename").agg(
        F.round(F.sum(F.col("k") * F.col("subtlwf")) / F.sum("k"), 2).alias("subtl_score"))
    return tagged.select("filename").distinct().join(score, "filename", "left").fillna(0.0, ["subtl_score"])


def welch(a_mean, a_var, a_n, b_mean, b_var, b_n):
    """Welch t and degrees of freedom as column expressions (M09 core)."""
    va, vb = F.col(a_var) / F.col(a_n), F.col(b_var) / F.col(b_n)
    t = F.try_divide(F.col(a_mean) - F.col(b_mean), F.sqrt(va + vb))
    df = F.try_divide((va + vb) ** 2, va ** 2 / (F.col(a_n) - 1) + vb ** 2 / (F.col(b_n) - 1))
    return t, df


def cohort_lexical_comparison(words_freq: DataFrame, cohort_col: str = "cohort") -> DataFrame:
    """C11: per cohort mean word frequency, variance, size and unique-word
    ratio; every cohort pair (i < j) with its Welch t and df."""
    g = words_freq.groupBy(cohort_col).agg(
        F.avg("frequency").alias("mean"), F.var_samp("frequency").alias("var"),
        F.count("*").alias("n"), (F.count_distinct("word") / F.count("*")).alias("unique_ratio"))
    a = g.select(*[F.col(c).alias(f"a_{c}") for c in g.columns])
    b = g.select(*[F.col(c).alias(f"b_{c}") for c in g.columns])
    # One row a cohort on both sides: every pair of cohorts is the result.
    pairs = a.join(b, F.col(f"a_{cohort_col}") < F.col(f"b_{cohort_col}"))
    t, dfree = welch("a_mean", "a_var", "a_n", "b_mean", "b_var", "b_n")
    return pairs.select(
        F.col(f"a_{cohort_col}").alias("cohort_a"), F.col(f"b_{cohort_col}").alias("cohort_b"),
        tx.round6("a_mean").alias("mean_a"), tx.round6("b_mean").alias("mean_b"),
        tx.round6("a_unique_ratio").alias("unique_ratio_a"), tx.round6("b_unique_ratio").alias("unique_ratio_b"),
        tx.round6(t).alias("t"), tx.round6(dfree).alias("df"))


def cohort_summary(df: DataFrame, label_col: str, value_col: str) -> DataFrame:
    """Count, mean and population std of a column per label (NaN -> null)."""
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(label_col).agg(
        F.count(v).alias("n"), tx.round6(F.avg(v)).alias("mean"), tx.round6(F.stddev_pop(v)).alias("std"))


# --- D: vocabulary richness -------------------------------------------------

def type_counts(rich: DataFrame) -> DataFrame:
    """Per (filename, term) frequency — the first level of the richness aggregates."""
    return rich.groupBy("filename", "term").agg((F.sum("f") if "f" in rich.columns else F.count("*")).alias("f"))


def richness_scalar(rich: DataFrame) -> DataFrame:
    """D05 Maas and D07 HD-D (draws=2) from N, V and per-type counts.

    HD-D with k=2: sum over types of (1 - (N-f)(N-f-1) / (N(N-1))) / 2. The
    sum of (N-f)(N-f-1) is V·N(N-1) - (2N-1)·N + Σf², so N, V and Σf² are
    enough and no type is joined to its transcript's totals.
    """
    f = F.col("f").cast("double")
    n = type_counts(rich).groupBy("filename").agg(F.sum("f").alias("N"), F.count("*").alias("V"), F.sum(f * f).alias("F2"))
    return n.select("filename", F.col("N").alias("n_tokens"), F.col("V").alias("n_types"), *_richness_columns())


def _richness_columns() -> list:
    total = F.col("N").cast("double")
    hdd = F.try_divide((2 * total - 1) * total - F.col("F2"), 2 * total * (total - 1))
    maas = F.when(F.col("N") > 1, F.try_divide(F.log("N") - F.log("V"), F.log("N") ** 2))
    return [tx.round6(maas).alias("maas"), tx.round6(hdd).alias("hdd")]


def msttr(rich: DataFrame, window: int = 3) -> DataFrame:
    """Mean TTR over successive full segments of ``window`` tokens."""
    seg = rich.withColumn("seg", F.floor(F.col("pos") / window))
    s = seg.groupBy("filename", "seg").agg(F.count("*").alias("k"), F.count_distinct("term").alias("v"))
    return s.filter(F.col("k") == window).groupBy("filename").agg(
        tx.round6(F.avg(F.col("v") / F.lit(window))).alias("msttr"))


MATTR_BUCKET = 4096  # positions per window partition (look-ahead rows are copied across edges)


def mattr(rich: DataFrame, window: int = 3, pad_short: bool = False) -> DataFrame:
    """Moving-average TTR over every window of ``window`` tokens.

    Distinct types in a window = positions whose next occurrence of the same
    term lies beyond the window's end, so each token contributes to the
    windows i in [max(p, w-1), min(p+w-1, next-1, N-1)]. Only an occurrence
    within the next w-1 positions matters, so ``next`` is found by looking
    ahead w-1 rows inside (transcript, position bucket) partitions; the first
    w-1 rows of each bucket are also copied into the previous bucket. Every
    partition is bounded (bucket + w-1 rows) however long the transcript or
    frequent the term. With ``pad_short`` (D04 form) a transcript shorter
    than the window gives V / window (the reference divides by the window
    size regardless).
    """
    w1 = window - 1
    b = F.floor(F.col("pos") / MATTR_BUCKET)
    own = rich.select("filename", "pos", "term", b.alias("bk"), F.lit(True).alias("own"))
    ahead = (rich.filter((F.col("pos") % MATTR_BUCKET) < w1)
             .select("filename", "pos", "term", (b - 1).alias("bk"), F.lit(False).alias("own")))
    rows = own.unionByName(ahead)
    look = F.collect_list("term").over(Window.partitionBy("filename", "bk").orderBy("pos").rowsBetween(1, w1))
    r = rows.withColumn("nxt_off", F.array_position(look, F.col("term"))).filter("own")
    n = rich.groupBy("filename").agg(F.count("*").alias("N"), F.count_distinct("term").alias("V"))
    r = r.join(n, "filename")
    nxt = F.when(F.col("nxt_off") > 0, F.col("pos") + F.col("nxt_off"))
    lo = F.greatest(F.col("pos"), F.lit(w1))
    hi = F.least(F.col("pos") + w1, F.coalesce(nxt - 1, F.col("N") - 1), F.col("N") - 1)
    contrib = F.greatest(hi - lo + 1, F.lit(0))
    s = r.groupBy("filename", "N", "V").agg(F.sum(contrib).alias("s"))
    windows = F.col("N") - window + 1
    val = F.when(F.col("N") >= window, F.col("s") / (windows * window))
    if pad_short:
        val = val.otherwise(F.col("V") / F.lit(window))
    return s.select("filename", tx.round6(val).alias(f"mattr_{window}"))


def mtld(rich: DataFrame, threshold: float = 0.72) -> DataFrame:
    """MTLD, forward and reversed, averaged (see ``operators.mtld``)."""
    from .mtld import mtld as run
    return run(rich, threshold)


def mtld_arrays(rich: DataFrame, threshold: float = 0.72) -> DataFrame:
    """D06 for transcripts whose terms fit into one array: the factor state
    (types seen, tokens, factors) is a higher-order ``aggregate`` over the
    ordered terms."""
    seq = rich.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("s"))
    seq = seq.select("filename", F.transform("s", lambda x: x["term"]).alias("terms"))

    def run(arr):
        init = F.struct(F.array().cast("array<string>").alias("types"), F.lit(0).alias("n"),
                        F.lit(0.0).alias("factors"))

        def step(acc, t):
            types = F.when(F.array_contains(acc["types"], t), acc["types"]).otherwise(
                F.array_append(acc["types"], t))
            n = acc["n"] + 1
            ttr = F.size(types) / n
            done = ttr <= F.lit(threshold)
            return F.struct(F.when(done, F.array().cast("array<string>")).otherwise(types).alias("types"),
                            F.when(done, F.lit(0)).otherwise(n).alias("n"),
                            (acc["factors"] + F.when(done, 1.0).otherwise(0.0)).alias("factors"))

        def finish(acc):
            partial = F.when(acc["n"] > 0, (1 - F.size(acc["types"]) / acc["n"]) / (1 - threshold)).otherwise(0.0)
            total = acc["factors"] + partial
            # No factor and no partial factor: every term distinct -> one factor.
            return F.size(arr).cast("double") / F.when(total == 0, F.lit(1.0)).otherwise(total)

        return F.aggregate(arr, init, step, finish)

    return seq.select("filename", tx.round6((run(F.col("terms")) + run(F.reverse("terms"))) / 2).alias("mtld"))
