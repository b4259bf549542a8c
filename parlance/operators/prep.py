"""B: transcript preparation — utterances, cleaning, tokens, tag look-up.

The long ``token`` table (one row per token) is the hub every feature family
reads. It is produced by a narrow projection + ``posexplode`` (no shuffle);
tagging is a broadcast hash join against fixed closed-class tables whose size
is bounded by the literal lists in ``functions.lexicons``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.frames import cut_lineage, running


# --- utterance tables ------------------------------------------------------

def utterances_from_conversations(conv: DataFrame, roles=("user",)) -> DataFrame:
    """Transcripts from a turn table; ``filename`` = conversation id,
    ``utt_idx`` = turn order, kept roles = participant speech."""
    out = conv.select(F.col("conv_id").alias("filename"), F.col("turn").alias("utt_idx"),
                      "role", "text")
    if roles:
        out = out.filter(F.col("role").isin(list(roles)))
    return out


def utterances_from_documents(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One-text transcripts: every non-empty line of a document is an utterance."""
    lines = docs.select(F.col(id_col).alias("filename"),
                        F.posexplode(F.split(F.col(text_col), "\n")).alias("utt_idx", "text"))
    return lines.filter(F.trim("text") != "")


def clean_utterances(utts: DataFrame) -> DataFrame:
    """B03 + B05: cleaned text next to the original (both kept for B06)."""
    return utts.withColumn("clean", tx.merge_apostrophes(tx.clean_text("text")))


def join_utterances(utts: DataFrame) -> DataFrame:
    """Per transcript, each cleaned utterance plus `` ? `` or `` . ``
    (by the original's question mark) concatenated in utterance order; also
    the list and the count.

    The per-transcript list is the transcript itself (one output row per
    transcript is the feature's definition), built from sorted (idx, text)
    structs so the order never depends on shuffle order.
    """
    piece = F.concat("clean", F.lit(" "), F.when(F.col("text").contains("?"), "? ").otherwise(". "))
    parts = clean_utterances(utts).select("filename", F.struct("utt_idx", piece.alias("t")).alias("p"))
    agg = parts.groupBy("filename").agg(F.array_sort(F.collect_list("p")).alias("ps"),
                                        F.count("*").alias("n_utterances"))
    single = F.transform("ps", lambda s: s["t"])
    return agg.select("filename", F.concat(F.lit(" "), F.array_join(single, "")).alias("utterance"),
                      single.alias("single_utt"), "n_utterances")


def chunk_words(text, n: int = 50):
    """Consecutive n-word chunks of a whitespace split (no trailing empty chunk)."""
    words = F.split(F.trim(tx.col(text)), r"\s+")
    k = F.ceil(F.size(words) / F.lit(n)).cast("int")
    return F.when(F.trim(tx.col(text)) == "", F.array().cast("array<array<string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(words, i * n + 1, n)))


# --- token table -----------------------------------------------------------

def token_table(utts: DataFrame, text_col: str = "text") -> DataFrame:
    """Long token table (filename, utt_idx, tok_idx, token).

    ``posexplode`` keeps the token order inside an utterance; no shuffle.
    """
    return utts.select("filename", "utt_idx",
                       F.posexplode(tx.tokens(text_col)).alias("tok_idx", "token"))


def tag_tokens(spark: SparkSession, toks: DataFrame) -> DataFrame:
    """B16 + lemma: Penn tag, universal tag and lemma by table look-up.

    Two broadcast left joins (closed-class tags, irregular lemmas) on the
    lower-cased token, then CASE rules for everything else.
    """
    tags = lx.table(spark, lx.CLOSED_CLASS_TAGS, ["lw", "lex_tag"])
    lemmas = lx.table(spark, lx.IRREGULAR_LEMMAS, ["lw", "lex_lemma"])
    upos = lx.table(spark, lx.PENN_TO_UNIVERSAL, ["pos", "upos0"])
    t = toks.withColumn("lw", F.lower("token"))
    t = t.join(tags, "lw", "left").join(lemmas, "lw", "left")
    t = t.withColumn("pos", F.coalesce("lex_tag", tx.fallback_tag("token", "lw")))
    t = t.withColumn("lemma", F.coalesce("lex_lemma", tx.rule_lemma("lw", "pos")))
    t = t.join(upos, "pos", "left")
    u = (F.when((F.col("pos") == "IN") & F.col("lw").isin(lx.SUBORDINATORS), "SCONJ")
         .when(F.col("pos").isin(lx.VERB_TAGS) & F.col("lemma").isin(lx.AUX_LEMMAS), "AUX")
         .otherwise(F.coalesce("upos0", F.lit("X"))))
    return t.withColumn("upos", u).drop("lex_tag", "lex_lemma", "upos0")


def tag_types(spark: SparkSession, types: DataFrame, broadcast_rows: int | None = None) -> DataFrame:
    """``types``, a table with a ``token`` column, with B16's columns. The tag
    is a function of the token. With ``broadcast_rows``, ``tag_tokens`` is run
    once for each token of many rows (the commonest, at most that many), which
    are joined back by broadcast, and on the rows of the others where they
    are: for rows that are cheap to read twice. By default every row is tagged
    in place, in one pass and without an exchange."""
    if broadcast_rows is None:
        return tag_tokens(spark, types)
    often = cut_lineage(types.groupBy("token").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("_k")))
    least, held = 64, 0
    for r in often.groupBy("_k").agg(F.count("*").alias("n")).orderBy(F.desc("_k")).collect():  # a row a power of two
        held += r["n"]
        if held > broadcast_rows:
            break
        least = r["_k"]
    common = F.broadcast(cut_lineage(tag_tokens(spark, often.filter(F.col("_k") >= least).select("token"))))
    tagged = types.join(common, "token")
    return tagged.unionByName(tag_tokens(spark, types.join(common.select("token"), "token", "left_anti")).select(tagged.columns))


def words(toks: DataFrame) -> DataFrame:
    """Lower-cased alphabetic tokens."""
    return toks.filter(tx.is_word("token")).withColumn("word", F.lower("token"))


def non_stop_words(spark: SparkSession, toks: DataFrame) -> DataFrame:
    """B12 minus stop words (compared lower-cased; Quirk 3 fixed)."""
    return words(toks).join(lx.stop_words_df(spark), "word", "left_anti")


def pos_frequency(tagged: DataFrame) -> DataFrame:
    """Per utterance, map tag -> count."""
    c = tagged.groupBy("filename", "utt_idx", "pos").agg(F.count("*").alias("n"))
    return c.groupBy("filename", "utt_idx").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", "n")))).alias("pos_freq"))


def entity_mentions(spark: SparkSession, toks: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Gazetteer entities, longest match first, no overlaps.

    1..3-gram windows over the token order are equi-joined to the gazetteer
    (``gram``, ``label``; by default the fixed list, broadcast); numbers are
    CARDINAL by rule. From left to right, a match is kept unless the last
    *kept* match of the utterance covers its first token. That fold runs over
    chains of overlapping matches only: a match that begins after the end of
    all earlier ones opens a new chain.
    """
    w = Window.partitionBy("filename", "utt_idx").orderBy("tok_idx")
    lw = F.lower("token")
    g = toks.select("filename", "utt_idx", "tok_idx", "token",
                    lw.alias("g1"),
                    F.concat_ws(" ", lw, F.lower(F.lead("token", 1).over(w))).alias("g2"),
                    F.concat_ws(" ", lw, F.lower(F.lead("token", 1).over(w)),
                                F.lower(F.lead("token", 2).over(w))).alias("g3"),
                    F.lead("token", 1).over(w).isNotNull().alias("has2"),
                    F.lead("token", 2).over(w).isNotNull().alias("has3"))
    gaz = lx.table(spark, lx.GAZETTEER, ["gram", "label"]) if gazetteer is None else gazetteer.select("gram", "label")
    # One row per (start token, n-gram length): a single broadcast join for
    # all three lengths instead of one join per length.
    grams = g.select("filename", "utt_idx", "tok_idx", "token", F.explode(F.array(
        F.struct(F.lit(1).alias("n"), F.col("g1").alias("gram")),
        F.struct(F.lit(2).alias("n"), F.when(F.col("has2"), F.col("g2")).alias("gram")),
        F.struct(F.lit(3).alias("n"), F.when(F.col("has3"), F.col("g3")).alias("gram")))).alias("c"))
    grams = grams.select("filename", "utt_idx", "tok_idx", "token", "c.n", "c.gram").filter(F.col("gram").isNotNull())
    hit = grams.join(gaz, "gram", "left")
    label = F.coalesce(F.col("label"), F.when((F.col("n") == 1) & F.col("token").rlike(r"^\p{N}+$"), "CARDINAL"))
    allc = hit.select("filename", "utt_idx", "tok_idx", F.col("gram").alias("entity"), label.alias("label"),
                      "n").filter(F.col("label").isNotNull())
    # Longest match per start token.
    best = allc.withColumn("r", F.row_number().over(
        Window.partitionBy("filename", "utt_idx", "tok_idx").orderBy(F.desc("n"), "label"))).filter("r = 1")
    order = Window.partitionBy("filename", "utt_idx").orderBy("tok_idx")
    reach = F.max(F.col("tok_idx") + F.col("n") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = best.withColumn("opens", (F.col("tok_idx") > F.coalesce(reach, F.lit(-1))).cast("int"))
    chained = opens.withColumn("chain", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chained.groupBy("filename", "utt_idx", "chain").agg(
        F.array_sort(F.collect_list(F.struct("tok_idx", "entity", "label", "n"))).alias("ms"))
    init = F.struct(F.lit(-1).alias("end"), F.slice("ms", 1, 0).alias("kept"))
    kept = F.aggregate("ms", init, lambda a, m: F.when(
        m["tok_idx"] > a["end"], F.struct((m["tok_idx"] + m["n"] - 1).alias("end"), F.array_append(a["kept"], m).alias("kept"))).otherwise(a),
        lambda a: a["kept"])
    return chains.select("filename", "utt_idx", F.explode(kept).alias("m")).select("filename", "utt_idx", "m.*")


# --- CHAT files, repeat markers, transcript assembly -------------------------

def chat_lines(files: DataFrame, text_col: str = "text", key: str = "filename") -> DataFrame:
    """(filename, line_no, line) from whole CHAT files."""
    return files.select(key, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def chat_tiers(lines: DataFrame, key: str = "filename") -> DataFrame:
    """B01 (Quirk 1 fixed, built from the tier rules): a ``*XXX:`` line opens
    an utterance group that collects the following ``%mor`` and ``%gra``
    tiers and tab-indented continuation lines until the next speaker or
    ``@End``. One row per utterance: speaker, text, mor, gra.

    Group ids are a running sum of group starts over each file's lines, and a
    continuation line has the kind of the last tagged line: one segmented scan
    over range partitions of (file, line), so a file of a third of all lines
    is read by many tasks. The per-group strings are ordered (line_no, text)
    lists — bounded by one utterance.
    """
    ln = F.col("line")
    speaker = ln.rlike(r"^\*[A-Za-z]+:")
    end = ln.startswith("@End")
    # ``@End`` ends the file: later lines are ignored.
    last = lines.filter(end).groupBy(F.col(key).alias("_f")).agg(F.min("line_no").alias("_end"))
    t = lines.join(last, F.col(key).eqNullSafe(F.col("_f")), "left").filter(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    kind = (F.when(speaker, "text").when(ln.startswith("%mor:"), "mor").when(ln.startswith("%gra:"), "gra")
            .when(ln.startswith("@") | ln.startswith("%"), "other"))
    t = t.select(key, "line_no", "line", speaker.cast("int").alias("start"), kind.alias("kind0"))
    t = running(t, ["line_no"], key, sums={"grp": "start"}, lasts={"kind": "kind0"})
    body = F.regexp_replace(F.regexp_replace(ln, r"^[*%][A-Za-z]+:", ""), r"^\s+|\s+$", "")
    t = t.withColumn("body", body).withColumn("spk", F.regexp_extract(ln, r"^\*([A-Za-z]+):", 1))
    t = t.filter(F.col("grp") > 0)

    def joined(k):
        parts = F.collect_list(F.when(F.col("kind") == k, F.struct("line_no", "body")))
        return F.array_join(F.transform(F.array_sort(parts), lambda s: s["body"]), " ")

    g = t.groupBy(key, "grp").agg(F.max(F.when(F.col("spk") != "", F.col("spk"))).alias("speaker"),
                                  joined("text").alias("text"), joined("mor").alias("mor"),
                                  joined("gra").alias("gra"))
    return g.filter(F.col("speaker").isNotNull()).withColumnRenamed("grp", "utt_idx")


REPEAT_RE = r"\[x ?\d+\]|\S+"


def resolve_repeats(text) -> "F.Column":
    """``word [x N]`` → the word N times (Quirk 1: the reference's helper
    is undefined; this is the documented meaning)."""
    toks = F.regexp_extract_all(tx.col(text), F.lit(REPEAT_RE), 0)
    n = F.size(toks)

    def piece(t, i):
        nxt = F.when(i + 1 < n, F.element_at(toks, i + 2))
        times = F.regexp_extract(nxt, r"^\[x ?(\d+)\]$", 1)
        is_marker = t.rlike(r"^\[x ?\d+\]$")
        return (F.when(is_marker, F.array().cast("array<string>"))
                .when(F.coalesce(times, F.lit("")) != "", F.array_repeat(t, times.cast("int")))
                .otherwise(F.array(t)))

    return F.array_join(F.flatten(F.transform(toks, piece)), " ")


def assemble_transcripts(pages: DataFrame, cohort: DataFrame, must_contain=("example", "page=")) -> DataFrame:
    """B07 (Quirk 2 fixed): pages whose name holds every token, the first
    page per transcript id, a label from the path (language ≠ en), and a
    diagnosis look-up by id (first match) in the cohort table."""
    p = pages
    for tok in must_contain:
        p = p.filter(F.col("url").contains(tok))
    p = p.select("page_id", F.regexp_extract("url", r"/([a-z]{2})/\d+", 1).alias("lang"),
                 F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1).try_cast("bigint").alias("id"))
    p = p.filter(F.col("id").isNotNull())
    first = p.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("page_id"))).filter("_r = 1")
    coh = cohort.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("source"))).filter("_r = 1")
    return first.select("id", "page_id", (F.col("lang") != "en").cast("int").alias("label")).join(
        coh.select("id", "source"), "id", "left")
