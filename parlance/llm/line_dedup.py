"""Line deduplication: lines found in many documents are dropped from all but
one of them.

A text is split at \\n. A line's key is the line without the characters
``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased. Keys of at least
``min_chars`` code points that stand in at least ``min_docs`` documents lose
all their lines, except in the document with the largest id that holds them;
there every repeat stays. All other lines stay as they are, in their order.

Keys are exploded, hashed to 128 bits and counted by distinct document: the
count is combined per (key, document) before the shuffle and once more per
key, so a line that a third of all documents hold is counted by many tasks.
The frequent keys are joined back to the hashed lines, the dropped positions
are gathered per document, and each text is put together again from the runs
between them, in time linear in its lines. Both joins broadcast their small
side only below a counted bound and go by shuffle beyond it.

Defined results: null and empty texts are one empty line. Rows with one
doc_id are one document for the count, and each is returned. A null doc_id is
one document, smaller than all others. Empty tables give an empty result.
Columns of any name are returned unchanged beside the text; the counts get a
trailing underscore where their name is taken.

DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, hub

MIN_CHARS = 40
MIN_DOCS = 5
SPACES = " \t\n\x0b\x0c\r"
# Dropped positions that may be broadcast (4 bytes each).
BROADCAST_POSITIONS = 1_000_000


def line_key(line: Column) -> Column:
    """The line with only A-Z lower-cased and blanks stripped at both ends."""
    plain = F.octet_length(line) == F.char_length(line)
    low = F.when(plain, F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))
    return F.btrim(low, F.lit(SPACES))


def _keyed_lines(base: DataFrame, min_chars: int) -> DataFrame:
    """(id, t1, t2, pos, h1, h2) of the lines whose key is long enough."""
    lines = (base.select("id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .filter(F.octet_length("line") >= min_chars)  # a key is no longer than its line
             .select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
             .filter(F.char_length("key") >= min_chars))
    return lines.select("id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def without(text: Column, positions: Column) -> Column:
    """``text`` without the lines at the sorted ``positions``: the runs of
    lines between them, joined again."""
    def keep(s):
        last = F.size(s["drop"])
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(s["drop"], k - 1) + 1)
        end = lambda k: F.when(k == last, F.size(s["lines"])).otherwise(F.get(s["drop"], k))
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(s["lines"], start(k) + 1, end(k) - start(k)))
        return F.array_join(F.flatten(runs), "\n")
    # One struct, so that the text is split once and not once a run.
    return F.get(F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), positions.alias("drop"))), keep), 0)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS,
                broadcast_positions: int = BROADCAST_POSITIONS) -> DataFrame:
    """``docs`` with the kept text, and (n_lines long, n_dropped long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    lines = _keyed_lines(base, min_chars)
    # Without a document of a null id the second maximum is 0 everywhere.
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max(F.col("id").isNull().cast("int")).alias("none"),
                                            F.max("id").alias("last"))
    hot = hub(counted.filter(F.col("n") + F.col("none") >= min_docs).select("h1", "h2", "last"))
    drops = hub(lines.join(F.broadcast(hot) if hot.count() <= broadcast_rows else hot, ["h1", "h2"])
                .filter(~F.col("id").eqNullSafe(F.col("last")))
                .groupBy("id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("drop")))
    total = drops.agg(F.sum(F.size("drop"))).first()[0] or 0
    side = drops.select(*[F.col(c).alias(f"d_{c}") for c in ("id", "t1", "t2")], "drop")
    on = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("t1") == F.col("d_t1")) & (F.col("t2") == F.col("d_t2"))
    found = base.join(F.broadcast(side) if total <= broadcast_positions else side, on, "left")
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("drop")))
    return found.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns],
                        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias(n_lines),
                        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(n_dropped))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, k.pos, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.last AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
