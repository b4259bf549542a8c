"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds short benchmark items inside long documents: an item matches a document
when at least ``threshold`` of its distinct word shingles occur in it. Both
sides are partitioned by size. Items are grouped by the number n of their
shingles; a partition's items keep the m smallest hashes of their shingles
(a bottom-m MinHash sketch) with m = n - ceil(threshold * n) + 1: a document
that holds threshold * n shingles can miss at most m - 1 of any m, so it holds
at least one sketch value. Comparing the item's sketch with the whole shingle
set of the document, instead of two sketches, is what keeps a 20-shingle item
findable in a 20,000-word document. A document is only searched for items of
size partitions it can hold (threshold * n at most its number of shingles).
Candidates are verified by exact shingle containment.

Words are the runs of characters other than \\x20 and \\x09-\\x0D, lower-
cased; shingles are ``shingle`` consecutive words. A text with fewer words is
one shingle, its whole word sequence; an item without words matches nothing,
and short items match documents whose whole sequence equals theirs or that
hold it as consecutive words. Null texts count as empty. Items with equal
shingles are searched once and reported each; repeated rows are reported
each by id. Empty tables give an empty result; extra columns are ignored.

DataFrame functions only. The benchmark side is broadcast only when its
sketch is small (``BROADCAST_ROWS``), and joined by shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hub, join_side

SHINGLE = 5
THRESHOLD = 0.8


def words(text) -> Column:
    """Array of words of a text column (empty for null)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    """Distinct n-word shingles of a word array (none for shorter arrays)."""
    # Element access is constant time; slice() would copy the array each time.
    def gram(i):
        return F.concat_ws(" ", *(F.get(w, i + k) for k in range(n)))
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n))
    return F.array_distinct(F.coalesce(F.transform(at, gram), F.array().cast("array<string>")))


def item_shingles(items: DataFrame, item_col: str, text_col: str, shingle: int) -> DataFrame:
    """(item, width, shingles): distinct shingles; short items in one."""
    w = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    return w.select("item", F.least(F.size("w"), F.lit(shingle)).alias("width"),
                    F.when(F.size("w") >= shingle, grams(F.col("w"), shingle))
                    .otherwise(F.array(F.array_join("w", " "))).alias("g"))


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every document
    and item with containment >= threshold.

    One pass over the texts: shingles are exploded beside their hash and
    joined at once with the items' shingles (flagged if in the sketch), so
    only shingles that some item has leave the task; they are counted per
    document and item with a combined aggregate.
    """
    sets = item_shingles(items, item_col, item_text, shingle)
    # Items with equal shingle sets are one class.
    cls = hub(sets.select("item", "width", F.array_sort("g").alias("g"))
              .groupBy("width", "g").agg(F.collect_list("item").alias("items"))
              .withColumn("cls", F.xxhash64("g", "width")))
    need = F.ceil(F.lit(threshold) * F.size("g") - 1e-9)
    sized = cls.select("cls", "width", F.size("g").alias("n"), need.alias("need"), F.array_sort(F.transform("g", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))).alias("hs"))
    sketch = hub(sized.select("cls", "width", "n", "need", F.posexplode("hs").alias("at", "x"))
                 .select("cls", "width", "n", "need", F.col("x.s").alias("s"),
                         (F.col("at") <= F.col("n") - F.col("need")).alias("in_sketch")))
    rows = sketch.count()
    widths = sorted(r["width"] for r in sketch.select("width").distinct().toLocalIterator())
    base = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    found = None
    for width in widths or [shingle]:
        mine = sketch.filter(F.col("width") == width).drop("width")
        # Several rows of a shingle (one a class) are one list: the join stays one to one.
        lists = mine.groupBy("s").agg(F.collect_list(F.struct("cls", "n", "need", "in_sketch")).alias("c"))
        # The size is taken before the explode, else every row would carry the array.
        texts = (base.select("doc_id", grams(F.col("w"), width).alias("g"))
                 .select("doc_id", F.size("g").alias("size"), F.monotonically_increasing_id().alias("row"), "g")
                 .select("doc_id", "size", "row", F.explode("g").alias("s")))
        hits = (join_side(texts, lists, "s", rows)
                .select("row", "doc_id", "size", F.explode("c").alias("c"))
                .filter(F.col("size") >= F.col("c.need"))
                .groupBy("row", F.col("c.cls").alias("cls"), F.col("c.n").alias("n"), F.col("c.need").alias("need"))
                .agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_shared"), F.max("c.in_sketch").alias("candidate"))
                .filter("candidate and n_shared >= need")
                .select("doc_id", "cls", "n", "n_shared"))
        found = hits if found is None else found.unionByName(hits)
    named = cls.select("cls", "items")
    return (join_side(found, named, "cls", rows)
            .select("doc_id", F.explode("items").alias("item_id"), F.col("n_shared").cast("long").alias("n_shared"),
                    F.col("n").cast("long").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment")))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose id holds a benchmark item. A null id is
    an id like another: if one such row matches, all rows without id go."""
    (bad,) = fresh(docs, "contaminated_id")
    found = hub(contaminated(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(bad)).distinct())
    return docs.join(found, docs[id_col].eqNullSafe(F.col(bad)), "left_anti")


ORACLE = """
WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) >= 5),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM d WHERE len(w) >= 5),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM shingles JOIN items USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n::DOUBLE AS containment
FROM hits JOIN sizes USING (item_id) WHERE n_shared >= ceil(0.8 * n - 1e-9)
"""
