"""K-d tree sharding by bytes.

The space is the rows' metadata, scaled to the root's range. A node of k
shards is split along its widest dimension at the weighted point that leaves
floor(k / 2) / k of its bytes on the left (for 8 shards: the weighted
median), until every leaf is one shard of about the target size. Medians are
exact: range-partitioned prefix sums of bytes per node, no sampled quantiles.

Groups of rows with equal texts move as one unit and so share a shard, as
long as the unit is small (``UNIT`` of a shard's bytes); a larger group is cut
by a hash of its ids into units that small, so a hot group can't unbalance the
shards. Coordinates of a group are the smallest of its rows' values. Ties are
ordered by a hash of the text.

Size is the text's UTF-8 bytes (null: none) plus 1, so empty and null texts
weigh 1 and count as equal. Null metadata counts as the empty value. Null ids
and repeated rows get slots like any other. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import grouped_prefix_sum
from .common import hub, join_side

UNIT = 0.002  # a unit's largest share of a shard


def spread(col):
    """A coordinate in [0, 1) for a category: its hash."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) / F.lit(2.0 ** 32)


def _split(units: DataFrame, nodes: DataFrame, dims: list[str], ranges: dict) -> tuple[DataFrame, DataFrame]:
    """One level: nodes of two and more shards are halved."""
    wide = units.groupBy("node").agg(F.sum("w").alias("bytes"), *[((F.max(d) - F.min(d)) / F.lit(ranges[d])).alias(d) for d in dims])
    top = F.greatest(*dims) if len(dims) > 1 else F.col(dims[0])
    axis = reduce(lambda c, i: c.when(F.col(dims[i]) == top, i), range(1, len(dims)), F.when(F.col(dims[0]) == top, 0))
    plan = hub(nodes.join(wide, "node").select("node", "first", "k", axis.alias("axis"), "bytes", F.floor(F.col("k") / 2).alias("left")))
    n = plan.count()
    todo = join_side(units, plan.filter("k > 1"), "node", n)
    coord = reduce(lambda c, i: c.when(F.col("axis") == i, F.col(dims[i])), range(1, len(dims)), F.when(F.col("axis") == 0, F.col(dims[0])))
    order = F.struct(coord.alias("c"), "g", "crc", "size", "part")
    run = grouped_prefix_sum(todo.withColumn("o", order), "node", "o", "w", "before")
    # A unit goes where its middle lies.
    right = (F.col("before") + F.col("w") / 2) * F.col("k") > F.col("bytes") * F.col("left")
    moved = run.withColumn("node", F.col("node") * 2 + right.cast("int")).select(*units.columns)
    done = join_side(units, plan.filter("k = 1").select("node"), "node", n).select(*units.columns)
    left = plan.filter("k > 1").select((F.col("node") * 2).alias("node"), "first", F.col("left").alias("k"))
    rest = plan.filter("k > 1").select((F.col("node") * 2 + 1).alias("node"), (F.col("first") + F.col("left")).alias("first"), (F.col("k") - F.col("left")).alias("k"))
    # A leaf keeps its shard under a number that no later node takes.
    leaf = plan.filter("k = 1").select("node", "first", "k")
    return hub(moved.unionByName(done)), hub(left.unionByName(rest).unionByName(leaf))


def kd_shards(rows: DataFrame, dims: dict, n_shards: int | None = None, target_bytes: int | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row. ``dims`` maps
    dimension names to numeric columns of ``rows``; the number of shards is
    given, or follows from ``target_bytes``.

    Texts are read once into a narrow table; each of the log2(shards) levels
    is one range shuffle of narrow units. Node tables have at most a row a
    shard and are broadcast only below a checked size.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"d{i}" for i in range(len(dims))]
    narrow = hub(rows.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("crc"), F.xxhash64(raw).alias("g"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, dims.values())]))
    total = narrow.agg(F.sum("size").alias("s")).first()["s"] or 0
    n = n_shards or max(1, math.ceil(total / target_bytes))
    key = ["g", "crc", "size"]
    most = max(1.0, UNIT * total / n)
    groups = hub(narrow.groupBy(*key).agg(F.sum("size").alias("bytes"), *[F.min(c).alias(c) for c in names])
                 .withColumn("parts", F.ceil(F.least(F.col("bytes") / most, F.col("bytes") / F.col("size"))).cast("int")))
    # Only large groups are cut; their rows are counted part by part.
    # There are at most shards / UNIT of them, so they are broadcast as a rule.
    cut = hub(groups.filter("parts > 1").select(*key, "parts", *names))
    n_cut = cut.count()
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    pieces = (join_side(narrow.select("doc_id", *key), cut, key, n_cut).withColumn("part", part)
              .groupBy(*key, "part").agg(F.sum("size").alias("w"), *[F.first(c).alias(c) for c in names]))
    units = hub(groups.filter("parts <= 1").select(*key, F.lit(0).alias("part"), F.col("bytes").alias("w"), *names)
                .unionByName(pieces).withColumn("node", F.lit(1).cast("long")))
    lim = units.agg(*[(F.max(c) - F.min(c)).alias(c) for c in names]).first()
    ranges = {c: lim[c] or 1.0 for c in names}
    spark = rows.sparkSession
    nodes = spark.createDataFrame([(1, 0, n)], "node long, first long, k long")
    for _ in range(max(0, math.ceil(math.log2(n)))):
        units, nodes = _split(units, nodes, names, ranges)
    placed = join_side(units.select(*key, "part", "node"), nodes, "node", n).select(*key, "part", F.col("first").cast("int").alias("shard"))
    parted = (join_side(narrow.select("doc_id", *key), cut.select(*key, "parts"), key, n_cut, "left")
              .withColumn("part", F.coalesce(part, F.lit(0))))
    found = parted.join(placed, [*key, "part"]).select("doc_id", "size", F.col("crc").alias("text_crc32"), "g", "shard")
    ranked = grouped_prefix_sum(found.withColumn("o", F.struct("doc_id", "g")).withColumn("one", F.lit(1)), "shard", "o", "one", "slot")
    return ranked.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
