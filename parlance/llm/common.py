"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from ..session import ensure_checkpoint_dir

# Above this many rows a side table is joined by shuffle, not by broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/")


def hub(df: DataFrame) -> DataFrame:
    """Cut the lineage by a parquet table in the shared checkpoint folder."""
    return cut_lineage(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that ``df`` does not use yet."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def join_side(df: DataFrame, side: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """Join a side table of a known row count: broadcast up to
    ``BROADCAST_ROWS`` narrow rows, a shuffle join beyond."""
    return df.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, on, how)


def partition_bases(counts: DataFrame, part: str, n: str, base: str) -> DataFrame:
    """Exclusive prefix sum of ``n`` over partitions; one row a partition."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))


def fold(label: str, mod: int):
    """crc32 of an id written as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(label).cast("string").cast("binary")) % mod


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v longs): returns (node, comp)
    with ``comp`` the smallest node reachable, a row for each node that has
    an edge to another node.

    Alternating large-star and small-star rounds: every round is a grouped
    minimum (combined before the shuffle) and a join that adaptive execution
    can split at a hub node; each round is written to the shared folder, so
    a lost executor costs one round. Nothing but two sums reaches the driver.
    """
    def neighbours(e):
        return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(sym, keep):
        low = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return sym.filter(keep).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def mark(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = hub(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .filter("u <> v").distinct())
    last = mark(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        # Large star: every larger neighbour of u hangs on u's smallest one.
        large = star(neighbours(e), F.col("v") > F.col("u")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours hang on the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        e = hub(small.distinct())
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    return (e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))


def local_path(uri: str) -> str | None:
    """The POSIX path of a ``file:`` URI or bare path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return uri if uri.startswith("/") else None


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder that all executors share."""
    from pyarrow import fs
    local = local_path(uri)
    return (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(uri)


def quiet_threads() -> None:
    """One thread a Python worker: Spark's tasks are the parallelism."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
