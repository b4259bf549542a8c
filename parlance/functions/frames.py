"""Lineage control for hub tables read by several downstream plans."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_WRITTEN: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder named by
    ``spark.checkpoint.dir`` and return a DataFrame reading it back.

    Used for hub tables (tokens, terms, tree nodes, the labelled feature
    table) that feed several branches of one plan: without it every branch
    re-runs the tokeniser, and a lost executor would re-run the whole chain.
    The table lives on the shared file system, so later stages survive
    executor loss; reads are columnar and column-pruned. Tables written by
    this process are removed when it exits.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/parlance-hub-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.parquet(path)


@atexit.register
def _drop_written() -> None:
    import shutil
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may already be gone at exit
            local = path[len("file:"):] if path.startswith("file:") else path
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)


def global_rank(df: DataFrame, key, partitions: int | None = None, out_col: str = "rank") -> DataFrame:
    """Exact 0-based rank of every row by ``key`` without a single-task
    window: range-partition by the key, count rows per partition (one row
    per partition comes back as offsets), then number rows inside each
    partition."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    keys = [key] if isinstance(key, str) else list(key)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Materialised once so that both uses see the same range boundaries.
    r = cut_lineage(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))
    counts = r.groupBy("_pid").agg(F.count("*").alias("_c"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy("_pid").orderBy(*keys)) - 1
    return (r.withColumn("_in", within).join(F.broadcast(offs), "_pid")
            .withColumn(out_col, F.col("_off") + F.col("_in")).drop("_pid", "_in", "_off"))


def grouped_prefix_sum(df: DataFrame, group: str, order: str, value: str, out_col: str = "before",
                       partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` within each ``group`` in ``order``,
    without a one-task window per group: range-partition by (group, order),
    take running sums inside each partition, and add the totals of the same
    group from earlier partitions (a table of partitions × groups present,
    small). A group holding a third of all rows is summed by many tasks."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut_lineage(df.repartitionByRange(n, group, order).withColumn("_pid", F.spark_partition_id()))
    local = F.coalesce(F.sum(value).over(Window.partitionBy("_pid", group).orderBy(order)
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tot = r.groupBy(group, "_pid").agg(F.sum(value).alias("_t"))
    prev = tot.withColumn("_prev", F.coalesce(F.sum("_t").over(
        Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    return (r.withColumn("_loc", local).join(prev, [group, "_pid"])
            .withColumn(out_col, F.col("_prev") + F.col("_loc")).drop("_pid", "_loc", "_prev"))


def running(df: DataFrame, order: list[str], group: str | None = None, sums: dict[str, str] | None = None,
            lasts: dict[str, str] | None = None, earlier: dict[str, str] | None = None,
            partitions: int | None = None) -> DataFrame:
    """``df`` with running columns along ``order`` (unique within a ``group``):
    ``sums`` (output: column) are inclusive sums, ``lasts`` the last non-null
    value at or before the row, ``earlier`` the last non-null one before it.

    A segmented scan without a one-task window: range-partition by the order,
    scan inside each partition, and hand the sums and last values of the
    earlier partitions on (a table of partitions × groups present, small). One
    group, or one value, may hold all rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    sums, lasts, earlier, g = sums or {}, lasts or {}, earlier or {}, [group] if group else []
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut_lineage(df.repartitionByRange(n, *g, *order).withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", *g).orderBy(*order)
    upto, until = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    tail = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))) for c in {*lasts.values(), *earlier.values()}}
    ends = r.groupBy(*g, "_pid").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()], *[x.alias(f"_l_{c}") for c, x in tail.items()])
    prev = ends.select(*[F.col(c).alias(f"_g_{c}") for c in [*g, "_pid"]],
                       *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_p_{o}") for o in sums],
                       *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_q_{c}") for c in tail])
    scanned = r.withColumns({f"_r_{o}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for o, c in sums.items()}
                            | {f"_r_{o}": F.last(c, ignorenulls=True).over(w) for d, w in ((lasts, upto), (earlier, until)) for o, c in d.items()})
    on = F.col("_pid") == F.col("_g__pid")
    if group:
        on = on & F.col(group).eqNullSafe(F.col(f"_g_{group}"))
    return scanned.join(prev, on, "left").select(
        *df.columns, *[(F.col(f"_p_{o}") + F.col(f"_r_{o}")).alias(o) for o in sums],
        *[F.coalesce(f"_r_{o}", f"_q_{c}").alias(o) for d in (lasts, earlier) for o, c in d.items()])


def carry_last(df: DataFrame, order: list[str], value: str, out_col: str, group: str | None = None,
               partitions: int | None = None) -> DataFrame:
    """The last non-null ``value`` at or before each row (see ``running``)."""
    return running(df, order, group, lasts={out_col: value}, partitions=partitions)


def permuted(rank, n: int, seed: int):
    """The place of rank 0 .. n - 1 in a permutation keyed by ``seed``: a
    bijection of the ranks, so rows are shuffled without a sort and two tables
    with the same ranks alike, whatever the partitions.

    The ranks are cells of an a × b grid of barely n cells; each of six rounds
    adds a hash of one coordinate to the other (a Feistel network on sums). A
    rank that lands beyond n goes through again until it does not; fewer than
    a cells lie there, so that ends."""
    from pyspark.sql import functions as F
    a = max(1, int(n ** 0.5))
    b = -(-n // a)

    def mixed(k, x, size):
        return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:{k}:"), x.cast("string"))), F.lit(1), F.lit(13)), 16, 10).cast("bigint") % size

    def once(x):
        cell = F.struct(F.floor(x / b).alias("l"), (x % b).alias("r"))
        for k in range(0, 6, 2):  # a struct a turn, so that each is worked out once
            cell = F.get(F.transform(F.array(cell), lambda c: F.struct(((c["l"] + mixed(k, c["r"], a)) % a).alias("l"), c["r"].alias("r"))), 0)
            cell = F.get(F.transform(F.array(cell), lambda c: F.struct(c["l"].alias("l"), ((c["r"] + mixed(k + 1, c["l"], b)) % b).alias("r"))), 0)
        return F.get(F.transform(F.array(cell), lambda c: c["l"] * b + c["r"]), 0)

    first = once(rank.cast("bigint"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(a, 64))), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(F.lit(n > 1), walk).otherwise(F.lit(0).cast("bigint"))
