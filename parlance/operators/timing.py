"""I: speech-timing tables (re-aimed from audio).

A segment table comes from a timed event stream: per recording, each event
lasts until the next one (``lead(ts) - ts``); its type gives the segment kind
(voiced / unvoiced / pause). The window is keyed by recording; statistics are
grouped aggregates and a fixed-list conditional pivot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Fixed mapping of event types to segment kinds.
KIND_OF_EVENT = [("view", "voiced"), ("click", "voiced"), ("signup", "unvoiced"),
                 ("purchase", "unvoiced"), ("error", "pause")]
KINDS = ["voiced", "unvoiced", "pause"]
STATS = ["avg", "std", "skw", "kurtosis", "max", "min"]


def kind_expr(col="event_type"):
    e = None
    for ev, kind in KIND_OF_EVENT:
        e = (F.when(F.col(col) == ev, kind) if e is None else e.when(F.col(col) == ev, kind))
    return e


def segments(events: DataFrame, rec_col="user_id", ts_col="ts", type_col="event_type",
             bucket: str = "hour") -> DataFrame:
    """(filename, start, seconds, kind); each event lasts until the next event
    of its recording, the last event yields no segment.

    Skew-safe ``lead``: events are windowed per (recording, time bucket), so a
    recording holding a third of all events still spreads over many tasks;
    the last event of a bucket takes the first event of the recording's next
    non-empty bucket from a per-bucket table (one row per recording and
    bucket).
    """
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))  # naive timestamps read as UTC
    e = events.select(F.col(rec_col).alias("filename"), F.col(ts_col).alias("start"), us.alias("us"),
                      F.col("event_id").alias("eid"), kind_expr(type_col).alias("kind"),
                      F.date_trunc(bucket, F.col(ts_col).cast("timestamp")).alias("bk"))
    w = Window.partitionBy("filename", "bk").orderBy("us", "eid")
    e = e.withColumn("nxt", F.lead("us").over(w))
    firsts = e.groupBy("filename", "bk").agg(F.min(F.struct("us", "eid"))["us"].alias("first_us"))
    firsts = firsts.withColumn("next_first", F.lead("first_us").over(Window.partitionBy("filename").orderBy("bk")))
    e = e.join(firsts.select("filename", "bk", "next_first"), ["filename", "bk"])
    seg = e.select("filename", "start", ((F.coalesce("nxt", "next_first") - F.col("us")) / 1e6).alias("seconds"),
                   "kind")
    return seg.filter(F.col("seconds").isNotNull() & F.col("kind").isNotNull())


def recording_length_summary(seg: DataFrame, by: str = "kind") -> DataFrame:
    """Count, mean and population std of segment seconds per group."""
    return seg.groupBy(by).agg(F.count("*").alias("n"), tx.round6(F.avg("seconds")).alias("mean"),
                               tx.round6(F.stddev_pop("seconds")).alias("std"))


def recording_lengths(seg: DataFrame, labels: DataFrame, by: str = "label") -> DataFrame:
    """Number, mean and population std of the recordings' lengths per
    label; ``labels`` holds (filename, label). Recordings without a label are
    left out."""
    length = seg.groupBy("filename").agg(F.sum("seconds").alias("seconds"))
    return recording_length_summary(length.join(labels, "filename"), by)


def duration_statistics(seg: DataFrame) -> DataFrame:
    """Avg, std, skewness, kurtosis, max, min of durations per kind
    (18 columns; population moments, null when the variance is 0)."""
    aggs = []
    for k in KINDS:
        x = F.when(F.col("kind") == k, F.col("seconds"))
        var = F.var_pop(x)
        aggs += [tx.round6(F.avg(x)).alias(f"avgdur{k}"), tx.round6(F.stddev_pop(x)).alias(f"stddur{k}"),
                 tx.round6(F.when(var > 0, F.skewness(x))).alias(f"skwdur{k}"),
                 tx.round6(F.when(var > 0, F.kurtosis(x))).alias(f"kurtosisdur{k}"),
                 tx.round6(F.max(x)).alias(f"maxdur{k}"), tx.round6(F.min(x)).alias(f"mindur{k}")]
    return seg.groupBy("filename").agg(*aggs)


def rate_ratios(seg: DataFrame) -> DataFrame:
    """Voiced rate and the duration ratios between kinds."""
    def total(k):
        return F.sum(F.when(F.col("kind") == k, F.col("seconds")).otherwise(0.0))
    g = seg.groupBy("filename").agg(total("voiced").alias("v"), total("unvoiced").alias("u"),
                                    total("pause").alias("p"), F.count_if(F.col("kind") == "voiced").alias("nv"),
                                    F.sum("seconds").alias("t"))
    d = tx.safe_div
    return g.select("filename",
                    tx.round6(d("nv", "t")).alias("Vrate"),
                    tx.round6(d("p", F.col("v") + F.col("u"))).alias("PVU"),
                    tx.round6(d("p", "u")).alias("PU"),
                    tx.round6(d("u", F.col("v") + F.col("u"))).alias("UVU"),
                    tx.round6(d("v", F.col("v") + F.col("u"))).alias("VVU"),
                    tx.round6(d("v", "p")).alias("VP"),
                    tx.round6(d("u", "p")).alias("UP"))


def timing_features(seg: DataFrame) -> DataFrame:
    """The 25 timing columns (I02 + I03 without the counts) per recording."""
    return duration_statistics(seg).join(rate_ratios(seg), "filename")
