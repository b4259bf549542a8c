"""Registered queries for I (speech timing from a timed event stream)."""

from __future__ import annotations

from ..operators import timing as tm
from ..sources.tables import read
from . import sqlparts as S
from .registry import query

r6 = S.r6

_KIND = "CASE " + " ".join(f"WHEN event_type = '{e}' THEN '{k}'" for e, k in tm.KIND_OF_EVENT) + " END"
SEG = f"""seg0 AS (SELECT user_id AS filename, ts AS start, {_KIND} AS kind,
  (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1e6 AS seconds FROM events),
seg AS (SELECT * FROM seg0 WHERE seconds IS NOT NULL AND kind IS NOT NULL)"""


def _segments(spark, sf_dir):
    return tm.segments(read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type"))


def _moments_sql():
    parts = []
    for k in tm.KINDS:
        parts.append(f"""m_{k} AS (SELECT s.filename, avg(seconds) AS mu, stddev_pop(seconds) AS sd, max(seconds) AS mx,
  min(seconds) AS mn, avg(power(seconds - a.mu0, 2)) AS m2, avg(power(seconds - a.mu0, 3)) AS m3,
  avg(power(seconds - a.mu0, 4)) AS m4 FROM seg s JOIN (SELECT filename, avg(seconds) AS mu0 FROM seg
  WHERE kind = '{k}' GROUP BY filename) a ON s.filename = a.filename WHERE kind = '{k}' GROUP BY s.filename)""")
    return ",\n".join(parts)


def _stats_select():
    cols = []
    for k in tm.KINDS:
        cols += [f"{r6(f'm_{k}.mu')} AS avgdur{k}", f"{r6(f'm_{k}.sd')} AS stddur{k}",
                 f"{r6(f'CASE WHEN m_{k}.m2 > 0 THEN m_{k}.m3 / power(m_{k}.m2, 1.5) END')} AS skwdur{k}",
                 f"{r6(f'CASE WHEN m_{k}.m2 > 0 THEN m_{k}.m4 / power(m_{k}.m2, 2) - 3 END')} AS kurtosisdur{k}",
                 f"{r6(f'm_{k}.mx')} AS maxdur{k}", f"{r6(f'm_{k}.mn')} AS mindur{k}"]
    joins = " ".join(f"LEFT JOIN m_{k} ON f.filename = m_{k}.filename" for k in tm.KINDS)
    return cols, joins


@query("i01_recording_length_summary", S.with_(SEG) + f"""
SELECT kind, count(*) AS n, {r6('avg(seconds)')} AS mean, {r6('stddev_pop(seconds)')} AS std FROM seg GROUP BY kind""")
def i01(spark, sf_dir):
    return tm.recording_length_summary(_segments(spark, sf_dir))


@query("i01_recording_lengths", S.with_(SEG) + f"""
, len AS (SELECT filename, sum(seconds) AS seconds FROM seg GROUP BY filename)
SELECT c_mktsegment AS label, count(*) AS n, {r6('avg(seconds)')} AS mean, {r6('stddev_pop(seconds)')} AS std
FROM len JOIN customer ON c_custkey = filename GROUP BY c_mktsegment""")
def i01_lengths(spark, sf_dir):
    """I01 per recording and label (a customer's segment stands for the
    folder)."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").toDF("filename", "label")
    return tm.recording_lengths(_segments(spark, sf_dir), c)


_cols, _joins = _stats_select()


@query("i02_duration_statistics", S.with_(SEG, _moments_sql()) + "SELECT f.filename, " + ", ".join(_cols)
       + " FROM (SELECT DISTINCT filename FROM seg) f " + _joins)
def i02(spark, sf_dir):
    return tm.duration_statistics(_segments(spark, sf_dir))


RATIOS = """rr AS (SELECT filename, sum(CASE WHEN kind = 'voiced' THEN seconds ELSE 0.0 END) AS v,
  sum(CASE WHEN kind = 'unvoiced' THEN seconds ELSE 0.0 END) AS u, sum(CASE WHEN kind = 'pause' THEN seconds ELSE 0.0 END) AS p,
  count_if(kind = 'voiced') AS nv, sum(seconds) AS t FROM seg GROUP BY filename)"""
RATIO_COLS = [("Vrate", "nv / nullif(t, 0)"), ("PVU", "p / nullif(v + u, 0)"), ("PU", "p / nullif(u, 0)"),
              ("UVU", "u / nullif(v + u, 0)"), ("VVU", "v / nullif(v + u, 0)"), ("VP", "v / nullif(p, 0)"),
              ("UP", "u / nullif(p, 0)")]


@query("i03_rate_ratios", S.with_(SEG, RATIOS) + "SELECT filename, "
       + ", ".join(f"{r6(e)} AS {n}" for n, e in RATIO_COLS) + " FROM rr")
def i03(spark, sf_dir):
    return tm.rate_ratios(_segments(spark, sf_dir))


@query("i04_attach_ids", S.with_(SEG, _moments_sql(), RATIOS) + "SELECT c.c_name, f.filename, "
       + ", ".join(_cols) + ", " + ", ".join(f"{r6(e)} AS {n}" for n, e in RATIO_COLS)
       + " FROM (SELECT DISTINCT filename FROM seg) f " + _joins
       + " JOIN rr ON rr.filename = f.filename JOIN customer c ON c.c_custkey = f.filename")
def i04(spark, sf_dir):
    """Timing features attached to a file list by an inner equi-join."""
    files = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    feats = tm.timing_features(_segments(spark, sf_dir))
    return feats.join(files, feats["filename"] == files["c_custkey"], "inner").drop("c_custkey")
