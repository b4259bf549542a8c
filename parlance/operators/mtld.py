"""MTLD of transcripts of any length.

A run cuts the text into factors: a factor ends at the first token at which
types / tokens falls to the threshold, and the next one starts behind it. The
cuts depend on each other, but where a factor that starts at s would end does
not depend on how s was reached. So every block of positions works out the end
for each of its starts (types grow at positions whose term last stood before
s), follows the ends inside the block, and says where the run leaves the block
and how many factors it passed. The blocks' answers are then chained by
pointer jumping: each round doubles the stretch that an answer covers, so a
transcript of m blocks takes log2(m) rounds of joins.

A block sees one block further; a factor longer than that (a text of almost
only new words) is searched by itself with distributed sums of first
occurrences. No task holds more than two blocks of a transcript.

Transcripts of at most one block are folded as one array each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.frames import cut_lineage, grouped_prefix_sum

BLOCK = 4096
GOES_ON, ENDED, STUCK = 0, 1, 2


def factor_ends(terms: np.ndarray, starts: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For starts 0 .. ``starts`` - 1: the last position of the factor (-1:
    the terms run out before) and the types seen by then."""
    code = pd.factorize(terms)[0]
    order = np.argsort(code, kind="stable")
    before = np.full(len(code), -1)
    same = code[order[1:]] == code[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    end, types, alive, n = np.full(starts, -1), np.zeros(starts, np.int64), np.arange(starts), 0
    while len(alive):
        alive = alive[alive + n < len(code)]
        types[alive] += before[alive + n] < alive
        n += 1
        done = types[alive] / n <= threshold
        end[alive[done]] = alive[done] + n - 1
        alive = alive[~done]
    return end, types


def _block_jumps(terms: np.ndarray, first: int, own: int, last: bool, threshold: float) -> pd.DataFrame:
    """Where runs that start in a block (positions ``first`` ...) leave it."""
    end, types = factor_ends(terms, own, threshold)
    n = len(terms)
    kind, to, passed, tail_n, tail_types = (np.zeros(own, np.int64) for _ in range(5))
    for s in range(own - 1, -1, -1):
        nxt = end[s] + 1
        if end[s] < 0:
            kind[s], to[s] = (ENDED, first + n) if last else (STUCK, first + s)
            tail_n[s], tail_types[s] = n - s, types[s]
        elif nxt < own:
            kind[s], to[s], passed[s], tail_n[s], tail_types[s] = kind[nxt], to[nxt], passed[nxt] + 1, tail_n[nxt], tail_types[nxt]
        else:
            kind[s], to[s], passed[s] = ENDED if last and nxt == n else GOES_ON, first + nxt, 1
    return pd.DataFrame({"s": first + np.arange(own), "kind": kind, "to": to, "factors": passed, "tail_n": tail_n, "tail_types": tail_types})


JUMP = "s long, kind long, to long, factors long, tail_n long, tail_types long"


def _jumps(turned: DataFrame, block: int, threshold: float) -> DataFrame:
    """(key, s, kind, to, factors, tail_n, tail_types) of every position."""
    b = F.floor(F.col("p") / block)
    own = turned.withColumn("_b", b)
    ahead = turned.filter(F.col("p") >= block).withColumn("_b", b - 1)
    name = turned.schema["filename"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        first, n = int(pdf["_b"].iloc[0]) * block, int(pdf["N"].iloc[0])
        out = _block_jumps(pdf["term"].to_numpy(), first, min(block, n - first), first + len(pdf) == n, threshold)
        return out.assign(filename=pdf["filename"].iloc[0], back=pdf["back"].iloc[0])

    return own.unionByName(ahead).groupBy("filename", "back", "_b").applyInPandas(run, f"filename {name}, back int, {JUMP}")


def _follow(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows that go on, moved on by the table's answer for where they are."""
    t = table.select("filename", "back", F.col("s").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("kind", "to", "factors", "tail_n", "tail_types")])
    go = F.col("kind") == GOES_ON
    j = rows.filter(go).join(t, ["filename", "back", "to"])
    moved = j.select(*[F.col(f"_{c}").alias(c) if c in ("kind", "to", "tail_n", "tail_types")
                       else (F.col("factors") + F.col("_factors")).alias(c) if c == "factors" else F.col(c) for c in rows.columns])
    return rows.filter(~go).unionByName(moved)


def _count(rows: DataFrame, kind: int) -> int:
    return rows.filter(F.col("kind") == kind).count()


def _long_factor(turned: DataFrame, stuck: DataFrame, threshold: float) -> DataFrame:
    """(filename, back, end, types, seen) of the factor that starts at each stuck
    position: ``end`` null where the transcript ends first."""
    at = stuck.select("filename", "back", F.col("to").alias("_s"))
    rows = turned.join(at, ["filename", "back"]).filter(F.col("p") >= F.col("_s"))
    first = rows.groupBy("filename", "back", "term").agg(F.min("p").alias("p")).withColumn("_new", F.lit(1)).drop("term")
    seen = rows.drop("term").join(first, ["filename", "back", "p"], "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    seen = grouped_prefix_sum(seen.withColumn("_key", F.struct("filename", "back")), "_key", "p", "_new", "_before")
    types, n = F.col("_before") + F.col("_new"), F.col("p") - F.col("_s") + 1
    return seen.groupBy("filename", "back").agg(F.min(F.when(types / n <= threshold, F.col("p"))).alias("end"),
                                                F.max(types).alias("types"), F.max(n).alias("seen"))


def long_runs(rich: DataFrame, lengths: DataFrame, threshold: float, block: int) -> DataFrame:
    """(filename, back, N, factors, tail_n, tail_types): both runs of every
    transcript of ``lengths`` (filename, N)."""
    t = rich.select("filename", "pos", "term").join(lengths, "filename")
    turned = cut_lineage(t.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "filename", "back", "N", F.when(F.col("back") == 0, F.col("pos")).otherwise(F.col("N") - 1 - F.col("pos")).alias("p"), "term"))
    jump = cut_lineage(_jumps(turned, block, threshold))
    # Only positions where a run enters a block can be reached from another.
    entered = jump.filter(F.col("kind") == GOES_ON).select("filename", "back", F.col("to").alias("s")).distinct()
    chain = cut_lineage(jump.join(entered, ["filename", "back", "s"]))
    while _count(chain, GOES_ON):
        chain = cut_lineage(_follow(chain, chain))
    run = cut_lineage(_follow(jump.filter("s = 0"), chain))
    done = run.filter(F.col("kind") == ENDED)
    run = run.filter(F.col("kind") == STUCK)
    while run.count():
        found = run.select("filename", "back", "to", F.col("factors").alias("_f")).join(
            cut_lineage(_long_factor(turned, run, threshold)), ["filename", "back"]).join(lengths, "filename")
        over = F.col("end").isNull()
        last = found.filter(over | (F.col("end") + 1 == F.col("N")))
        done = done.unionByName(last.select(
            "filename", "back", F.lit(0).cast("long").alias("s"), F.lit(ENDED).cast("long").alias("kind"), F.col("N").alias("to"),
            (F.col("_f") + F.when(over, 0).otherwise(1)).alias("factors"), F.when(over, F.col("seen")).otherwise(0).alias("tail_n"),
            F.when(over, F.col("types")).otherwise(0).alias("tail_types")))
        more = found.filter(~over & (F.col("end") + 1 < F.col("N"))).select("filename", "back", "_f", (F.col("end") + 1).alias("s"))
        begun = jump.join(more, ["filename", "back", "s"]).withColumn("factors", F.col("factors") + F.col("_f") + 1).drop("_f")
        run = cut_lineage(_follow(begun, chain))
        done, run = done.unionByName(run.filter(F.col("kind") == ENDED)), run.filter(F.col("kind") == STUCK)
    return done.join(lengths, "filename")


def mtld(rich: DataFrame, threshold: float = 0.72, block: int = BLOCK) -> DataFrame:
    """MTLD, forward and reversed, averaged."""
    from .lexical import mtld_arrays
    rich = cut_lineage(rich.select("filename", "pos", "term"))
    lengths = rich.groupBy("filename").agg(F.count("*").alias("N")).filter(F.col("N") > block)
    lengths = cut_lineage(lengths)
    if lengths.isEmpty():
        return mtld_arrays(rich, threshold)
    runs = long_runs(rich, lengths, threshold, block)
    partial = F.when(F.col("tail_n") > 0, (1 - F.col("tail_types") / F.col("tail_n")) / (1 - threshold)).otherwise(0.0)
    total = F.col("factors") + partial
    # No factor and no partial factor: every term distinct -> one factor.
    value = F.col("N") / F.when(total == 0, F.lit(1.0)).otherwise(total)
    long = runs.groupBy("filename").agg(tx.round6(F.avg(value)).alias("mtld"))
    return mtld_arrays(rich.join(lengths, "filename", "left_anti"), threshold).unionByName(long)
