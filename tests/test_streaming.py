"""A11 streaming form: a second run over the same files adds nothing; new
files are picked up by the next run; a replayed batch replaces itself."""

import os
import tempfile

from pyspark.sql import functions as F

from parlance.operators import lexical, prep
from parlance.streaming.ledger import process_new_files, read_profile, write_batch

from .conftest import SF_SMALL


def test_available_now_is_incremental(spark):
    base = tempfile.mkdtemp(prefix="parlance-stream-", dir="/tmp")
    src, out, ck = (os.path.join(base, p) for p in ("in", "out", "ck"))
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    conv.filter("conv_id < 5").write.parquet(os.path.join(src, "part1"))
    assert process_new_files(spark, src + "/*", out, ck) >= 1
    first = read_profile(spark, out).count()
    assert first > 0
    assert process_new_files(spark, src + "/*", out, ck) == 0
    assert read_profile(spark, out).count() == first
    conv.filter("conv_id >= 5").write.parquet(os.path.join(src, "part2"))
    process_new_files(spark, src + "/*", out, ck)
    total = read_profile(spark, out)
    n_conv = conv.filter("role = 'user'").select("conv_id").distinct().count()
    assert total.count() == n_conv
    assert total.select(F.count_distinct("filename")).first()[0] == n_conv


def test_replayed_and_split_batches_count_once(spark):
    out = tempfile.mkdtemp(prefix="parlance-stream-", dir="/tmp") + "/out"
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    # Turns of one conversation arrive in two batches; the first is replayed.
    for batch_id, part in ((0, "turn % 4 < 2"), (1, "turn % 4 >= 2"), (0, "turn % 4 < 2")):
        write_batch(conv.filter(part), batch_id, out)
    got = {r["filename"]: r.asDict() for r in read_profile(spark, out).collect()}
    utts = prep.utterances_from_conversations(conv)
    want = (utts.groupBy("filename").agg(F.count("*").alias("n_utterances"))
            .join(lexical.token_counts(prep.token_table(utts)), "filename", "left")).collect()
    assert got == {r["filename"]: r.asDict() for r in want}
