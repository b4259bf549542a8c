"""A11, streaming form: incremental processing of newly arrived transcript
files. The file source plus its checkpoint *is* the processed-file ledger:
each run with ``trigger(availableNow=True)`` processes exactly the files not
seen by earlier runs, then stops; a second run over the same folder adds
nothing.

Per micro-batch the partial counts of its turns are written (``foreachBatch``)
to the batch's own partition, which a replayed batch overwrites, so a failure
between the write and the commit doubles nothing. ``read_profile`` merges the
partial counts, so a transcript whose turns arrive in several batches has one
row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import prep

TURN_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _partial_counts(batch: DataFrame) -> DataFrame:
    """(filename, token, n): token counts, and the utterance count under a
    null token."""
    utts = prep.utterances_from_conversations(batch, roles=("user",))
    toks = prep.token_table(utts).select("filename", "token")
    turns = utts.select("filename", F.lit(None).cast("string").alias("token"))
    return toks.unionByName(turns).groupBy("filename", "token").agg(F.count("*").alias("n"))


def write_batch(batch: DataFrame, batch_id: int, output_dir: str) -> None:
    """The batch's partial counts; writing a batch again replaces them."""
    _partial_counts(batch).write.mode("overwrite").parquet(f"{output_dir}/batch_id={batch_id}")


def read_profile(spark: SparkSession, output_dir: str) -> DataFrame:
    """The lexical profile (utterances and C01/C02 counts) of every transcript
    over all batches."""
    per_type = spark.read.parquet(output_dir).groupBy("filename", "token").agg(F.sum("n").alias("n"))
    n, word = F.col("n"), F.col("token").isNotNull()
    g = per_type.groupBy("filename").agg(
        F.sum(F.when(~word, n)).alias("n_utterances"), F.sum(F.when(word, n)).alias("n_tokens"),
        F.count("token").alias("n_unique_tokens"), F.sum(F.when(word, n * F.length("token"))).alias("chars"))
    return g.select("filename", "n_utterances", "n_tokens", "n_unique_tokens",
                    tx.round6(F.try_divide(F.col("n_unique_tokens").cast("double"), F.col("n_tokens"))).alias("ttr"),
                    tx.round6(F.try_divide(F.col("chars").cast("double"), F.col("n_tokens"))).alias("mean_token_length"))


def process_new_files(spark: SparkSession, source_dir: str, output_dir: str, checkpoint_dir: str,
                      max_files_per_trigger: int = 100) -> int:
    """Run one incremental pass; returns the number of micro-batches run."""
    stream = (spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    batches = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        write_batch(batch, batch_id, output_dir)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(batches)
