"""A: readers and writers for the file-shaped inputs of the reference —
feature CSVs, nested (formerly pickled) tables, text folders with a label per
folder, WAV folders, list literals, lexicon files — plus the sink, the
processed-file ledger and the quarantine split.

All readers declare their schema (no inference pass over 100 TB) and return
DataFrames; nothing is read on the driver.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_feature_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A feature (or exported spreadsheet) CSV with a header and a
    declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def select_feature_sets(tables: dict, flags: tuple[int, int, int], key: str = "filename") -> DataFrame:
    """A01 flag mask [linguistic, semantic, audio] → the chosen tables
    inner-joined on the key (Quirk 21 fixed: audio is joined when flagged)."""
    chosen = [tables[name] for name, f in zip(("linguistic", "semantic", "audio"), flags) if f]
    if not chosen:
        raise ValueError("at least one feature set must be selected")
    out = chosen[0]
    for t in chosen[1:]:
        out = out.join(t, key, "inner")
    return out


def read_nested(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Nested list / map columns stored as Parquet (ArrayType, MapType,
    StructType) instead of pickles."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_text_folders(spark: SparkSession, root: str) -> DataFrame:
    """Walk ``root/<label>/<file>``: one row per file with the whole
    text, the name before the first dot and the folder as label."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    p = F.col("_metadata.file_path")
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    return df.select(F.regexp_extract(name, r"^([^.]*)", 1).alias("filename"),
                     F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("label"),
                     F.col("value").alias("text"))


def parse_key(col, sep: str = "-"):
    """``id-visit`` keys → (id, visit) columns."""
    parts = F.split(col, sep)
    return F.element_at(parts, 1).alias("id"), F.element_at(parts, 2).cast("int").alias("visit")


def wide_to_long(df: DataFrame, id_col: str, prefix: str, n: int) -> DataFrame:
    """``prefix1..prefixN`` columns → (id, visit, value) so a visit picks
    its column by an equi-join on (id, visit) (visit + 1 → column index)."""
    stack = "stack({}, {}) AS (k, value)".format(n, ", ".join(f"{i}, `{prefix}{i}`" for i in range(1, n + 1)))
    return df.select(id_col, F.expr(stack)).select(id_col, (F.col("k") - 1).alias("visit"), "value")


def read_wav_headers(spark: SparkSession, root: str) -> DataFrame:
    """Recursive ``*.wav`` scan (``binaryFile`` + glob filter) and the
    RIFF header fields decoded per file in Arrow batches."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.wav")
             .option("recursiveFileLookup", True).load(root).select("path", "content"))
    schema = "path string, channels int, sample_rate int, bits int, seconds double"

    def decode(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                out.append((path, *_wav_fields(bytes(content))))
            yield pd.DataFrame(out, columns=["path", "channels", "sample_rate", "bits", "seconds"])

    return files.mapInPandas(decode, schema)


def _wav_fields(b: bytes):
    """(channels, sample rate, bits, seconds) from a RIFF/WAVE byte string."""
    if len(b) < 12 or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
        return None, None, None, None
    pos, ch, rate, bits, data_len = 12, None, None, None, None
    while pos + 8 <= len(b):
        cid, size = b[pos:pos + 4], struct.unpack("<I", b[pos + 4:pos + 8])[0]
        if cid == b"fmt ":
            _, ch, rate, _, _, bits = struct.unpack("<HHIIHH", b[pos + 8:pos + 24])
        elif cid == b"data":
            data_len = size
        pos += 8 + size + (size & 1)
    if not (ch and rate and bits and data_len is not None):
        return ch, rate, bits, None
    return ch, rate, bits, data_len / (ch * rate * bits / 8)


def parse_list_literal(col) -> "F.Column":
    """A Python list literal of strings (``['a', "b's"]``) → array<string>."""
    return F.from_json(col, "array<string>", {"allowSingleQuotes": "true",
                                              "allowBackslashEscapingAnyCharacter": "true",
                                              "allowUnquotedControlChars": "true"})


def read_glob(spark: SparkSession, paths: list[str], fmt: str = "csv", **options) -> DataFrame:
    """Stack every file of a list (columns matched by name; missing
    columns become null)."""
    frames = [spark.read.options(**options).format(fmt).load(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_results(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                  mode: str = "overwrite") -> None:
    """A10: the result sink, partitioned by method / model when given."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def unprocessed(df: DataFrame, ledger: DataFrame, key: str = "filename") -> DataFrame:
    """A11 (batch form): rows whose key is not yet in the processed ledger."""
    return df.join(ledger.select(key).distinct(), key, "left_anti")


def append_ledger(done: DataFrame, ledger_path: str, key: str = "filename") -> None:
    """Record processed keys (append-only ledger table)."""
    done.select(key).distinct().write.mode("append").parquet(ledger_path)


def quarantine_split(df: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``ok`` expression holds, and the quarantined rest (file,
    line and text are kept, the run continues)."""
    flagged = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("_ok").drop("_ok"), flagged.filter("NOT _ok").drop("_ok")


def _line_order():
    """Order of a file's lines whatever the splits: file, block, then the
    row number within the task that reads the block."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                    F.monotonically_increasing_id().alias("i"))


def read_norms(spark: SparkSession, path: str, measure: str) -> DataFrame:
    """``score word`` lines → (word lower-cased, score); the last line of
    a duplicated word wins; only the four known measures are accepted."""
    from ..functions.lexicons import PSYCH_MEASURES
    if measure not in PSYCH_MEASURES:
        raise ValueError("name must be one of: " + str(PSYCH_MEASURES))
    lines = spark.read.text(path).select(F.col("value"), _line_order().alias("line_no"))
    parts = F.split(F.trim("value"), " ")
    t = lines.select(F.lower(F.element_at(parts, 2)).alias("word"),
                     F.element_at(parts, 1).cast("double").alias("score"), "line_no")
    return t.groupBy("word").agg(F.max_by("score", "line_no").alias("score")).withColumn("measure", F.lit(measure))


def read_word_frequency(spark: SparkSession, path: str, option: int = 1) -> DataFrame:
    """Word → Lg10WF (option 0) or SUBTLWF (otherwise) from a CSV with a
    ``Word`` column; the first row of a duplicated word wins."""
    col = "Lg10WF" if option == 0 else "SUBTLWF"
    t = spark.read.option("header", True).csv(path).select(
        F.lower("Word").alias("word"), F.col(col).cast("double").alias("value"),
        _line_order().alias("line_no"))
    return t.groupBy("word").agg(F.min_by("value", "line_no").alias(col.lower()))
