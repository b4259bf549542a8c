"""Token-id files: flat unsigned integers plus 64-bit document offsets.

A folder holds one shard a range of document ids. A shard is two flat
little-endian files: ``.bin`` (token ids, 16 bits where the vocabulary fits,
else 32) and ``.idx`` (64-bit: n + 1 token offsets, then n document ids).
The manifest (one row a shard) adds each shard's base, the prefix sum of the
token counts before it, so a document's global start is base + offset.

Null texts count as empty; an empty text still gets the end id. Rows with
equal ids stay, ordered by text; null ids come first and are stored as the
smallest 64-bit integer. An empty table gives an empty manifest. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, hub, local_path, partition_bases
from .tokens import CALL_CHARS, CALL_ROWS, encoder, slices

NULL_ID = -(1 << 63)
SHARD = "shard long, path string, dtype string, n_docs long, n_tokens long"


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        if end_id >= 1 << (8 * enc.dtype.itemsize):
            raise ValueError("the end id does not fit the file's integers")
        task = TaskContext.get()
        # A name of its own for every attempt: only the manifest's files count.
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, root = filesystem(folder)
        sink, ids, ends, total = None, [], [], 0
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            ids.append(keys.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
            for a, b in slices(texts, CALL_ROWS, CALL_CHARS):
                if sink is None:
                    sink = fs.open_output_stream(f"{root}/{name}.bin")
                for arr in enc.encode(texts[a:b]):
                    sink.write(arr.tobytes() + np.array([end_id], enc.dtype).tobytes())
                    total += len(arr) + 1
                    ends.append(total)
        if sink is None:
            return
        sink.close()
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(np.array([0, *ends], "<i8").tobytes())
            f.write(np.concatenate(ids).tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": f"{folder}/{name}", "dtype": enc.dtype.str, "n_docs": len(ends), "n_tokens": total}])
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every whole text and write the shards in ascending id order.

    One range shuffle; each task streams its sorted rows into its own pair of
    files, and the prefix sum runs over one row a shard. Returns the manifest
    (shard, path, dtype, n_docs, n_tokens, base), which also lies in the
    folder as parquet.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = filesystem(folder)
    fs.create_dir(root)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n, "i", F.xxhash64("t")).sortWithinPartitions("i", "t")
    written = hub(rows.mapInArrow(_writer(folder, tokenizer, end_id), SHARD))
    manifest = written.join(partition_bases(written, "shard", "n_tokens", "base"), "shard")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def open_shard(path: str, dtype: str, n_docs: int):
    """(ids, offsets, doc ids) of a shard, memory-mapped where the folder is
    mounted; read through its file system otherwise."""
    local = local_path(path)
    if local:
        index = np.memmap(f"{local}.idx", "<i8", "r")
        ids = np.memmap(f"{local}.bin", dtype, "r")
    else:
        fs, p = filesystem(path)
        index = np.frombuffer(fs.open_input_file(f"{p}.idx").read(), "<i8")
        ids = np.frombuffer(fs.open_input_file(f"{p}.bin").read(), dtype)
    return ids, index[:n_docs + 1], index[n_docs + 1:]


def _reader(batches):
    out_type = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for r in batch.to_pylist():
            ids, ends, keys = open_shard(r["path"], r["dtype"], r["n_docs"])
            for a in range(0, r["n_docs"], 512):
                b = min(a + 512, r["n_docs"])
                k = np.asarray(keys[a:b])
                yield pa.RecordBatch.from_arrays([
                    pa.array(k, pa.int64(), mask=k == NULL_ID),
                    pa.array(r["base"] + np.asarray(ends[a:b]), pa.int64()),
                    pa.array(np.diff(ends[a:b + 1]), pa.int64()),
                    pa.array([np.asarray(ids[ends[i]:ends[i + 1]]).astype("<u4").tobytes() for i in range(a, b)], pa.binary())],
                    schema=out_type)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids (32-bit unsigned
    little-endian bytes) from the files, a shard a task."""
    shards = max(1, manifest.count())
    return (manifest.repartition(shards, "shard")
            .mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary"))


def describe(manifest: DataFrame) -> str:
    """The manifest as JSON lines, for readers outside Spark."""
    return "\n".join(json.dumps(r.asDict()) for r in manifest.orderBy("shard").toLocalIterator())


def new_folder(base: str) -> str:
    return f"{base}/token-files-{uuid.uuid4().hex}"
