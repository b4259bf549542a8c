"""Data sources that read only what they need of large files: RIFF headers
(A06) and CHAT transcripts cut at speaker tiers (A04, B01).

Both are Spark data sources: the driver lists the files and makes partitions,
the tasks read byte ranges through the folder's file system (local paths and
any URI that Arrow can open). A recording costs a few header reads however
long it is, and a long transcript is read by many tasks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.frames import running

FILES_PER_TASK = 2000  # headers a task reads
CHAT_SPLIT = 32 << 20  # bytes of a transcript a task reads
BLOCK = 1 << 20
SPEAKER = re.compile(rb"\*([A-Za-z]+):")
TIER = re.compile(rb"[*%][A-Za-z]+:")


def _filesystem(uri: str):
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def list_files(root: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of every file below ``root`` whose name ends so, by path."""
    from pyarrow import fs as pafs
    fs, path = _filesystem(root)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith(suffix))


# --- A06 ------------------------------------------------------------------------

RIFF = "path string, bytes long, channels int, sample_rate int, bits int, seconds double"


def riff_fields(read_at: Callable[[int, int], bytes], size: int) -> tuple:
    """(channels, sample rate, bits, seconds) from the chunk headers of a RIFF
    / WAVE file; nulls where they are missing. A data chunk that says it is
    longer than the file counts to the file's end."""
    head = read_at(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None, None, None, None
    at, form, data = 12, None, None
    while at + 8 <= size and (form is None or data is None):
        name, length = struct.unpack("<4sI", read_at(at, 8))
        if name == b"fmt " and length >= 16:
            form = struct.unpack("<HHIIHH", read_at(at + 8, 16))
        elif name == b"data":
            data = min(length, size - at - 8)
        at += 8 + length + (length & 1)
    if form is None:
        return None, None, None, None
    _, channels, rate, _, _, bits = form
    known = data is not None and channels and rate and bits
    return channels, rate, bits, data / (channels * rate * bits / 8) if known else None


@dataclass
class _Files(InputPartition):
    files: list


class _RiffReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        files = list_files(self.root, ".wav")
        return [_Files(files[i:i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition):
        fs, _ = _filesystem(self.root)
        for path, size in partition.files:
            with fs.open_input_file(path) as f:
                yield (path, size, *riff_fields(lambda at, n: f.read_at(n, at), size))


class RiffHeaders(DataSource):
    """``spark.read.format("riff_headers").load(root)``."""

    @classmethod
    def name(cls):
        return "riff_headers"

    def schema(self):
        return RIFF

    def reader(self, schema):
        return _RiffReader(self.options["path"])


def read_wav_headers(spark: SparkSession, root: str) -> DataFrame:
    """Recursive ``*.wav`` scan, header fields only."""
    spark.dataSource.register(RiffHeaders)
    return spark.read.format("riff_headers").load(root)


# --- B01 ------------------------------------------------------------------------

CHAT = "path string, at long, speaker string, text string, mor string, gra string"


def lines_from(read_at: Callable[[int, int], bytes], at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of every line that starts at or after ``at``, which is
    inside a line unless it is 0; a block is held at a time."""
    inside, begin, rest = at > 0, at - (at > 0), b""
    pos = begin
    while pos < size:
        block = read_at(pos, min(BLOCK, size - pos))
        pos += len(block)
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for p in parts:
            if not inside:
                yield begin, p
            inside, begin = False, begin + len(p) + 1
    if not inside and begin < size:
        yield begin, rest


def chat_utterances(read_at: Callable[[int, int], bytes], start: int, stop: int, size: int) -> Iterator[tuple]:
    """(offset, speaker, text, mor, gra) of the utterances whose speaker line
    starts in [start, stop), and (offset, None, ...) of ``@End`` lines there.
    The tiers of the last one are read on beyond ``stop``."""
    held, kind = None, None

    def done():
        return held[0], held[1], *(" ".join(held[2][k]) for k in ("text", "mor", "gra"))
    for at, raw in lines_from(read_at, start, size):
        raw = raw.rstrip(b"\r")
        speaker = SPEAKER.match(raw)
        if speaker or raw.startswith(b"@End"):
            if held:
                yield done()
            held = None
            if at >= stop:
                return
            if not speaker:
                yield at, None, "", "", ""
                continue
            held, kind = (at, speaker[1].decode(), {"text": [], "mor": [], "gra": []}), "text"
        elif raw.startswith((b"%", b"@")):
            kind = {b"%mor:": "mor", b"%gra:": "gra"}.get(raw[:5])
        if held and kind:
            held[2][kind].append(TIER.sub(b"", raw, count=1).strip().decode("utf-8", "replace") if TIER.match(raw) else raw.strip().decode("utf-8", "replace"))
        elif not held and at >= stop:
            return
    if held:
        yield done()


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int
    size: int


class _ChatReader(DataSourceReader):
    def __init__(self, root: str, split: int):
        self.root, self.split = root, split

    def partitions(self):
        return [_Range(p, at, min(at + self.split, n), n) for p, n in list_files(self.root, ".cha") for at in range(0, n, self.split)] or [_Range("", 0, 0, 0)]

    def read(self, partition):
        if not partition.size:
            return
        fs, _ = _filesystem(self.root)
        with fs.open_input_file(partition.path) as f:
            for u in chat_utterances(lambda at, n: f.read_at(n, at), partition.start, partition.stop, partition.size):
                yield (partition.path, *u)


class ChatFiles(DataSource):
    """``spark.read.format("chat_files").option("split", bytes).load(root)``."""

    @classmethod
    def name(cls):
        return "chat_files"

    def schema(self):
        return CHAT

    def reader(self, schema):
        return _ChatReader(self.options["path"], int(self.options.get("split", CHAT_SPLIT)))


def read_chat(spark: SparkSession, root: str, split: int = CHAT_SPLIT) -> DataFrame:
    """B01 from files: (filename, utt_idx, speaker, text, mor, gra) of every
    utterance of every ``*.cha`` file below ``root``. Lines after a file's
    first ``@End`` are ignored; utterances are numbered from 1 in file order
    by a segmented scan."""
    spark.dataSource.register(ChatFiles)
    rows = spark.read.format("chat_files").option("split", split).load(root)
    end = rows.filter(F.col("speaker").isNull()).groupBy(F.col("path").alias("_p")).agg(F.min("at").alias("_end"))
    kept = rows.filter(F.col("speaker").isNotNull()).join(end, F.col("path") == F.col("_p"), "left").filter(
        F.col("_end").isNull() | (F.col("at") < F.col("_end"))).drop("_p", "_end")
    return running(kept.withColumn("_one", F.lit(1)), ["at"], "path", sums={"utt_idx": "_one"}).select(
        F.col("path").alias("filename"), "utt_idx", "speaker", "text", "mor", "gra")
