"""Sum-of-squares online packing of token sequences into fixed windows.

A document's ids (plus its end id) fill whole windows first; the remainder is
an item for the online rule. Open windows are kept in a level array: N[h] is
the number of windows filled to h. The item goes to the level (or a new
window) whose move makes the sum of N[h]**2 smallest, ties to the fuller
window. Each task packs the documents of its own input partition, in runs of
at most ``run_docs`` documents so that its open windows stay bounded; at the
end of a run the windows still open are poured together, cutting pieces, so
a run leaves at most one window with padding.

Null texts count as empty: a document of one end id. Rows with equal ids are
packed separately. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub, join_side, partition_bases
from .tokens import CALL_CHARS, CALL_ROWS, encoder, slices

PIECE = ("doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
         "part int, local_id long, offset long")


class LevelPacker:
    """The online rule over one run of items (key, start, length)."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple) -> list | None:
        """Put a piece of 1..window-1 ids into a window; the window, if full."""
        size, w, n = piece[2], self.window, self.count
        # Change of the sum of squares: N[h] loses one, N[h + size] gains one.
        reach = n[:w - size + 1].copy()
        gain = 2 * n[size:w + 1] + 1
        gain[-1] = 0  # a full window leaves the array
        delta = gain - 2 * reach + 1
        delta[reach == 0] = np.iinfo(np.int64).max
        delta[0] = gain[0]  # a new window
        h = len(delta) - 1 - int(np.argmin(delta[::-1]))
        bin_ = self.open[h].pop() if h else []
        if h:
            n[h] -= 1
        bin_.append(piece)
        if h + size == w:
            return bin_
        n[h + size] += 1
        self.open[h + size].append(bin_)
        return None

    def finish(self) -> list[list]:
        """Pour the open windows together, fullest first, cutting pieces."""
        rest = [b for level in reversed(self.open) for b in level]
        done, lo = [], len(rest) - 1
        for i, b in enumerate(rest):
            if i > lo:
                break
            gap = self.window - sum(p[2] for p in b)
            while gap and lo > i:
                key, start, length = rest[lo].pop()
                take = min(gap, length)
                # The tail of the piece moves, its head stays behind.
                b.append((key, start + length - take, take))
                if take < length:
                    rest[lo].append((key, start, length - take))
                gap -= take
                if not rest[lo]:
                    lo -= 1
            done.append(b)
        self.__init__(self.window)
        return done


def _packer(tokenizer: str, end_id: int, window: int, run_docs: int):
    def run(batches):
        from pyspark import TaskContext
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        packer, held, docs, rows, local = LevelPacker(window), {}, 0, [], 0
        names = [c.split()[0] for c in PIECE.split(", ")]
        types = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in PIECE.split(", ")])

        def digest(ids):
            return zlib.crc32(ids.astype("<u4").tobytes())

        def close(bin_):
            nonlocal local
            at = 0
            for key, start, length in bin_:
                doc_id, base, ids, total, left = held[key]
                rows.append((doc_id, base + start, length, ids[start:start + length].tobytes(), digest(ids[start:start + length]), total, part, local, at))
                at += length
                left -= length
                if left:
                    held[key][4] = left
                else:
                    del held[key]
            local += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], names=names)
            rows.clear()
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, CALL_ROWS, CALL_CHARS):
                for doc_id, ids in zip(keys[a:b], enc.encode(texts[a:b])):
                    ids = np.append(ids, enc.dtype.type(end_id))
                    total = len(ids)
                    full = total - total % window
                    for s in range(0, full, window):
                        rows.append((doc_id, s, window, ids[s:s + window].tobytes(), digest(ids[s:s + window]), total, part, local, 0))
                        local += 1
                    docs += 1
                    if total > full:
                        held[docs] = [doc_id, full, ids[full:].copy(), total, total - full]
                        done = packer.place((docs, 0, total - full))
                        if done:
                            close(done)
                    if docs % run_docs == 0:
                        for done in packer.finish():
                            close(done)
                if len(rows) > 2000:
                    yield flush()
        for done in packer.finish():
            close(done)
        if rows:
            yield flush()
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 1024, run_docs: int = 8192,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id,
    offset); ``ids`` are the piece's token ids as little-endian bytes, 16 bits
    each where the vocabulary fits (see ``id_width``), else 32, and
    ``ids_crc32`` is the crc32 of the ids as 32-bit integers, taken where they
    are packed, so that a digest of the pieces does not read all ids again.

    No shuffle of texts: each input partition is packed where it is read, the
    pieces are written once, and sequence ids get their partition's base from
    a prefix sum over one row a partition.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pieces = hub(rows.mapInArrow(_packer(tokenizer, end_id, window, run_docs), PIECE))
    counts = pieces.groupBy("part").agg((F.max("local_id") + 1).alias("n"))
    bases = hub(partition_bases(counts, "part", "n", "base"))
    return (join_side(pieces, bases, "part", bases.count())
            .withColumn("sequence_id", F.col("base") + F.col("local_id")).drop("part", "base", "local_id"))


def id_width(tokenizer: str) -> int:
    return encoder(tokenizer).dtype.itemsize
