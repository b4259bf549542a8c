"""Whole-text encoding with a public tokenizer file, through a cache of pieces."""

from __future__ import annotations

import gc
from array import array

import numpy as np
import pyarrow as pa

from .common import quiet_threads

CACHE = 150_000  # words a generation of a Python worker's dictionary (some 30 MB)
# Texts encoded in one call: many share their words.
CALL_ROWS, CALL_CHARS = 8192, 4_000_000
_ENCODERS: dict[str, "Encoder"] = {}
# Classes of bytes: letters, digits, marks but the apostrophe, spaces and line
# ends are plain; 0 is anything else. Latin-1 letters are set by their pairs.
LETTER, DIGIT, MARK, SPACE, LINE = 1, 2, 3, 4, 5
_CLASS = np.array([SPACE if b == 32 else LINE if b == 10 else 0 if b < 33 or b > 126 or b == 39 else
                   LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK for b in range(256)], np.uint8)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE ids of whole texts, equal to encoding each text at once.

    The tokenizer splits a text by a pattern before it merges, and merges
    never cross a split. A single space between two non-blank characters
    always starts a split, so a text whose spaces all stand so is cut into
    chunks there. A plain chunk (Latin letters, digits, marks, single line
    ends inside it) is cut on by the same pattern: where the class of
    character changes. Other chunks stay whole. The pieces of many texts are
    found on their bytes and counted as one Arrow array, so each distinct
    piece is looked up once a call and only new ones reach the tokenizer; the
    texts' ids are gathered from the pieces'. Texts with other blank runs, and
    texts that hold the string of an added token, go to the tokenizer whole.

    The pieces' ids are kept from call to call in two generations of at most
    CACHE entries: a full young one becomes the old one, and what is used
    again moves over. They change the speed only.
    """

    def __init__(self, path: str):
        quiet_threads()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        vocab = self.tok.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)
        self.leads[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _raw_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that start with their only space, many in a text:
        there too each is a split of its own, and its first id, alone of its
        ids, begins with the byte of the space."""
        out = []
        for e in self.tok.encode_batch_fast(["".join(words[i:i + 256]) for i in range(0, len(words), 256)], add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            cuts = (np.nonzero(self.leads[ids])[0] * self.dtype.itemsize).tolist()
            ids = ids.tobytes()
            out += [ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]
        return out

    def _learn(self, new: list[str], other: list[bool]) -> dict[str, bytes | None]:
        """Ids of new pieces; None for chunks that are not plain and do not
        start and end with a letter, digit or mark: their text goes whole."""
        led = [w for w, o in zip(new, other) if not o and w[0] == " " and w[1:].isalpha()]
        known = dict(zip(led, self._raw_words(led)))
        rest = [w for w in new if w not in known]
        known.update(zip(rest, self._raw(rest)))
        for w, o in zip(new, other):
            if o:
                c = w.removeprefix(" ")
                if not all(x.isalnum() or "\x20" < x < "\x7f" for x in (c[:1], c[-1:])):
                    known[w] = None
        return known

    def _ids(self, pieces: list[str], other: np.ndarray) -> list[bytes | None]:
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        ids = list(map(self.young.get, pieces))
        again = [k for k, x in enumerate(ids) if x is None]
        if again:
            held = {pieces[k]: self.old[pieces[k]] for k in again if pieces[k] in self.old}
            new = [k for k in again if pieces[k] not in held and pieces[k] not in self.young]
            if new:
                held |= self._learn([pieces[k] for k in new], other[new].tolist())
            self.young |= held
            for k in again:
                ids[k] = self.young[pieces[k]]
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # Millions of short-lived strings and no cycles: collections only cost.
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = np.array([any(a in t for a in self.added) for t in texts], bool)
        raw = [b"" if w else t.encode() for t, w in zip(texts, whole)]
        begin = np.cumsum([0] + [len(r) for r in raw])
        blob = np.frombuffer(b"".join(raw) + b" ", np.uint8)
        size = len(blob) - 1
        kind = _CLASS[blob]
        pair = np.flatnonzero(blob == 0xC3)
        pair = pair[(blob[pair + 1] != 0x97) & (blob[pair + 1] != 0xB7)]
        kind[pair] = kind[pair + 1] = LETTER
        # A chunk starts at a text's start and at every space.
        mark = kind[:size] == SPACE
        mark[begin[:-1][np.diff(begin) > 0]] = True
        start = np.flatnonzero(mark)
        chunk = np.cumsum(mark, dtype=np.int32) - 1
        before = np.concatenate(([0], kind[:size - 1])) if size else kind[:0]
        line = kind[:size] == LINE
        other = np.zeros(len(start), bool)
        other[chunk[(kind[:size] == 0) | (line & (before == LINE) & ~mark)]] = True
        # No chunk may be empty, or start or end with a line end.
        stop = np.append(start[1:], size)[:len(start)]
        lead = kind[start] == SPACE
        first = start + lead
        alone = (first >= stop) | (kind[np.minimum(first, size)] == LINE) | (kind[np.maximum(stop - 1, 0)] == LINE)
        text = np.searchsorted(begin, start, "right") - 1
        alone |= lead & (start == begin[text])
        whole[text[alone]] = True
        cut = mark | ((kind[:size] != before) & (before != SPACE) & ~other[chunk])
        piece = np.flatnonzero(cut)
        offsets = np.append(piece, size).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_string(), len(piece), [None, pa.py_buffer(offsets), pa.py_buffer(blob)]).dictionary_encode()
        code = found.indices.to_numpy()
        unplain = np.zeros(len(found.dictionary), bool)
        unplain[code[other[chunk[piece]]]] = True
        ids = self._ids(found.dictionary.to_pylist(), unplain)
        if none := [k for k, x in enumerate(ids) if x is None]:
            hit = np.zeros(len(ids), bool)
            hit[none] = True
            whole[np.searchsorted(begin, piece[hit[code]], "right") - 1] = True
            ids = [x or b"" for x in ids]
        flat = np.frombuffer(b"".join(ids), self.dtype)
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        base = np.cumsum(each) - each
        length = each[code]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        out = flat[np.repeat(base[code] - end + length, length) + np.arange(total)]
        at = np.append(0, end)[np.searchsorted(piece, begin)]
        return [self._whole(t) if w else out[a:b] for t, w, a, b in zip(texts, whole.tolist(), at[:-1].tolist(), at[1:].tolist())]

    def _whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self._raw([text])[0], self.dtype) if text else np.empty(0, self.dtype)


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: list, rows: int = 256, chars: int = 2_000_000):
    """(start, end) runs of a batch, bounded by rows and by characters."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and (i - a >= rows or size + len(t) > chars):
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
