"""A06, A04 and B01 from files: header reads of recordings, transcripts cut
at speaker tiers."""

import os
import struct
import wave

import pytest

from parlance.operators import prep
from parlance.sources import files


def wav(path, seconds=0.5, rate=8000, channels=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0" * int(seconds * rate) * channels * 2)


def test_wav_headers_of_a_folder(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    wav(tmp_path / "a" / "x.wav")
    wav(tmp_path / "a" / "b" / "y.WAV", 2.0, 16000, 1)
    (tmp_path / "a" / "bad.wav").write_bytes(b"RIFFxxxxWAVEfmt ")
    (tmp_path / "a" / "empty.wav").write_bytes(b"")
    (tmp_path / "a" / "note.txt").write_text("no recording")
    got = {os.path.basename(r["path"]): tuple(r)[2:] for r in files.read_wav_headers(spark, str(tmp_path)).collect()}
    assert got == {"x.wav": (2, 8000, 16, 0.5), "y.WAV": (1, 16000, 16, 2.0), "bad.wav": (None,) * 4, "empty.wav": (None,) * 4}
    os.makedirs(tmp_path / "none")
    assert files.read_wav_headers(spark, str(tmp_path / "none")).count() == 0


def test_a_gigabyte_recording_costs_a_few_bytes(spark, tmp_path):
    """A sparse file: chunks before and after the samples are skipped."""
    data = 1 << 30
    body = struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + struct.pack("<4sI", b"LIST", 5) + b"abcde\0"
    body += struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 44100, 88200, 2, 16) + struct.pack("<4sI", b"data", data)
    path = tmp_path / "long.wav"
    path.write_bytes(body)
    os.truncate(path, len(body) + data)
    r = files.read_wav_headers(spark, str(tmp_path)).first()
    assert r["bytes"] == len(body) + data and r["seconds"] == pytest.approx(data / 88200)
    read = []
    with open(path, "rb") as f:
        def read_at(at, n):
            f.seek(at)
            read.append(n)
            return f.read(n)
        assert files.riff_fields(read_at, r["bytes"])[:3] == (1, 44100, 16)
    assert sum(read) < 1000


def chat(n, end="@End\n"):
    out = "@Begin\n@Languages:\teng\n"
    for i in range(n):
        out += f"*{'PAR' if i % 3 else 'INV'}:\twords of turn {i} é\n" + ("\tmore of it\n" if i % 4 == 0 else "")
        out += f"%mor:\tn|word{i}\n\tn|again\n" * (i % 2) + (f"%gra:\t1|0|{i}\n" if i % 5 == 0 else "") + ("%com:\tnot kept\n\tnor this\n" if i % 7 == 0 else "")
    return out + end


@pytest.mark.parametrize("split", [37, 200, 1 << 20])
def test_chat_files_in_splits_equal_whole_files(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 64)
    texts = {"a.cha": chat(40), "b.cha": chat(3, ""), "c.cha": chat(2) + "*PAR:\tafter the end\n", "d.cha": "@End", "e.cha": "",
             "f.cha": "*PAR:\tno line end", "g.cha": chat(1).replace("\n", "\r\n")}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "h.txt").write_text("*PAR:\tnot a transcript")
    got = {(os.path.basename(r["filename"]), r["utt_idx"]): tuple(r)[2:] for r in files.read_chat(spark, str(tmp_path), split).collect()}
    whole = spark.createDataFrame([(k, v.replace("\r", "").removesuffix("\n")) for k, v in texts.items()], "filename string, text string")
    want = {(r["filename"], r["utt_idx"]): tuple(r[c] for c in ("speaker", "text", "mor", "gra")) for r in prep.chat_tiers(prep.chat_lines(whole)).collect()}
    assert got == want and len(got) == 40 + 3 + 2 + 1 + 1


def test_no_task_reads_a_whole_long_transcript(tmp_path):
    body = chat(2000).encode()
    read = []

    def read_at(at, n):
        read.append(n)
        return body[at:at + n]
    size, split = len(body), 4096
    files_block, files.BLOCK = files.BLOCK, 512
    try:
        rows = []
        for start in range(0, size, split):
            read.clear()
            rows += list(files.chat_utterances(read_at, start, min(start + split, size), size))
            assert sum(read) <= split + 2048
    finally:
        files.BLOCK = files_block
    assert len(rows) == 2001 and [r[0] for r in rows] == sorted(r[0] for r in rows)
