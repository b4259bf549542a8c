"""Readers and sinks on small files written to a fresh temporary folder."""

import os
import struct
import tempfile
import wave

import pytest
from pyspark.sql import functions as F

from parlance.sources import io


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="parlance-test-", dir="/tmp")


def test_text_folders(spark, tmp):
    for label, name, text in [("Control", "a.cha.txt", "hello there"), ("Dementia", "b.txt", "good bye")]:
        os.makedirs(os.path.join(tmp, label), exist_ok=True)
        with open(os.path.join(tmp, label, name), "w") as f:
            f.write(text)
    rows = sorted((r["filename"], r["label"], r["text"]) for r in io.read_text_folders(spark, tmp).collect())
    assert rows == [("a", "Control", "hello there"), ("b", "Dementia", "good bye")]


def test_wav_headers(spark, tmp):
    os.makedirs(os.path.join(tmp, "x", "y"))
    path = os.path.join(tmp, "x", "y", "r1.wav")
    with wave.open(path, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<h", 0) * 8000 * 2)
    with open(os.path.join(tmp, "x", "notes.txt"), "w") as f:
        f.write("not audio")
    r = io.read_wav_headers(spark, tmp).collect()
    assert len(r) == 1
    assert (r[0]["channels"], r[0]["sample_rate"], r[0]["bits"]) == (1, 8000, 16)
    assert r[0]["seconds"] == pytest.approx(2.0)


def test_norms_last_duplicate_wins(spark, tmp):
    p = os.path.join(tmp, "familiarity")
    with open(p, "w") as f:
        f.write("1.5 Boy\n2.0 girl\n3.5 boy\n")
    got = {r["word"]: r["score"] for r in io.read_norms(spark, p, "familiarity").collect()}
    assert got == {"boy": 3.5, "girl": 2.0}
    with pytest.raises(ValueError):
        io.read_norms(spark, p, "loudness")


def test_word_frequency_first_duplicate_wins(spark, tmp):
    p = os.path.join(tmp, "freq.csv")
    with open(p, "w") as f:
        f.write("Word,SUBTLWF,Lg10WF\nThe,100.0,5.0\nthe,1.0,1.0\ncat,3.0,2.0\n")
    got = {r["word"]: r["subtlwf"] for r in io.read_word_frequency(spark, p).collect()}
    assert got == {"the": 100.0, "cat": 3.0}
    got0 = {r["word"]: r["lg10wf"] for r in io.read_word_frequency(spark, p, option=0).collect()}
    assert got0["the"] == 5.0


def test_feature_csv_and_sink(spark, tmp):
    df = spark.createDataFrame([("a", "m1", 0.5), ("b", "m2", 0.25)], "filename string, method string, acc double")
    out = os.path.join(tmp, "res")
    io.write_results(df, out, partition_by=["method"], fmt="csv")
    back = io.read_feature_csv(spark, out + "/method=m1", "filename string, acc double")
    assert [(r["filename"], r["acc"]) for r in back.collect()] == [("a", 0.5)]
    tables = {"linguistic": df.select("filename", "acc"), "semantic": df.select("filename", "method"),
              "audio": df.select("filename", F.lit(1).alias("x"))}
    assert io.select_feature_sets(tables, (1, 1, 1)).columns == ["filename", "acc", "method", "x"]


def test_list_literal(spark):
    df = spark.createDataFrame([("['a b', 'c\\'d', \"e\"]",)], "s string")
    assert df.select(io.parse_list_literal(F.col("s"))).first()[0] == ["a b", "c'd", "e"]


def test_key_parse_and_wide_to_long(spark):
    df = spark.createDataFrame([("12-0",), ("12-1",)], "key string")
    parsed = df.select(*io.parse_key(F.col("key")))
    wide = spark.createDataFrame([("12", 30.0, 28.0)], "id string, mmse1 double, mmse2 double")
    long = io.wide_to_long(wide, "id", "mmse", 2)
    got = sorted((r["visit"], r["value"]) for r in parsed.join(long, ["id", "visit"]).collect())
    assert got == [(0, 30.0), (1, 28.0)]


def test_ledger_and_quarantine(spark, tmp):
    docs = spark.createDataFrame([(1, "a"), (2, "!!"), (3, "b")], "filename long, text string")
    ledger_path = os.path.join(tmp, "ledger")
    io.append_ledger(docs.filter("filename = 1"), ledger_path)
    todo = io.unprocessed(docs, spark.read.parquet(ledger_path))
    assert sorted(r["filename"] for r in todo.collect()) == [2, 3]
    good, bad = io.quarantine_split(docs, F.col("text").rlike(r"\p{L}"))
    assert [r["filename"] for r in bad.collect()] == [2]


def test_nested_and_glob(spark, tmp):
    nested = spark.createDataFrame([("f1", [["a", "b"], ["c"]], [{"NN": 2}, {"VB": 1}])],
                                   "filename string, token array<array<string>>, pos_freq array<map<string,int>>")
    p = os.path.join(tmp, "tags")
    nested.write.parquet(p)
    back = io.read_nested(spark, p, "filename string, token array<array<string>>, pos_freq array<map<string,int>>")
    r = back.first()
    assert r["token"] == [["a", "b"], ["c"]] and r["pos_freq"][0] == {"NN": 2}
    a, b = os.path.join(tmp, "a.csv"), os.path.join(tmp, "b.csv")
    with open(a, "w") as f:
        f.write("filename,x\nf1,1\n")
    with open(b, "w") as f:
        f.write("filename,y\nf2,2\n")
    u = io.read_glob(spark, [a, b], header=True)
    assert sorted(u.columns) == ["filename", "x", "y"] and u.count() == 2
