import os

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import runlog
from tapeloom.sources import read_split, read_texts, split_payloads, write_files


def texts(df):
    return {os.path.basename(r.path): r.text for r in df.collect()}


def test_names_of_any_letters(spark, tmp_path):
    names = ["a+b.txt", "c%20d.txt", "e f.txt", "g[1].txt", "g1.txt", "h{1,2}.txt", "i,j.txt", "k#l.txt", "m?n.txt", "back\\slash.txt", "é中.txt", "[open.txt", "p=q.txt"]
    for i, n in enumerate(names):
        (tmp_path / n).write_text(f"text {i}")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "empty.txt").write_bytes(b"")
    want = {n: f"text {i}" for i, n in enumerate(names)}
    assert texts(read_texts(spark, [f"{tmp_path}/*.txt"])) == want | {"empty.txt": ""}
    for n in names:
        got = texts(read_texts(spark, [f"{tmp_path}/{n}"]))
        # as in the shell, a glob that matches is one: [1] names g1
        assert got == ({"g1.txt": want["g1.txt"]} if n == "g[1].txt" else {n: want[n]}), n
    os.remove(tmp_path / "g1.txt")
    assert texts(read_texts(spark, [f"{tmp_path}/g[1].txt"])) == {"g[1].txt": want["g[1].txt"]}
    assert set(texts(read_texts(spark, [f"{tmp_path}/[a-e]*.txt"]))) == {"a+b.txt", "c%20d.txt", "e f.txt", "back\\slash.txt", "empty.txt"}
    assert set(texts(read_texts(spark, [f"{tmp_path}/[!a-h]*.txt"]))) >= {"i,j.txt", "k#l.txt", "m?n.txt"}
    got = read_texts(spark, [f"{tmp_path}/c%20d.txt", f"{tmp_path}/[ac]*.txt", f"{tmp_path}/a+b.txt", f"{tmp_path}/*.txt"]).collect()
    assert len(got) == len({r.path for r in got}) == len(names)
    assert {os.path.basename(r.path): r.input_no for r in got if r.input_no < 2} == {"c%20d.txt": 0, "a+b.txt": 1}


def test_inputs_that_are_no_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("x")
    (tmp_path / "_y.txt").write_text("y")
    for bad, error in (("none.txt", FileNotFoundError), ("n*.txt", FileNotFoundError), ("d", ValueError), ("*", ValueError), ("_y.txt", ValueError), ("*.txt", ValueError)):
        with pytest.raises(error):
            read_texts(spark, [f"{tmp_path}/{bad}"])
    assert read_texts(spark, []).count() == 0


def test_bad_bytes_are_replaced_as_python_does(spark, tmp_path):
    data = [b"\xff\xfea", b"\xe2\x82", b"a\xe2\x82b", b"\xf0\x9f\x98", b"\xc3(", b"\xed\xa0\x80", b"ok\r\n\rx\n", b"\xc0\xaf\xf5"]
    for i, b in enumerate(data):
        (tmp_path / f"{i}.txt").write_bytes(b)
    got = texts(read_texts(spark, [f"{tmp_path}/*.txt"]))
    assert [got[f"{i}.txt"] for i in range(len(data))] == [b.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for b in data]


def test_many_files(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"f+{i}.txt").write_text(str(i))
    got = read_texts(spark, [f"{tmp_path}/f+1*.txt", f"{tmp_path}/*.txt"])
    assert got.groupBy((F.col("input_no") < 1111).alias("first"), F.col("path").contains("/f+1").alias("one")).count().orderBy("first").collect() == [(False, False, 1889), (True, True, 1111)]
    assert got.agg(F.countDistinct("input_no"), F.max("input_no")).first() == (3000, 2999)
    assert got.agg(F.sum(F.col("text").cast("long"))).first()[0] == sum(range(3000))


def test_payloads_go_two_ways(spark, tmp_path):
    rows = [(i, p, "z") for i, p in enumerate(['{"a":1}', "[1]", "{bad", None, "3", "{}", "", '{"a":1}', "null"])]
    df = spark.createDataFrame(rows, "i long, payload string, reason string")
    counts = split_payloads(df, str(tmp_path / "out"))
    good, bad = read_split(spark, str(tmp_path / "out"), df.schema)
    assert counts == {"accepted": 3, "rejected": 6} == {"accepted": good.count(), "rejected": bad.count()}
    assert sorted(r.i for r in good.collect()) == [r.i for r in df.where(runlog.payload_valid("payload")).orderBy("i").collect()]
    assert {r.i: r.reason for r in bad.collect()} == {1: "no object", 2: "no json", 3: "missing", 4: "no object", 6: "no json", 8: "no object"}
    assert split_payloads(df.limit(0), str(tmp_path / "none")) == {"accepted": 0, "rejected": 0}


def test_a_folder_without_a_scheme_is_sparks(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "é")], "out_name string, text string")
    conf = spark._jsc.hadoopConfiguration()
    write_files(rows, f"{tmp_path}/one")
    write_files(rows, f"file:{tmp_path}/two")
    assert (tmp_path / "one" / "a.txt").read_text() == (tmp_path / "two" / "a.txt").read_text() == "é"
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "s3a://bucket")
    try:
        with pytest.raises(Exception):  # not written to a local folder
            write_files(rows, f"{tmp_path}/three")
    finally:
        conf.set("fs.defaultFS", before)
    assert not (tmp_path / "three").exists()
