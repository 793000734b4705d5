import json
import os

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import redaction_hits
from tapeloom.operators import assign, frames, render, runlog, segments
from tapeloom.sources import append_log, out_name, read_log, read_texts, write_files, write_reports
from tapeloom.streaming import log_stream, redact_stream, tail_bucket_stream, thin_stream

FRAMES = "media_id long, ts_s double, image string, src_no int"


def test_thinning_golden(spark):
    rows = spark.createDataFrame([(1, t, f"i{t}", 0) for t in (0.96, 0.0, 0.05, 0.06, 0.9)] + [(2, 5.0, "x", 0)], FRAMES)
    kept = frames.dedupe_time(rows, eps=0.05)
    times = lambda df: sorted(r.ts_s for r in df.where("media_id = 1").collect())
    assert times(kept) == [0.0, 0.06, 0.9, 0.96]
    assert times(frames.min_gap(kept, gap=0.9)) == [0.0, 0.9]
    assert frames.min_gap(rows, gap=0).count() == 6 and frames.min_gap(rows.limit(0)).count() == 0
    assert [r.ts for r in frames.visual_steps(kept).where("media_id = 1").orderBy("step").collect()] == ["00:00.0", "00:00.0", "00:00.9", "00:00.9"]


def test_merge_keeps_the_words(spark):
    texts = ["one two", "three  four five six seven", " ", "eight nine", "ten", "a b c d e f g h i"]
    rows = spark.createDataFrame([(1, i, i * 1.0, i + 0.9, t) for i, t in enumerate(texts)] + [(2, 0, 0.0, 1.0, None)], "media_id long, seg_no int, start_s double, end_s double, text string")
    got = segments.merge_segments(rows).orderBy("seg_no").collect()
    assert [(r.text, r.start_s, r.end_s) for r in got] == [("one two three four five six seven eight nine", 0.0, 3.9), ("ten a b c d e f g h i", 4.0, 5.9)]


def both(spark, mids, **how):
    steps = spark.createDataFrame([(1, 1, 10.0, "t", "i"), (1, 2, 20.0, "t", "j")], "media_id long, step int, ts_s double, ts string, image string")
    rows = spark.createDataFrame([(1, i, m, m, "x") for i, m in enumerate(mids)] + [(9, 0, 1.0, 1.0, "no steps")], "media_id long, seg_no int, start_s double, end_s double, text string")
    given, extra = assign.assign(steps, rows, **how)
    return [r.step for r in given.orderBy("seg_no").collect()], extra.collect()


def test_assignment_golden(spark):
    mids = [5.0, 15.0, 16.0, 25.0, 31.0]
    assert both(spark, mids)[0] == [1, 1, 1, 3, 4]
    assert both(spark, mids, mode="nearest")[0] == [1, 1, 2, 3, 4]
    got, extra = both(spark, mids, tail_step="last")
    assert got == [1, 1, 1, 2, 2] and extra == []
    assert [(e.step, e.ts_s, e.image) for e in sorted(both(spark, mids)[1], key=lambda e: e.step)] == [(3, 25.0, ""), (4, 31.0, "")]


def test_documents(spark):
    media = spark.createDataFrame([(1, "a.mp4"), (2, "b.mp4")], "media_id long, name string")
    steps = spark.createDataFrame([(1, 1, 0.75, "00:00.0", "s/a.png")], "media_id long, step int, ts_s double, ts string, image string")
    rows = spark.createDataFrame([(1, 1, 0.0, 1.5, "hi"), (1, 2, 40.0, 41.0, "bye")], "media_id long, seg_no int, start_s double, end_s double, text string")
    given, extra = assign.assign(steps, rows)
    got = {r.media_id: r.markdown for r in render.step_markdown(media, assign.all_steps(steps, extra), given, rows, title="T").collect()}
    assert got[1] == "# T\n\n**Source:** `a.mp4`\n\n## Steps\n\n1. **00:00.0**\n\n   ![](s/a.png)\n\n   **Transcript:**\n   - `00:00.0 → 00:01.5` — hi\n\n2. **00:40.0**\n\n   _(Transcript-only step)_\n\n   **Transcript:**\n   - `00:40.0 → 00:41.0` — bye\n"
    assert got[2] == "# T\n\n**Source:** `b.mp4`\n\n## Steps\n\n_No transcript available._\n"
    assert {r.transcript for r in render.transcript_text(media, rows).collect()} == {"[00:00.0] hi\n[00:40.0] bye\n", "(no transcript)\n"}
    assert '"visual_steps":[],"transcript_steps":[]' in {r.media_id: r.timeline for r in render.timeline_json(media.withColumnRenamed("name", "source"), steps, rows).collect()}[2]


def test_payloads_and_log(spark, tmp_path):
    rows = spark.createDataFrame([(x,) for x in ('{"a":1}', "[1]", "{bad", None, "3", "{}")], "p string")
    assert [r.v for r in rows.select(runlog.payload_valid("p").alias("v")).collect()] == [True, False, False, False, False, True]
    maps = spark.createDataFrame([({"name": None},), ({"x": "1"},)], "m map<string,string>")
    assert [r.n for r in maps.select(runlog.payload_default(F.col("m"), "name", "friend")["name"].alias("n")).collect()] == [None, "friend"]
    log = str(tmp_path / "log")
    assert read_log(spark, log).count() == 0
    for i in range(3):
        append_log(spark.createDataFrame([(None, "é", "{}", i > 0, f"s{i}", "{}")], "ts timestamp, agent string, payload string, ok boolean, summary string, data string"), log)
    tail = runlog.log_tail(read_log(spark, log), 2, order=("ts",)).collect()
    assert [r.summary for r in tail] == ["s1", "s2"] and tail[0].agent == "é"
    assert runlog.log_tail(read_log(spark, log), 0, order=("ts",)).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.b.txt").write_bytes(b"x\r\ny\rz\xff")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "sp ace").write_bytes("﻿é".encode())
    got = read_texts(spark, [f"{tmp_path}/*.txt", f"{tmp_path}/a.b.txt", f"{tmp_path}/sp ace"]).orderBy("input_no").collect()
    assert [r.text for r in got] == ["x\ny\nz�", "", "﻿é"]
    names = spark.createDataFrame([("/d/a.b.txt",), ("c",), (".x",)], "p string").select(out_name("p", "light", "heavy").alias("a"), out_name("p").alias("b")).collect()
    assert [tuple(r) for r in names] == [("a.b.clean-light__redact-heavy.txt", "a.b.copy.txt"), ("c.clean-light__redact-heavy", "c.copy"), (".x.clean-light__redact-heavy", ".x.copy")]


def drained(query, name, spark):
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams(spark, tmp_path):
    d = str(tmp_path / "in")
    spark.createDataFrame([(1, "mail a@b.co ,x")], "i long, text string").write.json(d)
    q = redact_stream(spark.readStream.schema("i long, text string").json(d), clean=None).writeStream.format("memory").queryName("red").start()
    assert [r.text for r in drained(q, "red", spark)] == ["mail [EMAIL] ,x"]
    d = str(tmp_path / "seg")
    spark.sql("SELECT 1L media_id, timestamp'2024-01-01 00:00:05' ts UNION ALL SELECT 1, timestamp'2024-01-01 00:00:03' UNION ALL SELECT 1, timestamp'2024-01-01 01:00:00'").write.json(d)
    q = tail_bucket_stream(spark.readStream.schema("media_id long, ts timestamp").json(d)).writeStream.format("memory").queryName("tail").start()
    assert [str(r.start) for r in drained(q, "tail", spark)] == ["2024-01-01 00:00:03"]


def test_thin_stream_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    d = str(tmp_path / "fr")
    rows = [(m, float(t) / 4, f"i{t}", 0) for m in (1, 2) for t in range(m, 40, m)]
    df = spark.createDataFrame(rows, FRAMES)
    for lo, hi in ((0, 5), (5, 100)):
        df.where((F.col("ts_s") >= lo) & (F.col("ts_s") < hi)).coalesce(1).write.mode("append").json(d)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(d)
    q = thin_stream(stream, gap=0.9).writeStream.format("memory").queryName("thin").option("checkpointLocation", str(tmp_path / "ck")).start()
    got = sorted((r.media_id, r.ts_s) for r in drained(q, "thin", spark))
    assert got == sorted((r.media_id, r.ts_s) for r in frames.min_gap(df, gap=0.9).collect())
    timed = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(d)
    q = thin_stream(timed, gap=0.9, ttl_hours=1.0).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert sorted((r.media_id, r.ts_s) for r in spark.sql("SELECT * FROM timed").collect()) == got


def test_log_stream_appends(spark, tmp_path):
    d, log = str(tmp_path / "runs"), str(tmp_path / "log")
    shape = "ts timestamp, agent string, payload string, ok boolean, summary string, data string"
    for i in range(2):
        spark.createDataFrame([(f"2024-01-01 00:00:0{i}", "é", "{}", i > 0, f"s{i}", "{}")], "ts string, agent string, payload string, ok boolean, summary string, data string").write.mode("append").json(d)
        q = log_stream(spark.readStream.schema(shape).json(d), log, str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [(r.summary, r.agent, r.ok) for r in runlog.log_tail(read_log(spark, log), 5, order=("ts",)).collect()] == [("s0", "é", False), ("s1", "é", True)]


def test_files_under_derived_names(spark, tmp_path):
    rows = spark.createDataFrame([("/d/a.txt", "mail é@x b@c.de"), ("/d/b", None), ("/d/c.md", "")], "path string, text string")
    out = redaction_hits(rows).select(out_name("path", None, "light").alias("out_name"), F.col("redacted").alias("text"), "hits")
    folder = tmp_path / "out"
    write_files(out, str(folder))
    write_reports(out, str(folder))
    assert sorted(os.listdir(folder)) == sorted(f"{n}{x}" for n in ("a.redact-light.txt", "b.redact-light", "c.redact-light.md") for x in ("", ".redactions.json"))
    assert (folder / "a.redact-light.txt").read_bytes().decode() == "mail é@x [EMAIL]" and (folder / "b.redact-light").read_bytes() == b""
    assert json.loads((folder / "a.redact-light.txt.redactions.json").read_text()) == [{"label": "EMAIL", "match": "b@c.de", "start": 9, "end": 15}]
    assert (folder / "c.redact-light.md.redactions.json").read_text().split() == ["[", "]"] or (folder / "c.redact-light.md.redactions.json").read_text() == "[]\n"
    with pytest.raises(Exception, match="no name"):
        write_files(out.withColumn("out_name", F.lit(None).cast("string")), str(folder))


def test_a_search_of_sources_ends_with_the_first_that_ran(spark):
    rows = [(1, 0, " "), (1, 1, "b"), (1, 2, "c"), (2, 0, ""), (2, 1, None), (2, 2, "c"), (3, 2, "c"), (4, 0, "a"), (4, 1, "b"), (5, 2, "c"), (6, 0, "a")]
    runs = [(1, 0, True), (1, 1, True), (2, 0, True), (2, 1, True), (2, 2, True), (3, 0, False), (3, 1, None), (3, 2, True), (4, 0, True), (4, 0, True), (4, 1, True), (5, 2, False)]
    got = segments.source_priority(spark.createDataFrame(rows, "media_id long, priority int, text string"), spark.createDataFrame(runs, "media_id long, priority int, ok boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "b"), (3, 2, "c"), (4, 0, "a")]


def test_thinning_of_a_long_recording(spark):
    df = spark.range(60000).selectExpr("1L AS media_id", "id * 0.5D AS ts_s", "CAST(id AS string) AS image", "0 AS src_no")
    assert frames.min_gap(df, gap=0.9).count() == 30000
    assert frames.dedupe_time(df.limit(0)).count() == 0
