import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import assign, frames
from tapeloom.sources import read_split
from tapeloom.streaming import split_stream, tail_step_stream, thin_by_event_time


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replayed(spark, stream, rows, folder, name):
    """Rows of what stream makes of rows (a list of batches), and of the state that is left."""
    for i, batch in enumerate(rows):
        batch.coalesce(1).write.mode("append").json(f"{folder}/in")
        if i == 0:
            q = stream(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in"))
            q = q.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").start()
        q.processAllAvailable()
    left = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    q.stop()
    return sorted(map(tuple, spark.sql(f"SELECT * FROM {name}").collect())), left, dropped


FRAMES = "media_id long, ts_s double, image string, src_no int"


def at(df, seconds="ts_s"):
    return df.withColumn("at", F.timestamp_seconds(F.col(seconds) + 1_700_000_000))


def test_thinning_waits_for_late_frames(spark, tmp_path):
    rng = random.Random(2)
    own = [(m, i * 0.4 + m, f"i{i}", 0) for m in (1, 2) for i in range(60)]
    rng.shuffle(own)
    own.sort(key=lambda r: r[1] // 8)  # out of order by eight seconds
    batches = [own[i : i + 40] for i in range(0, 120, 40)]
    df = spark.createDataFrame(own, FRAMES)
    far = [[(9, 500.0, "far", 0)], [(1, 2.0, "late", 0), (9, 501.0, "x", 0)], [(9, 9000.0, "end", 0)], [(9, 20000.0, "end", 0)]]
    made = [at(spark.createDataFrame(b, FRAMES)) for b in [*batches, *far]]
    got, left, dropped = replayed(spark, lambda s: thin_by_event_time(s, gap=0.9, late="10 seconds", idle_s=60.0), made, str(tmp_path), "thin_e")
    want = sorted((r.media_id, r.ts_s, r.image) for r in frames.min_gap(df, gap=0.9).collect())
    assert [r for r in got if r[0] != 9] == want and dropped >= 1
    # all that is left is of the recording that goes on: its waiting frame and timer
    assert left <= 4


def test_tail_steps_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    steps = [(m, i + 1, 10.0 * (i + 1), "", "") for m in (1, 2) for i in range(4)]
    said = [(m, i, t, t + rng.random() * 4, "x") for m in (1, 2, 3) for i, t in enumerate(sorted(rng.random() * 140 for _ in range(60)))]
    s = spark.createDataFrame(steps, "media_id long, step int, ts_s double, ts string, image string")
    g = spark.createDataFrame(said, "media_id long, seg_no int, start_s double, end_s double, text string")
    shape = "media_id long, step int, ts_s double, start_s double, end_s double, t double"
    rows = [(m, i, t, None, None, t) for m, i, t, _, _ in steps] + [(m, None, None, a, b, a) for m, _, a, b, _ in said]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[5] // 20)
    batches = [rows[i : i + 70] for i in range(0, len(rows), 70)] + [[(9, None, None, 5e3, 5e3, 5e3)], [(9, None, None, 9e3, 9e3, 9e3)]]
    made = [at(spark.createDataFrame(b, shape), "t") for b in batches]
    got, left, _ = replayed(spark, lambda x: tail_step_stream(x, bucket_s=30.0, late="30 seconds", idle_s=300.0), made, str(tmp_path), "tail_e")
    want = sorted(tuple(r) for r in assign.tail_steps(s, g, bucket_s=30.0)[0].select("media_id", "step", "ts_s", "ts", "image").collect())
    assert got == want and len(want) >= 8 and left <= 6


def test_batches_of_payloads_go_two_ways(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, '{"a":1}'), (2, "[1]"), (3, None)], "i long, payload string").write.parquet(f"{d}/in")
    q = split_stream(spark.readStream.schema("i long, payload string").parquet(f"{d}/in"), f"{d}/out", f"{d}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    good, bad = read_split(spark, f"{d}/out", spark.read.parquet(f"{d}/in").schema)
    assert [r.i for r in good.collect()] == [1] and sorted((r.i, r.reason) for r in bad.collect()) == [(2, "no object"), (3, "missing")]
