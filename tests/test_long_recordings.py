import random
import time

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import assign, frames, segments

FRAMES = "media_id long, ts_s double, image string, src_no int, row string"
STEPS = "media_id long, step int, ts_s double, ts string, image string"
SEGMENTS = "media_id long, seg_no int, start_s double, end_s double, text string"


def by_hand(rows, keeps):
    kept, last = [], None
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[3], r[2])):
        if last is None or r[1] is None or keeps(r[1], last):
            kept.append(r)
            last = r[1]
    return kept


@pytest.mark.parametrize("kind", ["grid", "bursts", "random", "ties"])
def test_chunks_of_a_recording_thin_as_one(spark, kind):
    rng = random.Random(kind)
    times = {"grid": [i * 0.3 for i in range(700)], "bursts": [b * 50 + rng.random() for b in range(12) for _ in range(50)], "random": [rng.random() * 90 for _ in range(600)], "ties": [float(rng.randrange(25)) for _ in range(500)]}[kind]
    rows = [(1, t, f"i{i}", i % 3, "r") for i, t in enumerate(times)] + [(2, float(i), "x", 0, "r") for i in range(5)] + [(1, None, "none", 0, "r"), (2, None, "none", 0, "r")]
    df = spark.createDataFrame(rows, FRAMES)
    got = lambda d: sorted(map(repr, map(tuple, d.collect())))
    both = [[r for r in rows if r[0] == m] for m in (1, 2)]
    for gap in (0.9, 7.0, 1000.0):
        want = sorted(repr(r) for own in both for r in by_hand(own, lambda t, last: t - last >= gap))
        assert got(frames.min_gap(df, gap=gap, limit=60)) == want == got(frames.min_gap(df, gap=gap))
    want = sorted(repr(r) for own in both for r in by_hand(own, lambda t, last: abs(t - last) > 0.6))
    assert got(frames.dedupe_time(df, eps=0.6, limit=60)) == want


@pytest.mark.parametrize("uniform", [True, False])
def test_chunks_of_a_recording_merge_as_one(spark, uniform):
    rng = random.Random(9)
    rows, t = [], 0.0
    for i in range(500):
        n = 3 if uniform else rng.choice([0, 1, 2, 3, 9, 12])
        d = 1.0 if uniform else rng.choice([0.1, 0.5, 2.0, 4.0])
        rows.append((1, i, t if uniform else t + rng.choice([0, -3.0]), t + d, " ".join("w" * (1 + k) for k in range(n))))
        t += d
    rows += [(1, 500, None, None, "a b c d e f g h i"), (1, 501, t, None, "x"), (2, 0, 0.0, 1.0, "few words")]
    df = spark.createDataFrame(rows, SEGMENTS)
    got = lambda d: sorted(map(repr, map(tuple, d.collect())))
    want = got(segments.merge_segments(df))
    assert got(segments.merge_segments(df, limit=40)) == want and got(segments.merge_segments(df, limit=7)) == want and len(want) > 60


def test_a_million_frames_span_tasks(spark):
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("1L AS media_id", "id * 0.5D AS ts_s", "CAST(id AS string) AS image", "0 AS src_no")
    assert frames.min_gap(df, gap=0.9).agg(F.count("*"), F.sum("ts_s")).first() == (500_000, 500_000 * 499_999.0 / 2)


def both(spark, steps, rows, **how):
    given, _ = assign.assign(spark.createDataFrame(steps, STEPS), spark.createDataFrame(rows, SEGMENTS), tail_step="last", **how)
    return sorted((r.media_id, r.seg_no, r.step) for r in given.collect())


@pytest.mark.parametrize("mode", ["previous", "nearest"])
def test_assignment_equals_a_search(spark, mode):
    rng = random.Random(7)
    times = sorted(rng.choice([rng.random() * 300, float(rng.randrange(300))]) for _ in range(80))
    steps = [(1, i + 1, t, "", "") for i, t in enumerate(times)]
    mids = [rng.random() * 400 - 50 for _ in range(300)] + times[:40] + [(a + b) / 2 for a, b in zip(times, times[1:], strict=False)]
    rows = [(1, i, m, m, "x") for i, m in enumerate(mids)] + [(1, 9999, None, 1.0, "x")]

    def step(m):
        before = [s for s in steps if m is not None and s[2] <= m]
        if mode == "previous":
            return before[-1][1] if before else 1
        return 1 if m is None else min(steps, key=lambda s: (abs(s[2] - m), s[2], s[1]))[1]

    want = sorted((1, i, step(None if s is None else (s + e) / 2)) for _, i, s, e, _ in rows)
    assert both(spark, steps, rows, mode=mode) == want
    assert both(spark, steps, rows, mode=mode, range_s=20.0) == want and both(spark, steps, rows, mode=mode, range_s=0.5) == want


def test_columns_with_the_operators_names(spark):
    steps = spark.createDataFrame([(1, 1, 10.0, "t", "i")], STEPS)
    rows = spark.createDataFrame([(1, 1, 1.0, 2.0, "x"), (1, 2, 40.0, 42.0, "y")], SEGMENTS).selectExpr("*", "7 AS last_ts", "7 AS mid", "7 AS bucket", "7 AS _last_ts")
    assert sorted((r.seg_no, r.step) for r in assign.assign(steps, rows)[0].collect()) == [(1, 1), (2, 2)]
    df = spark.createDataFrame([(1, 1.0, "i", 0, 0.9, "keep")], "media_id long, ts_s double, image string, src_no int, scene_score double, _n string").withColumn("n", F.lit("too"))
    assert [tuple(r) for r in frames.scene_filter(df).collect()] == [(1, 1.0, "i", 0, 0.9, "keep", "too")]


def test_a_million_segments_in_time(spark):
    steps = spark.range(1000).selectExpr("1L AS media_id", "CAST(id + 1 AS int) AS step", "id * 1000D AS ts_s", "'' AS ts", "'' AS image")
    rows = spark.range(0, 1_000_000, 1, 8).selectExpr("1L AS media_id", "CAST(id AS int) AS seg_no", "CAST(id AS double) AS start_s", "id + 0.5D AS end_s", "'x' AS text")
    for how in ({}, {"range_s": 100_000.0}):
        start = time.time()
        given, _ = assign.assign(steps, rows, mode="previous", tail_step="last", **how)
        assert given.agg(F.count("*"), F.sum("step")).first() == (1_000_000, sum(i // 1000 + 1 for i in range(1_000_000)))
        assert time.time() - start < 60
