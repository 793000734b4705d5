"""Segments under steps: the step before or the nearest one, and steps of their own after the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.timing import format_ts, midpoint


def _last_steps(steps: DataFrame) -> DataFrame:
    return steps.groupBy("media_id").agg(F.max("ts_s").alias("_last_ts"), F.max("step").alias("_last_step"))


def _tail(steps: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of recordings with steps (media_id, seg_no, start_s, mid, _last_ts, _last_step): segments up to the last step, and those after it."""
    own = segments.select("media_id", "seg_no", "start_s", midpoint().alias("mid"))
    all_ = own.join(_last_steps(steps), "media_id")
    return all_.where("NOT coalesce(mid > _last_ts, false)"), all_.where("mid > _last_ts")


def _at_steps(steps: DataFrame, segments: DataFrame, mode: str, range_s: float | None = None) -> DataFrame:
    """(media_id, step, seg_no): sorted passes over steps and segments of a recording instead of a join by inequality.

    Both frames run from an end of the order to the row at hand, so a pass is linear. With range_s a
    recording is dealt out in ranges of so many seconds; the steps next to a range on either side are carried into it.
    """
    points = steps.groupBy("media_id", "ts_s").agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    none = F.lit(None)
    left = points.select("media_id", F.col("ts_s").alias("t"), F.lit(0).alias("kind"), F.struct("ts_s", "lo", "hi").alias("p"), none.cast("long").alias("seg_no"))
    right = segments.select("media_id", F.col("mid").alias("t"), F.lit(1).alias("kind"), none.cast("struct<ts_s:double,lo:int,hi:int>").alias("p"), F.col("seg_no").cast("long"))
    rows = left.unionByName(right).withColumn("r", F.floor(F.col("t") / range_s) if range_s else F.lit(0))
    key = ["media_id", "r"] if range_s else ["media_id"]
    before, after = Window.unboundedPreceding, Window.currentRow
    back = F.last("p", ignorenulls=True).over(Window.partitionBy(*key).orderBy("t", "kind").rowsBetween(before, after))
    if mode == "previous":  # what comes ahead counts before the first step alone: no second sort
        ahead = F.min("p").over(Window.partitionBy(*key))
    else:
        ahead = F.last("p", ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("kind")).rowsBetween(before, after))
    met = rows.select(*key, "t", "kind", "seg_no", back.alias("a"), ahead.alias("b")).where("kind = 1")
    if range_s:
        # one row for each range of a recording
        ends = rows.groupBy(*key).agg(F.max("p").alias("last"), F.min("p").alias("first"))
        carried_back = F.last("last", ignorenulls=True).over(Window.partitionBy("media_id").orderBy("r").rowsBetween(before, -1))
        carried_ahead = F.last("first", ignorenulls=True).over(Window.partitionBy("media_id").orderBy(F.desc("r")).rowsBetween(before, -1))
        ends = ends.select(F.col("media_id").alias("m"), F.col("r").alias("q"), carried_back.alias("c"), carried_ahead.alias("d"))
        met = met.join(ends, (F.col("media_id") == F.col("m")) & F.col("r").eqNullSafe(F.col("q"))).withColumn("a", F.coalesce("a", "c")).withColumn("b", F.coalesce("b", "d"))
    if mode == "previous":
        # before the first step comes the first, and at equal times the last of them
        step = F.coalesce("a.hi", "b.lo")
    else:
        nearer = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("t") - F.col("a.ts_s") <= F.col("b.ts_s") - F.col("t")))
        step = F.when(nearer, F.col("a.lo")).otherwise(F.col("b.lo"))
    return met.select("media_id", step.alias("step"), "seg_no")


def tail_steps(steps: DataFrame, segments: DataFrame, *, bucket_s: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(extra steps, assignment) for segments after the last step: one step for each bucket of bucket_s seconds that has any, numbered on, at its earliest start.

    Steps and segments of recordings without the other, and segments without a middle, give nothing; equal rows count each. Of empty
    tables come empty ones; further columns are not read.
    """
    _, tail = _tail(steps, segments)
    tail = tail.withColumn("bucket", F.floor(F.col("mid") / bucket_s))
    own = tail.groupBy("media_id", "bucket").agg(F.min("start_s").alias("ts_s"), F.first("_last_step").alias("last_step"))
    number = (F.col("last_step") + F.row_number().over(Window.partitionBy("media_id").orderBy("bucket"))).cast("int")
    own = own.withColumn("step", number)
    extra = own.select("media_id", "step", "ts_s", format_ts("ts_s").alias("ts"), F.lit("").alias("image"))
    return extra, tail.join(own.select("media_id", "bucket", "step"), ["media_id", "bucket"]).select("media_id", "step", F.col("seg_no").cast("long").alias("seg_no"))


def assign(steps: DataFrame, segments: DataFrame, *, mode: str = "previous", tail_step: str = "auto", bucket_s: float = 30.0, range_s: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignment(media_id, step, seg_no), extra steps): each segment by its middle under the step before it, or the nearest one.

    Recordings without steps have neither. A segment before the first step belongs to the first, one as far from two
    steps to the earlier; of steps at one time mode previous takes the last, nearest the first. A segment with a null time goes to
    the first step. Equal segments are assigned each; empty tables give empty ones; further columns are not read.
    A recording is sorted in one task, unless range_s deals it out in ranges of so many seconds.
    """
    if tail_step == "auto":
        within, _ = _tail(steps, segments)
        extra, late = tail_steps(steps, segments, bucket_s=bucket_s)
        return _at_steps(steps, within, mode, range_s).unionByName(late), extra
    known = segments.select("media_id", "seg_no", midpoint().alias("mid")).join(steps.select("media_id").distinct(), "media_id", "left_semi")
    none = steps.limit(0)
    return _at_steps(steps, known, mode, range_s), none


def all_steps(steps: DataFrame, extra: DataFrame) -> DataFrame:
    """Steps and extra steps with their place by time (ties: steps first, then by number); numbers stay as they are. Columns is_extra and place are replaced."""
    both = steps.withColumn("is_extra", F.lit(0)).unionByName(extra.withColumn("is_extra", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("media_id").orderBy("ts_s", "is_extra", "step"))
    return both.withColumn("place", place)
