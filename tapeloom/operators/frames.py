"""Frames of recordings: selection, thinning and numbering.

frames(media_id, ts_s, image, src, src_no, scene_score); src_no orders the sources at equal times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.timing import format_ts
from tapeloom.operators.chains import LONG, long_recordings, thinned
from tapeloom.operators.folds import folded

#: Rank of a frame's source at equal times.
SOURCES = {"start": 0, "scene": 1, "interval": 2}
ORDER = ("ts_s", "src_no", "image")


def scene_filter(frames: DataFrame, *, threshold: float = 0.45, max_frames: int = 160) -> DataFrame:
    """Frames whose score is above the threshold, of each recording the first max_frames by time; a null score is none. Of equal frames any may go; all columns pass through."""
    first = Window.partitionBy(frames["media_id"]).orderBy(*[frames[c] for c in ORDER])
    rows = frames.where(F.col("scene_score") > threshold).select(F.struct(*[frames[f"`{c}`"] for c in frames.columns]).alias("row"), F.row_number().over(first).alias("n"))
    return rows.where(F.col("n") <= max_frames).select("row.*")


def log_times(lines: DataFrame) -> DataFrame:
    """(media_id, line_no, ts_s): the times that an extractor's log lines(media_id, line_no, line) name."""
    found = F.regexp_extract("line", r"pts_time:([0-9]+(\.[0-9]+)?)", 1)
    return lines.where(F.contains("line", F.lit("showinfo"))).select("media_id", "line_no", found.alias("t")).where("t <> ''").select("media_id", "line_no", F.col("t").cast("double").alias("ts_s"))


def ordinal_zip(images: DataFrame, times: DataFrame) -> DataFrame:
    """(media_id, image, ts_s): the i-th image(media_id, image) by name with the i-th time(media_id, line_no, ts_s), as far as both go; in recordings without times i itself, from 0."""
    named = images.withColumn("i", F.row_number().over(Window.partitionBy("media_id").orderBy("image")))
    timed = times.select("media_id", "ts_s", F.row_number().over(Window.partitionBy("media_id").orderBy("line_no")).alias("i"), F.lit(True).alias("timed"))
    any_time = times.groupBy("media_id").agg(F.lit(True).alias("has_times"))
    joined = named.join(timed, ["media_id", "i"], "left").join(any_time, "media_id", "left")
    return joined.where("timed OR has_times IS NULL").select("media_id", "image", F.coalesce("ts_s", (F.col("i") - 1).cast("double")).alias("ts_s"))


def interval_frames(images: DataFrame, *, every_s: float = 2.0, max_frames: int = 160) -> DataFrame:
    """(media_id, image, ts_s): of each recording the first max_frames images by name, one every every_s seconds (a quarter at least) from 0."""
    place = F.row_number().over(Window.partitionBy("media_id").orderBy("image"))
    return images.select("media_id", "image", place.alias("i")).where(F.col("i") <= max_frames).select("media_id", "image", ((F.col("i") - 1) * max(0.25, every_s)).alias("ts_s"))


def frames_by_strategy(start: DataFrame, scene: DataFrame, interval: DataFrame, strategy: str = "hybrid", *, min_frames: int = 6) -> DataFrame:
    """Frames(media_id, ts_s, image, src, src_no) of the strategy: the start frame with scenes, with the interval grid, or with scenes
    and, where a recording then has fewer than min_frames, the grid too."""

    def tagged(df: DataFrame, src: str) -> DataFrame:
        return df.select("media_id", "ts_s", "image", F.lit(src).alias("src"), F.lit(SOURCES[src]).alias("src_no"))

    grid = tagged(interval, "interval")
    if strategy == "interval":
        return tagged(start, "start").unionByName(grid)
    primary = tagged(start, "start").unionByName(tagged(scene, "scene"))
    if strategy == "scene":
        return primary
    enough = primary.groupBy("media_id").count().where(F.col("count") >= min_frames).select("media_id")
    return primary.unionByName(grid.join(enough, "media_id", "left_anti"))


def _thinned(frames: DataFrame, keeps: Callable, gap: tuple[float, str], limit: int) -> DataFrame:
    """The frames that keeps(time, last kept time), on columns or arrays, lets stay, in the order of time: one fold over a recording's frames, or chunks of those of recordings of more than limit."""
    long = long_recordings(frames, limit)
    if long is not None:
        rest, far = frames.join(long, "media_id", "left_anti"), frames.join(long, "media_id", "left_semi")
        return _folded(rest, keeps).unionByName(thinned(far.select(frames.columns), ORDER, keeps, gap, limit))
    return _folded(frames, keeps)


def _folded(frames: DataFrame, keeps: Callable) -> DataFrame:
    rest = [c for c in frames.columns if c not in ("media_id", *ORDER)]
    row = F.struct(*ORDER, *rest)
    listed = frames.groupBy("media_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.struct(x["ts_s"].alias("last"), F.lit(True).alias("any"), F.array_append(acc["out"], x).alias("out"))
        return F.when(~acc["any"] | F.coalesce(keeps(x["ts_s"], acc["last"]), F.lit(True)), kept).otherwise(acc)

    zero = F.struct(F.lit(None).cast(frames.schema["ts_s"].dataType).alias("last"), F.lit(False).alias("any"), F.slice(F.col("rows"), 1, 0).alias("out"))
    kept = listed.select("media_id", F.explode(folded(F.col("rows"), zero, step)["out"]).alias("r"))
    return kept.select("media_id", *[F.col("r")[c].alias(c) for c in (*ORDER, *rest)]).select(frames.columns)


def dedupe_time(frames: DataFrame, *, eps: float = 0.05, limit: int = LONG) -> DataFrame:
    """Frames more than eps after the last one kept; the first of each recording stays. Null times sort first and stay; at equal times src_no and image order. All columns pass through, an empty table gives an empty one."""
    return _thinned(frames, lambda t, last: abs(t - last) > eps if not isinstance(t, Column) else F.abs(t - last) > eps, (eps, "right"), limit)


def min_gap(frames: DataFrame, *, gap: float = 0.9, limit: int = LONG) -> DataFrame:
    """Frames at least gap after the last one kept; all of them if gap isn't positive. Nulls, ties and columns as with dedupe_time()."""
    return frames if gap <= 0 else _thinned(frames, lambda t, last: t - last >= gap, (gap, "left"), limit)


def visual_steps(frames: DataFrame) -> DataFrame:
    """(media_id, step, ts_s, ts, image): frames numbered from 1 by time, with display time and forward slashes."""
    place = F.row_number().over(Window.partitionBy("media_id").orderBy(*ORDER))
    return frames.select("media_id", place.alias("step"), F.col("ts_s").cast("double").alias("ts_s"), format_ts("ts_s").alias("ts"), F.replace("image", F.lit("\\"), F.lit("/")).alias("image"))
