"""Documents of a recording: transcript, nested JSON and markdown, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.timing import format_ts


def transcript_text(media: DataFrame, segments: DataFrame) -> DataFrame:
    """(media_id, transcript): a line for each segment, by number, of every recording in media(media_id)."""
    line = F.concat(F.lit("["), format_ts("start_s"), F.lit("] "), F.col("text"))
    listed = segments.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", line.alias("line")))).alias("x"))
    text = F.concat(F.array_join("x.line", "\n"), F.lit("\n"))
    return media.select("media_id").distinct().join(listed, "media_id", "left").select("media_id", F.coalesce(text, F.lit("(no transcript)\n")).alias("transcript"))


def timeline_json(media: DataFrame, steps: DataFrame, segments: DataFrame) -> DataFrame:
    """(media_id, timeline): the recording's source, steps and segments as JSON, for every row of media(media_id, source)."""
    shown = steps.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("step", "ts_s", "ts", "image"))).alias("visual_steps"))
    place = F.row_number().over(Window.partitionBy("media_id").orderBy("seg_no"))
    spoken = segments.withColumn("step", place)
    spoken = spoken.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("step", "start_s", "end_s", format_ts("start_s").alias("start_ts"), format_ts("end_s").alias("end_ts"), "text"))).alias("transcript_steps"))
    joined = media.join(shown, "media_id", "left").join(spoken, "media_id", "left")
    whole = F.struct(F.col("source").alias("source_video"), *[F.coalesce(c, F.array()).alias(c) for c in ("visual_steps", "transcript_steps")])
    return joined.select("media_id", F.to_json(whole).alias("timeline"))


def step_markdown(media: DataFrame, steps: DataFrame, assignment: DataFrame, segments: DataFrame, *, title: str = "Recording") -> DataFrame:
    """(media_id, markdown): a document of all steps with their segments, for every row of media(media_id, name).

    steps come from all_steps(); a recording without segments says so at the end.
    """
    # the headings and marks below are fixed values
    span = F.concat(F.lit("   - `"), format_ts("start_s"), F.lit(" → "), format_ts("end_s"), F.lit("` — "), F.col("text"))
    spoken = assignment.join(segments.withColumn("seg_no", F.col("seg_no").cast("long")), ["media_id", "seg_no"])
    spoken = spoken.groupBy("media_id", "step").agg(F.sort_array(F.collect_list(F.struct("seg_no", span.alias("line")))).alias("x")).select("media_id", "step", F.col("x.line").alias("spoken"))
    head = F.array(F.concat(F.col("step").cast("string"), F.lit(". **"), F.col("ts"), F.lit("**")), F.lit(""), F.when(F.col("image") != "", F.concat(F.lit("   ![]("), F.col("image"), F.lit(")"))).otherwise("   _(Transcript-only step)_"), F.lit(""))
    tail = F.when(F.col("spoken").isNotNull(), F.concat(F.array(F.lit("   **Transcript:**")), "spoken", F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    lines = steps.join(spoken, ["media_id", "step"], "left").select("media_id", F.struct("place", F.concat(head, tail).alias("lines")).alias("s"))
    body = lines.groupBy("media_id").agg(F.flatten(F.sort_array(F.collect_list("s"))["lines"]).alias("body"))
    heard = segments.select("media_id").distinct().withColumn("heard", F.lit(True))
    heading = F.array(F.lit(f"# {title}"), F.lit(""), F.concat(F.lit("**Source:** `"), "name", F.lit("`")), F.lit(""), F.lit("## Steps"), F.lit(""))
    none = F.when(F.col("heard").isNull(), F.array(F.lit("_No transcript available._"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    joined = media.join(body, "media_id", "left").join(heard, "media_id", "left")
    return joined.select("media_id", F.array_join(F.concat(heading, F.coalesce("body", F.array().cast("array<string>")), none), "\n").alias("markdown"))
