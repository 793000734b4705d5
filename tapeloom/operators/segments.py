"""Speech segments(media_id, seg_no, start_s, end_s, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.clean import clean_ws
from tapeloom.operators.chains import LONG, long_recordings, merged
from tapeloom.operators.folds import folded


def source_priority(segments: DataFrame, runs: DataFrame, *, retried: tuple[int, ...] = (0,), priority: str = "priority") -> DataFrame:
    """Of each recording the rows with text of the source that its search ends with.

    runs(media_id, priority, ok) says which sources ran and which failed. The search goes by priority
    and ends with the first that ran, whether or not it gave text; only those in retried give way to
    the next when they ran without text. A recording none of whose sources ran has no rows, as one has
    whose search ends with a source without text. A null ok is a failure; rows of runs that repeat count
    once; null texts and texts of white space are none.
    """
    clean = segments.withColumn("text", clean_ws(F.coalesce("text", F.lit("")))).where("text <> ''")
    filled = clean.groupBy("media_id", priority).agg(F.lit(True).alias("_filled"))
    ran = runs.where("ok").select("media_id", F.col(priority)).join(filled, ["media_id", priority], "left")
    ends = ran.where(F.col("_filled").isNotNull() | ~F.col(priority).isin(*retried)).groupBy("media_id").agg(F.min(priority).alias(priority))
    return clean.join(ends, ["media_id", priority], "left_semi").select(segments.columns)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def merge_segments(segments: DataFrame, *, min_words: int = 8, min_s: float = 2.5, limit: int = LONG) -> DataFrame:
    """Segments in their order, each absorbed by the one before while that has fewer than min_words words or lasts less than min_s.

    A merged segment ends where the last one absorbed ends. Segments without text go, and new numbers count from 1. A null time counts as
    long enough; segments of one number go by their times and text. Further columns are not read; an empty table gives an empty one.
    Recordings of more than limit segments are merged in chunks.
    """
    clean = segments.select("media_id", "seg_no", "start_s", "end_s", clean_ws(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    long = long_recordings(segments, limit)
    if long is None:
        return _folded(clean, min_words, min_s)
    part = merged(clean.join(long, "media_id", "left_semi").withColumn("_words", words(F.col("text"))), min_words, min_s, limit)
    order = F.struct("seg_no", "start_s", "end_s", "text")
    whole = part.groupBy("media_id", "g").agg(F.min_by("start_s", order).alias("start_s"), F.max_by("end_s", order).alias("end_s"), F.array_join(F.sort_array(F.collect_list(order))["text"], " ").alias("text"))
    return _folded(clean.join(long, "media_id", "left_anti"), min_words, min_s).unionByName(whole.select("media_id", F.col("g").cast("int").alias("seg_no"), "start_s", "end_s", "text"))


def _folded(clean: DataFrame, min_words: int, min_s: float) -> DataFrame:
    row = F.struct("seg_no", "start_s", "end_s", "text")
    listed = clean.groupBy("media_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    one = lambda x: F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s"), x["text"].alias("text"), words(x["text"]).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        short = (last["n"] < min_words) | (last["end_s"] - last["start_s"] < min_s)
        longer = F.struct(last["start_s"].alias("start_s"), x["end_s"].alias("end_s"), F.concat(last["text"], F.lit(" "), x["text"]).alias("text"), (last["n"] + words(x["text"])).alias("n"))
        absorbed = F.struct(acc["out"].alias("out"), longer.alias("last"))
        begun = F.struct(F.array_append(acc["out"], last).alias("out"), one(x).alias("last"))
        return F.when(short, absorbed).otherwise(begun)

    first = one(F.col("rows")[0])
    zero = F.struct(F.slice(F.array(first), 1, 0).alias("out"), first.alias("last"))
    done = folded(F.slice("rows", 2, F.size("rows")), zero, step)
    merged = F.transform(F.array(done), lambda acc: F.array_append(acc["out"], acc["last"]))[0]
    out = listed.select("media_id", F.posexplode(merged).alias("i", "s"))
    return out.select("media_id", (F.col("i") + 1).alias("seg_no"), "s.start_s", "s.end_s", "s.text")
