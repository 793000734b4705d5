"""Queries: media are users, frames and segments are their events, texts are documents, turns and a text made of customers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import clean_text, clean_ws, format_ts, midpoint, redact_term_table, redact_text, redaction_hits
from tapeloom.operators import assign, frames, render, runlog, segments
from tapeloom.sources import out_name, redaction_report

TERMS = {"names": ("Oak", "Mary Poppins"), "orgs": (" Hi ", ""), "locations": ("Hill",)}

#: A text with all kinds of personal data for every customer; S stands for the text type.
PERSONAL = """SELECT c_custkey AS doc_id, concat('Hi, my name is ', CASE WHEN c_custkey % 2 = 0 THEN 'Anna Bell' ELSE 'Otto' END,
  '. Mail user', c_custkey, '@mail.example.com, call +1 (555) 201-', lpad(CAST(c_custkey % 10000 AS {S}), 4, '0'),
  ' or 555.301.', lpad(CAST(c_custkey % 10000 AS {S}), 4, '0'), ', SSN 123-45-', lpad(CAST(c_custkey % 10000 AS {S}), 4, '0'),
  ', card 4111 1111 1111 ', CAST(1000 + c_custkey % 9000 AS {S}), ', visit ', CAST(1 + c_custkey % 900 AS {S}), ' Oak Hill Road, zip ', CAST(10000 + c_custkey % 90000 AS {S}),
  ', on 2024-10-29 or October 29th, 2024, ref ', CAST(700000 + c_custkey AS {S}), ' signed Mary Poppins') AS text FROM customer"""
#: Texts that name parts, brands, customers and nations, and the table of terms for them; S stands for the text type.
ORDERED = """SELECT c_custkey AS doc_id, concat('Ship ', p.p_name, ' by ', p.p_brand, ' to ', c_name, ' in ', n_name, ', then a ', upper(q.p_name), ' ring of ', lower(q.p_brand), ', not ', p.p_type, '.') AS text
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN part p ON p.p_partkey = c_custkey % 200 JOIN part q ON q.p_partkey = c_custkey * 7 % 200"""
LISTED = """SELECT 'NAME' AS kind, p_name AS term FROM part UNION ALL SELECT 'NAME', concat(' ', split_part(p_name, ' ', 2)) FROM part UNION ALL SELECT 'org', p_brand FROM part UNION ALL SELECT 'LOCATION', n_name FROM nation UNION ALL SELECT 'LOCATION', concat(n_name, ', then') FROM nation"""
#: Turns with wrapped lines, marks after blanks, parentheses, quotes and other line ends.
WRAPPED = """SELECT conv_id, turn, CASE turn % 4
  WHEN 0 THEN replace(replace(text, ' de ', chr(10)), ', ', ' ,')
  WHEN 1 THEN concat('“', replace(text, ' the ', concat(' ', chr(10), 'the ')), '”', chr(13), chr(10), chr(10), chr(10), chr(10), 'end  of it')
  WHEN 2 THEN concat('( ', replace(text, ' ', '  '), ' )')
  ELSE replace(text, '. ', concat('.', chr(13), chr(10), chr(9))) END AS text FROM conversations"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many tasks as run at once, if it has fewer: masking is bound by the processor, and a small table is one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def personal(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(PERSONAL.format(S="STRING").replace("FROM customer", "FROM {c}"), c=spread(table(spark, d, "customer")))


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(WRAPPED.replace("FROM conversations", "FROM {c}"), c=spread(table(spark, d, "conversations")))


def events(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(at).over(Window.partitionBy("user_id"))
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("media_id"), "event_type", "value", "props", ((at - first) / 1e6).alias("ts_s"))


def all_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type IN ('view', 'click')")
    image = F.concat(F.lit("shots\\img_"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    return rows.select("media_id", "ts_s", image.alias("image"), F.lit("scene").alias("src"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("src_no"), (F.col("value") / 100).alias("scene_score"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    return frames.visual_steps(frames.min_gap(all_frames(spark, d).where("src_no = 0"), gap=3600.0))


def speech(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("media_id").orderBy("ts_s", "event_id"))
    return events(spark, d).where("event_type = 'error'").select("media_id", place.alias("seg_no"), F.col("ts_s").alias("start_s"), (F.col("ts_s") + F.col("value")).alias("end_s"), F.col("event_type").alias("text"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of chats as segments of a quarter second a word."""
    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.posexplode(F.split("text", "\\.")).alias("i", "raw"))
    parts = parts.select("media_id", "turn", "i", clean_ws("raw").alias("text")).where("text <> ''").withColumn("n", segments.words(F.col("text")))
    order = Window.partitionBy("media_id").orderBy("turn", "i")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return parts.select("media_id", F.row_number().over(order).alias("seg_no"), (0.25 * (upto - F.col("n"))).alias("start_s"), (0.25 * upto).alias("end_s"), "text")


def media(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("media_id"), F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("name")).distinct()


def images(spark: SparkSession, d: str, kind: str = "click") -> DataFrame:
    return events(spark, d).where(F.col("event_type") == kind).select("media_id", F.concat(F.lit("img_"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("image"), "event_id")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_type") == "view", "[showinfo] n:").otherwise("[other] n:"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, " pts:").otherwise(" pts_time:"), (F.col("event_id") % 1000).cast("string"), F.lit("."), (F.col("event_id") % 10).cast("string"), F.lit(" pts_time:7"))
    return events(spark, d).select("media_id", F.col("event_id").alias("line_no"), line.alias("line"))


def scene_filter(spark, d):
    return frames.scene_filter(all_frames(spark, d), threshold=0.45, max_frames=20).select("media_id", "ts_s", "image", "scene_score")


def log_extract(spark, d):
    return frames.log_times(log_lines(spark, d))


def ordinal_zip(spark, d):
    return frames.ordinal_zip(images(spark, d).drop("event_id"), frames.log_times(log_lines(spark, d)))


def interval_frames(spark, d):
    return frames.interval_frames(images(spark, d), every_s=2.0, max_frames=10)


def _sources(spark, d):
    start = media(spark, d).select("media_id", F.lit(0.0).alias("ts_s"), F.lit("start").alias("image"))
    scene = scene_filter(spark, d).select("media_id", "ts_s", "image")
    return start, scene, interval_frames(spark, d)


def frames_strategy(spark, d):
    return frames.frames_by_strategy(*_sources(spark, d), "interval")


def hybrid_frames(spark, d):
    return frames.frames_by_strategy(*_sources(spark, d), "hybrid", min_frames=20)


def dedupe_time(spark, d):
    return frames.dedupe_time(all_frames(spark, d), eps=1800.0).select("media_id", "ts_s", "image")


def min_gap(spark, d):
    return frames.min_gap(all_frames(spark, d), gap=3600.0).select("media_id", "ts_s", "image")


def visual_steps(spark, d):
    return steps(spark, d)


def source_priority(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).alias("priority"), F.when((F.col("conv_id") % 3 == 0) & (F.col("role") != "assistant"), "  ").otherwise(F.col("text")).alias("text"))
    runs = rows.select("media_id", "priority", F.lit(True).alias("ok")).distinct()
    return segments.source_priority(rows, runs).select("media_id", "turn", "priority", F.length("text").cast("long").alias("n"))


def merge_segments(spark, d):
    return segments.merge_segments(sentences(spark, d))


def assign_previous(spark, d):
    return assign.assign(steps(spark, d), speech(spark, d), mode="previous", bucket_s=86400.0)[0]


def assign_nearest(spark, d):
    return assign.assign(steps(spark, d), speech(spark, d), mode="nearest", bucket_s=86400.0)[0]


def assign_last(spark, d):
    return assign.assign(steps(spark, d), speech(spark, d), tail_step="last")[0]


def tail_steps(spark, d):
    return assign.tail_steps(steps(spark, d), speech(spark, d), bucket_s=86400.0)[0]


def all_steps(spark, d):
    own = steps(spark, d)
    return assign.all_steps(own, assign.tail_steps(own, speech(spark, d), bucket_s=86400.0)[0])


def transcript_text(spark, d):
    return render.transcript_text(media(spark, d), speech(spark, d))


def timeline_json(spark, d):
    names = media(spark, d).select("media_id", F.col("name").alias("source"))
    out = render.timeline_json(names, steps(spark, d), speech(spark, d))
    shape = "source_video string, visual_steps array<struct<step:int,ts:string,image:string>>, transcript_steps array<struct<step:int,start_ts:string,end_ts:string,text:string>>"
    t = F.from_json("timeline", shape)
    shown = F.array_join(F.transform(t["visual_steps"], lambda s: F.concat_ws(" ", s["step"].cast("string"), s["ts"], s["image"])), "|")
    spoken = F.array_join(F.transform(t["transcript_steps"], lambda s: F.concat_ws(" ", s["step"].cast("string"), s["start_ts"], s["end_ts"], s["text"])), "|")
    return out.select("media_id", t["source_video"].alias("source"), F.size(t["visual_steps"]).cast("long").alias("n_visual"), F.size(t["transcript_steps"]).cast("long").alias("n_transcript"), shown.alias("shown"), spoken.alias("spoken"))


def step_markdown(spark, d):
    own, said = steps(spark, d), speech(spark, d)
    given, extra = assign.assign(own, said, bucket_s=86400.0)
    return render.step_markdown(media(spark, d), assign.all_steps(own, extra), given, said)


def format_times(spark, d):
    return events(spark, d).select("event_id", format_ts(F.col("ts_s") - 5).alias("ts"), format_ts(F.col("value") * 10).alias("v"), midpoint(F.col("ts_s"), F.col("value")).alias("mid"))


def clean_whitespace(spark, d):
    return wrapped(spark, d).select("conv_id", "turn", clean_ws("text").alias("text"))


def clean_light(spark, d):
    return wrapped(spark, d).select("conv_id", "turn", clean_text("text", "light").alias("text"))


def clean_standard(spark, d):
    return wrapped(spark, d).select("conv_id", "turn", clean_text("text").alias("text"))


def redact_light(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", redact_text("text", "light").alias("text"))


def redact_standard(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", redact_text("text", "standard").alias("text"))


def redact_heavy(spark, d):
    return personal(spark, d).select("doc_id", redact_text("text", "heavy").alias("text"))


def redact_terms(spark, d):
    return personal(spark, d).select("doc_id", redact_text("text", "standard", **TERMS).alias("text"))


def redact_term_tables(spark, d):
    t = {name: table(spark, d, name) for name in ("customer", "nation", "part")}
    named = lambda sql: spark.sql(re.sub(r"\b(FROM|JOIN) (customer|nation|part)\b", r"\1 {\2}", sql), **t)
    return redact_term_table(named(ORDERED), named(LISTED)).select("doc_id", F.col("redacted").alias("text"), F.size("hits").cast("long").alias("n_hits"))


def redact_hit_places(spark, d):
    found = redaction_hits(personal(spark, d), level="heavy").select("doc_id", "text", F.inline("hits"))
    return found.select("doc_id", "pass_no", "label", "match", "orig_start", "orig_end", F.substring("text", F.col("orig_start") + 1, F.col("orig_end") - F.col("orig_start")).alias("original"))


def redact_hits(spark, d):
    return redaction_hits(personal(spark, d), level="heavy").select("doc_id", F.inline("hits")).select("doc_id", "pass_no", "label", "match", "start", "end")


def redaction_counts(spark, d):
    # inline() takes the array once; fields of an exploded struct would each be computed from the text anew
    return redaction_hits(spread(table(spark, d, "documents")), level="standard").select(F.inline("hits")).groupBy("label").agg(F.count("*").alias("n"))


def report(spark, d):
    return redaction_hits(personal(spark, d)).select("doc_id", redaction_report("hits").alias("report"))


def clean_redact(spark, d):
    name = F.concat(F.lit("in/t."), F.col("doc_id").cast("string"), F.lit(".txt"))
    return personal(spark, d).select("doc_id", out_name(name, "standard", "heavy").alias("out_name"), redact_text(clean_text("text"), "heavy").alias("text"))


def _payload():
    k = F.col("event_id") % 5
    return F.when(k == 0, F.lit("[1]")).when(k == 1, F.lit("{bad")).when(k == 2, F.lit('{"name": null}')).otherwise(F.col("props"))


def payload_valid(spark, d):
    return table(spark, d, "events").select("event_id", runlog.payload_valid(_payload()).alias("valid"))


def payload_faults(spark, d):
    return table(spark, d, "events").groupBy(F.coalesce(runlog.payload_fault(_payload()), F.lit("accepted")).alias("reason"), "event_type").agg(F.count("*").alias("n"))


def payload_default(spark, d):
    payload = F.when(runlog.payload_valid(_payload()), _payload())
    rows = table(spark, d, "events").select("event_id", F.from_json(payload, "map<string,string>").alias("m"))
    m = runlog.payload_default(F.col("m"), "name", "friend")
    named = F.when(F.col("m").isNull(), "(no object)").otherwise(F.coalesce(m["name"], F.lit("(null)")))
    return rows.select("event_id", named.alias("name"), F.when(F.col("m").isNull(), 0).otherwise(F.size(m)).cast("long").alias("n"))


def log_tail(spark, d):
    log = table(spark, d, "events").select("ts", "event_id", F.col("event_type").alias("agent"), (F.col("value") < 400).alias("ok"))
    return runlog.log_tail(log, 20).select("event_id", "agent", runlog.exit_code("ok").alias("code"))


QUERIES = {
    f.__name__: f
    for f in (
        scene_filter, log_extract, ordinal_zip, interval_frames, frames_strategy, hybrid_frames, dedupe_time, min_gap, visual_steps, source_priority, merge_segments,
        assign_previous, assign_nearest, assign_last, tail_steps, all_steps, transcript_text, timeline_json, step_markdown, format_times, clean_whitespace, clean_light, clean_standard,
        redact_light, redact_standard, redact_heavy, redact_terms, redact_term_tables, redact_hits, redact_hit_places, redaction_counts, report, clean_redact, payload_valid, payload_faults, payload_default, log_tail,
    )
}
