from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.clean import clean_text
from tapeloom.functions.redact import redact_text
from tapeloom.functions.timing import format_ts
from tapeloom.sources.files import split_payloads


def redact_stream(texts: DataFrame, *, clean: str | None = "standard", level: str = "light", text_col: str = "text", **terms) -> DataFrame:
    """texts cleaned and masked; stateless, so any stream or table does."""
    c = clean_text(text_col, clean) if clean else F.col(text_col)
    return texts.withColumn(text_col, redact_text(c, level, **terms))


class _Gap(StatefulProcessor):
    """Keeps the time of the last frame kept; frames of a batch come in the order of time."""

    def __init__(self, gap: float, ttl_ms: int | None):
        self.gap, self.ttl_ms = gap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_s double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        frames = pd.concat(rows).sort_values(["ts_s", "image"], kind="stable")
        keep = []
        for t in frames["ts_s"]:
            kept = last is None or t - last >= self.gap
            keep.append(kept)
            last = t if kept else last
        if last is not None:
            self.last.update((float(last),))
        yield frames[keep][["media_id", "ts_s", "image"]]

    def close(self) -> None:
        pass


def thin_stream(frames: DataFrame, *, gap: float = 0.9, ttl_hours: float | None = None) -> DataFrame:
    """Streamed frames(media_id, ts_s, image) at least gap after the last one kept of their recording. Frames of a later batch that are earlier in time than it go.

    The state of a recording is one number. With ttl_hours it goes that long after the recording's last
    frame was kept, by the clock, and a frame that comes later still begins anew; else it stays.
    """
    ttl, mode = (int(ttl_hours * 3_600_000), "ProcessingTime") if ttl_hours else (None, "None")
    return frames.groupBy("media_id").transformWithStateInPandas(_Gap(gap, ttl), "media_id long, ts_s double, image string", "Append", mode)


class _Timed(StatefulProcessor):
    """State of a recording under event time: one timer, for the first time at which something is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def wake(self, ms: int) -> None:
        if self.due.exists():
            if self.due.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def close(self) -> None:
        pass


def _ms(at: pd.Series) -> list[int]:
    return (at.astype("datetime64[us]").astype("int64") // 1000).tolist()


class _EventGap(_Timed):
    """Frames wait until the watermark has passed them, so that they are thinned in the order of time however they come."""

    def __init__(self, gap: float, idle_ms: int):
        self.gap, self.idle_ms = gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts_s double, ms long")
        self.waiting = handle.getListState("waiting", "ts_s double, image string, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            new = list(zip(df["ts_s"].tolist(), df["image"].tolist(), _ms(df["at"]), strict=True))
            if new:
                self.waiting.appendList(new)
                self.wake(min(x[2] for x in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[2] <= now], [r for r in rows if r[2] > now]
        last, ms = self.last.get() if self.last.exists() else (None, now)
        kept = []
        for t, image, at in sorted(ready, key=lambda r: (r[0], r[1] or "")):
            if last is None or t - last >= self.gap:
                kept.append((key[0], t, image))
                last = t
            ms = max(ms, at)
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.wake(min(r[2] for r in rest))
        if rest or now < ms + self.idle_ms:
            self.last.update((float(last), int(ms)))
            self.wake(ms + self.idle_ms)
        else:
            self.last.clear()
        if kept:
            yield pd.DataFrame(kept, columns=["media_id", "ts_s", "image"])


def thin_by_event_time(frames: DataFrame, *, gap: float = 0.9, late: str = "1 minute", idle_s: float = 3600.0) -> DataFrame:
    """Streamed frames(media_id, ts_s, image, at) at least gap after the last one kept of their recording, as min_gap() keeps them.

    at is the frame's time by the clock, in the same order as ts_s. A frame waits until the watermark, which is `late` behind the latest one, has
    passed it, so frames may come out of order by that much; later ones are dropped. A recording's state is its waiting frames and one
    time; it goes idle_s after its last frame by event time, and a frame that comes later still begins anew. Rows with a null at are dropped. Needs a
    state store of column families (RocksDB).
    """
    kind = frames.schema["media_id"].dataType.simpleString()
    rows = frames.select("media_id", "ts_s", "image", "at").withWatermark("at", late)
    return rows.groupBy("media_id").transformWithStateInPandas(_EventGap(gap, int(idle_s * 1000)), f"media_id {kind}, ts_s double, image string", "Append", "EventTime")


class _Tail(_Timed):
    """The last step of a recording, and the segments after it."""

    def __init__(self, bucket_s: float, idle_ms: int):
        self.bucket_s, self.idle_ms = bucket_s, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts_s double, step int")
        self.seen = handle.getValueState("seen", "ms long")
        self.tail = handle.getListState("tail", "mid double, start_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        steps, said = df[df["step"].notna()], df[df["step"].isna()]
        last = self.last.get() if self.last.exists() else None
        if len(steps):
            found = (float(steps["ts_s"].max()), int(steps["step"].max()))
            last = found if last is None else (max(last[0], found[0]), max(last[1], found[1]))
            self.last.update(last)
        mids = ((said["start_s"] + said["end_s"]) / 2.0).tolist()
        new = [(m, s) for m, s in zip(mids, said["start_s"].tolist(), strict=True) if m == m and (last is None or m > last[0])]
        if len(steps) and self.tail.exists():
            new = [(m, s) for m, s in self.tail.get() if m > last[0]] + new
            self.tail.clear()
        if new:
            self.tail.appendList(new)
        ms = max([*_ms(df["at"]), self.seen.get()[0] if self.seen.exists() else 0])
        self.seen.update((ms,))
        self.wake(ms + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        ends = self.seen.get()[0] + self.idle_ms
        if timerValues.getCurrentWatermarkInMs() < ends:  # more has come since
            self.wake(ends)
            return
        first: dict[float, float] = {}
        if self.last.exists() and self.tail.exists():
            for mid, start in self.tail.get():
                b = math.floor(mid / self.bucket_s)
                first[b] = min(start, first.get(b, start))
        rows = [(key[0], self.last.get()[1] + 1 + i, first[b]) for i, b in enumerate(sorted(first))]
        for state in (self.last, self.seen, self.tail):
            state.clear()
        if rows:
            yield pd.DataFrame(rows, columns=["media_id", "step", "ts_s"])


def tail_step_stream(rows: DataFrame, *, bucket_s: float = 30.0, late: str = "1 minute", idle_s: float = 3600.0) -> DataFrame:
    """The extra steps that tail_steps() gives, of streamed rows(media_id, at, step, ts_s, start_s, end_s) in any order: steps, and segments, whose step is null.

    A recording ends when no row of it has come for idle_s of event time; then each bucket of bucket_s seconds after its last step
    that has any segment becomes a step, numbered on, at its earliest start, and the state goes. Until then it is the last step and the
    segments after it. Rows later than `late` behind the latest are dropped; recordings without steps, and segments without a middle, give nothing. Needs RocksDB.
    """
    kind = rows.schema["media_id"].dataType.simpleString()
    own = rows.select("media_id", F.col("step").cast("double").alias("step"), "ts_s", "start_s", "end_s", "at").withWatermark("at", late)
    found = own.groupBy("media_id").transformWithStateInPandas(_Tail(bucket_s, int(idle_s * 1000)), f"media_id {kind}, step int, ts_s double", "Append", "EventTime")
    return found.select("media_id", "step", "ts_s", format_ts("ts_s").alias("ts"), F.lit("").alias("image"))


def split_stream(runs: DataFrame, path: str, checkpoint: str, payload: str = "payload"):
    """A writer of streamed runs that splits each batch as split_payloads() does."""
    return runs.writeStream.foreachBatch(lambda batch, _: split_payloads(batch, path, payload) and None).option("checkpointLocation", checkpoint)


def tail_bucket_stream(segments: DataFrame, *, bucket: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(media_id, bucket, start): the first time of every bucket of streamed segments(media_id, ts), once no more can come."""
    by = segments.withWatermark("ts", late).groupBy("media_id", F.window("ts", bucket))
    return by.agg(F.min("ts").alias("start")).select("media_id", F.col("window.start").alias("bucket"), "start")


def log_stream(runs: DataFrame, path: str, checkpoint: str):
    """A writer that appends streamed runs to the run log as lines of JSON."""
    return runs.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
