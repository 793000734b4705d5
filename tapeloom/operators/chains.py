"""Groups that follow from each other along a recording, for recordings too long for one task.

Where each row's group ends follows from the row it begins with, so a recording can be cut into chunks:
a chunk says, for every way in which the chunks before can end, how it ends itself; going through those
short tables gives the state with which each chunk begins; then chunks are done side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

#: Rows of a recording that one task takes at a time.
LONG = 100_000


def long_recordings(rows: DataFrame, limit: int) -> DataFrame | None:
    """(media_id) of those with more than limit rows; None without any. A count by recording finds out."""
    found = rows.groupBy("media_id").count().where(F.col("count") > limit).select("media_id")
    return found if found.head(1) else None


def chunked(rows: DataFrame, by: Column, limit: int) -> DataFrame:
    """rows with _chunk: ranges of `by` of equal width, as many for a recording as make chunks of limit rows where its rows are spread evenly."""
    at = by.cast("double")
    span = rows.groupBy("media_id").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.ceil(F.count("*") / limit).alias("_n"))
    share = F.coalesce(F.try_divide(at - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return rows.join(span, "media_id").withColumn("_chunk", F.least(F.floor(share * F.col("_n")), F.col("_n") - 1)).drop("_lo", "_hi", "_n")


def _ends(follows: np.ndarray) -> np.ndarray:
    """Of every row the last group start that is reached from it within the chunk; follows: the start of the group after one that begins at a row."""
    n = len(follows)
    end = np.where(follows < n, follows, np.arange(n))
    while (further := end[end] != end).any():
        end[further] = end[end[further]]
    return end


def _next_kept(t: np.ndarray, keeps: Callable, gap: tuple[float, str]) -> np.ndarray:
    """Of every time the place of the first later one that keeps(time, last) lets stay."""
    n = len(t)
    at = np.maximum(np.searchsorted(t, t + gap[0], gap[1]), np.arange(n) + 1)
    while (back := (at - 1 > np.arange(n)) & keeps(t[np.maximum(at - 1, 0)], t)).any():  # rounding of the sum
        at[back] -= 1
    while (on := (at < n) & ~keeps(t[np.minimum(at, n - 1)], t)).any():
        at[on] += 1
    return at


def thinned(frames: DataFrame, order: tuple[str, ...], keeps: Callable, gap: tuple[float, str], limit: int = LONG) -> DataFrame:
    """frames of long recordings that keeps(time, last kept time) lets stay by the first of order, a time, each against the last one kept.

    keeps works on arrays, and once true stays so for later times; gap is the one that it asks for, and the side of equal times on which that ends (left: they stay). Frames without a time, or with one
    that is no number, stay.
    """
    time = order[0]
    timed = F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double"))
    packed = frames.where(timed).select("media_id", F.struct(*[F.col(c) for c in order if c != time], *[F.col(c) for c in frames.columns if c not in order]).alias("_row"), F.col(time).cast("double").alias("_t"), F.col(time))
    rows = chunked(packed.withColumn("_key", F.struct(*[F.col(f"_row.{c}") for c in order if c != time])), F.col("_t"), limit)
    media = frames.schema["media_id"]
    table = StructType([media, StructField("_chunk", LongType()), StructField("upto", DoubleType()), StructField("end", DoubleType())])

    def summary(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(own["_t"].to_numpy(np.float64))
        end = t[_ends(_next_kept(t, keeps, gap))]
        # a chunk is entered by a time before its first one, so by one of the frames up to the first that this one would keep
        n = int(_next_kept(t, keeps, gap)[0]) + 1
        t, end = t[:n], end[:n]
        last = np.append(end[1:] != end[:-1], True)
        return pd.DataFrame({"media_id": key[0], "_chunk": key[1], "upto": t[last], "end": end[last]})

    def through(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own, last, out = own.sort_values(["_chunk", "upto"]), None, []
        for chunk, part in own.groupby("_chunk"):
            out.append((key[0], chunk, last))
            upto, end = part["upto"].to_numpy(), part["end"].to_numpy()
            way = np.flatnonzero(np.ones(len(upto), bool) if last is None else keeps(upto, last))
            last = last if not len(way) else end[way[0]]
        return pd.DataFrame(out, columns=["media_id", "_chunk", "_entered"])

    ends = rows.select("media_id", "_chunk", "_t").groupBy("media_id", "_chunk").applyInPandas(summary, table)
    entered = ends.groupBy("media_id").applyInPandas(through, StructType([media, StructField("_chunk", LongType()), StructField("_entered", DoubleType())]))
    place = F.row_number().over(Window.partitionBy("media_id", "_chunk").orderBy("_t", "_key"))
    rows = rows.join(entered, ["media_id", "_chunk"]).withColumn("_place", place)

    def chosen(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_place")
        t, entered = own["_t"].to_numpy(np.float64), own["_entered"].iloc[0]
        first = np.flatnonzero(np.ones(len(t), bool) if np.isnan(entered) else keeps(t, entered))
        follows, at, kept = _next_kept(t, keeps, gap), int(first[0]) if len(first) else len(t), []
        while at < len(t):
            kept.append(at)
            at = int(follows[at])
        return pd.DataFrame({"media_id": key[0], "_chunk": key[1], "_place": own["_place"].to_numpy()[kept]})

    shape = StructType([media, StructField("_chunk", LongType()), StructField("_place", LongType())])
    kept = rows.select("media_id", "_chunk", "_t", "_entered", "_place").groupBy("media_id", "_chunk").applyInPandas(chosen, shape)
    met = rows.join(kept, ["media_id", "_chunk", "_place"])
    return met.select(*["media_id" if c == "media_id" else F.col(time) if c == time else F.col(f"_row.`{c}`").alias(c) for c in frames.columns]).unionByName(frames.where(~timed))


def merged(segments: DataFrame, min_words: int, min_s: float, limit: int = LONG) -> DataFrame:
    """(media_id, g, seg_no, start_s, end_s, text): segments of long recordings with the number, from 1, of the merged one that they are part of.

    segments has _words, how many words each has. A group ends with the first segment that brings it to min_words words and to a length of min_s or more.
    """
    media = segments.schema["media_id"]
    key = F.struct("seg_no", "start_s", "end_s", "text")
    rows = chunked(segments, F.col("seg_no"), limit)
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("media_id", "_chunk").orderBy(key)))
    # the latest start of all chunks before: with it a group entered is over as late as any can be
    latest = rows.groupBy("media_id", "_chunk").agg(F.max("start_s").alias("x"))
    before = Window.partitionBy("media_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(latest.select("media_id", "_chunk", F.max("x").over(before).cast("double").alias("_latest")), ["media_id", "_chunk"])
    small = rows.select("media_id", "_chunk", "_place", F.col("start_s").cast("double").alias("_start"), F.col("end_s").cast("double").alias("_end"), "_words", "_latest")

    def arrays(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = own.sort_values("_place")
        return own["_start"].to_numpy(np.float64), own["_end"].to_numpy(np.float64), np.concatenate(([0], np.cumsum(own["_words"].to_numpy(np.int64))))

    def over(start: float, held: int, i: int, end: np.ndarray, upto: np.ndarray) -> int:
        """The place after the first row from i on with which a group of that start, which held no words up to `held`, is over."""
        k = max(i + 1, int(np.searchsorted(upto, held + min_words)))
        while k <= len(end) and end[k - 1] - start < min_s:
            k += 1
        return min(k, len(end))

    def following(start: np.ndarray, end: np.ndarray, upto: np.ndarray) -> np.ndarray:
        return np.array([over(s, n, i, end, upto) for i, (s, n) in enumerate(zip(start.tolist(), upto.tolist(), strict=False))], np.int64)

    fields = [("j", LongType()), ("words", LongType()), ("prev_end", DoubleType()), ("groups", LongType()), ("out_start", DoubleType()), ("out_words", LongType()), ("out_end", DoubleType())]

    def summary(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        """For j segments of the chunk that a group entered takes in: their words and last end; the groups that begin after them, and the last of those."""
        start, end, upto = arrays(own)
        n, follows = len(start), following(start, end, upto)
        latest = own["_latest"].iloc[0]
        most = 0 if key[1] == 0 else n if pd.isna(latest) else over(latest, 0, 0, end, upto)
        groups, last = np.ones(n, np.int64), np.arange(n)
        for i in range(n - 1, -1, -1):
            if follows[i] < n:
                groups[i], last[i] = groups[follows[i]] + 1, last[follows[i]]
        j = np.arange(min(most, n) + 1)
        begins = np.minimum(j, n - 1)
        inside = j < n
        held = upto[n] - upto[last[begins]]
        return pd.DataFrame({"media_id": key[0], "_chunk": key[1], "j": j, "words": upto[j], "prev_end": np.where(j > 0, end[np.maximum(j - 1, 0)], np.nan), "groups": np.where(inside, groups[begins], 0), "out_start": np.where(inside, start[last[begins]], np.nan), "out_words": np.where(inside, held, 0), "out_end": end[n - 1]})

    def through(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own, state, g, out = own.sort_values(["_chunk", "j"]), None, 0, []
        for chunk, part in own.groupby("_chunk"):
            rows = part.to_dict("records")
            at = 0
            if state is not None:
                start, words, end = state
                while at < len(rows) - 1 and (words + rows[at]["words"] < min_words or (rows[at]["prev_end"] if at else end) - start < min_s):
                    at += 1
            r = rows[at]
            out.append((key[0], chunk, at, g))
            g += r["groups"]
            state = (r["out_start"], r["out_words"], r["out_end"]) if r["groups"] else (state[0], state[1] + r["words"], r["out_end"])
        return pd.DataFrame(out, columns=["media_id", "_chunk", "_at", "_g"])

    ends = small.groupBy("media_id", "_chunk").applyInPandas(summary, StructType([media, StructField("_chunk", LongType()), *[StructField(n, t) for n, t in fields]]))
    entered = ends.groupBy("media_id").applyInPandas(through, StructType([media, StructField("_chunk", LongType()), StructField("_at", LongType()), StructField("_g", LongType())]))

    def numbered(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        start, end, upto = arrays(own)
        follows, new = following(start, end, upto), np.zeros(len(start), np.int64)
        at = int(own["_at"].iloc[0])
        while at < len(new):
            new[at] = 1
            at = int(follows[at])
        return pd.DataFrame({"media_id": key[0], "_chunk": key[1], "_place": np.sort(own["_place"].to_numpy()), "g": own["_g"].iloc[0] + np.cumsum(new)})

    marked = small.join(entered, ["media_id", "_chunk"]).groupBy("media_id", "_chunk").applyInPandas(numbered, StructType([media, StructField("_chunk", LongType()), StructField("_place", LongType()), StructField("g", LongType())]))
    return rows.join(marked, ["media_id", "_chunk", "_place"]).select("media_id", "g", "seg_no", "start_s", "end_s", "text")
