"""Removal of boilerplate lines by the number of distinct sites that carry them.

HyperLogLog sketches of sites and of texts for each line hash merge by aggregation; lines near the
threshold get exact distinct counts. A line must stand in many distinct texts too, so that a
document copied whole to many sites keeps its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from tapeloom.llm.common import cut, fitting, parts

BLANK = " \t\r"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def boilerplate(docs: DataFrame, *, min_sites: int = 10, max_chars: int | None = None, lg_k: int = 12, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(line_key) of the lines, white space at their ends apart, on min_sites sites and in min_sites texts or more.

    Estimates decide beyond a margin of a tenth and one on either side of the threshold, which is over
    six standard errors of a sketch of lg_k 12; exact counts decide within. Blank lines never count,
    nor those longer than max_chars if given. Null sites and null texts count as none.
    """
    lines = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text_key"), F.col(site_col).cast("string").alias("site"), F.explode(F.split(text_col, "\n")).alias("line"))
    lines = lines.where(F.btrim("line", F.lit(BLANK)) != "")
    if max_chars is not None:
        lines = lines.where(F.length("line") <= max_chars)
    lines = lines.select(_key(F.col("line")).alias("line_key"), "text_key", "site")
    low, high = int(min_sites * 0.9) - 1, -(-min_sites * 11 // 10) + 1
    spread = lines.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.hll_sketch_estimate(F.hll_sketch_agg("text_key", lg_k)).alias("texts"))
    likely = cut(spread.where((F.col("sites") >= low) & (F.col("texts") >= low)))
    sure = likely.where((F.col("sites") > high) & (F.col("texts") > high)).select("line_key")
    near = cut(likely.where((F.col("sites") <= high) | (F.col("texts") <= high)).select("line_key"))
    exact = lines.join(fitting(near), "line_key").groupBy("line_key").agg(F.countDistinct("site").alias("sites"), F.countDistinct("text_key").alias("texts"))
    return sure.union(exact.where((F.col("sites") >= min_sites) & (F.col("texts") >= min_sites)).select("line_key"))


def _line_keys(lines: list[bytes]) -> np.ndarray:
    """The keys that _key() gives the lines."""
    return np.array([xxh64_intdigest(x.strip(BLANK.encode()), 42) for x in lines], np.uint64).view(np.int64)


def _without(docs: DataFrame, keys: np.ndarray, text_col: str, counts: bool) -> DataFrame:
    """docs(row, text_col, n_lines, n_removed) with the lines of keys taken from text_col; with counts the lines are counted first."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = sent.value
        for batch, texts in parts(batches, 1, 1 << 22):
            null = batch.column(1).is_null().to_pylist()
            lines = [[] if none else t.encode("utf-8", "replace").split(b"\n") for t, none in zip(texts, null, strict=True)]
            ends = np.cumsum([0] + [len(x) for x in lines])
            every = [x for own in lines for x in own]
            found = _line_keys(every)
            at = np.minimum(np.searchsorted(bad, found), len(bad) - 1)
            goes = (bad[at] == found) & np.array([bool(x.strip(BLANK.encode())) for x in every], bool) if len(bad) and every else np.zeros(len(every), bool)
            removed = np.add.reduceat(np.append(goes, False), ends[:-1]) * (np.diff(ends) > 0) if len(lines) else np.zeros(0, np.int64)
            for i in np.flatnonzero(removed):
                texts[i] = b"\n".join(x for x, out in zip(lines[i], goes[ends[i] : ends[i + 1]], strict=True) if not out).decode()
            text = pa.array([None if none else t for t, none in zip(texts, null, strict=True)], pa.string())
            n_lines = pa.array(np.diff(ends), pa.int64()) if counts else batch.column(2)
            before = 0 if counts else batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), text, n_lines, pa.array(removed + before, pa.int64())], names=["row", "text", "n_lines", "n_removed"])

    shape = StructType([docs.schema["row"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return docs.mapInArrow(run, shape)


def dedup_lines(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", keys_per_pass: int = 8_000_000, **bounds) -> DataFrame:
    """docs with boilerplate lines taken from text_col, and the columns _n_lines and _n_removed.

    No row goes, even if none of its lines stays (its text is then empty). Nulls: a null text stays
    null and has no lines; a null site spreads nothing, but its row's lines go like others. Repeated
    rows count once and are treated alike. All other columns pass through; those that docs has under
    the two names are replaced. bounds are those of boilerplate(). Only the keys of lines to remove are
    broadcast, keys_per_pass of them at a time, 8 bytes each; where there are more, the texts are
    written once a pass. Texts are never shuffled.
    """
    found = cut(boilerplate(docs, text_col=text_col, site_col=site_col, **bounds))
    passes = max(1, -(-found.count() // keys_per_pass))
    rest = [c for c in docs.columns if c not in (text_col, "_n_lines", "_n_removed")]
    rows = docs.select(F.struct(F.lit(True).alias("is"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for i in range(passes):
        keys = found.where(F.pmod("line_key", F.lit(passes)) == i).toArrow().column("line_key").to_numpy()
        rows = _without(rows if i == 0 else cut(rows), keys, "text", i == 0)
    own = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | {text_col: F.col("text")}
    return rows.select(*[own[c].alias(c) for c in docs.columns if c in own], F.col("n_lines").alias("_n_lines"), F.col("n_removed").alias("_n_removed"))


#: The same rows by exact counts of all lines.
ORACLE = """
WITH docs AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT text, source, trim(unnest(lines), ' ' || chr(9) || chr(13)) AS line FROM docs WHERE text IS NOT NULL),
bad AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10 AND count(DISTINCT text) >= 10),
numbered AS (SELECT text, unnest(lines) AS raw, generate_subscripts(lines, 1) AS i FROM (SELECT DISTINCT text, lines FROM docs WHERE text IS NOT NULL)),
kept AS (
  SELECT n.text, count(*) AS n_lines, count(b.line) AS n_removed, coalesce(string_agg(n.raw, chr(10) ORDER BY n.i) FILTER (WHERE b.line IS NULL), '') AS clean
  FROM numbered n LEFT JOIN bad b ON trim(n.raw, ' ' || chr(9) || chr(13)) = b.line GROUP BY n.text)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, k.clean AS text
FROM docs d LEFT JOIN kept k ON d.text = k.text
"""
