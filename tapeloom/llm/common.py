"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: bytes of an Arrow batch that goes to a Python worker, and rows that are read at once. Bounds of memory alone.
LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 1024}
#: Bytes of rows that a task holds until it writes them as one row group, and of a page of a column: arrays of more than half a
#: megabyte take up whole regions of an executor's heap, which fragments it.
GROUP, PAGE = 16 << 20, 128 << 10
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, one of our own if all runs on one machine; else RuntimeError, as executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-tapeloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def lean(spark: SparkSession) -> dict[str, str]:
    """Set the settings of LEAN that the session has higher or without a bound; returns what those were."""
    asked = {}
    for name, most in LEAN.items():
        own = spark.conf.get(name)
        if own.startswith("-") or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own) > most:
            asked[name] = own
            spark.conf.set(name, str(most))
    return asked


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends there, so lost executors do not lose it, and its size on disk is known to
    the planner: a join with it becomes a broadcast join only below autoBroadcastJoinThreshold.
    Settings are those of LEAN meanwhile, where the session does not ask for less; its own are put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tapeloom-{uuid.uuid4().hex}"
    asked = lean(spark)
    try:
        df.write.option("parquet.block.size", GROUP).option("parquet.page.size", PAGE).option("parquet.dictionary.page.size", PAGE).parquet(path)
    finally:
        for name, own in asked.items():
            spark.conf.set(name, own)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fitting(df: DataFrame, rows: int = 4_000_000, size: int = 64 << 20) -> DataFrame:
    """df, a cut table, marked for a broadcast if it has no more than rows rows and size bytes of files; else a shuffle does."""
    on_disk = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if on_disk <= size and df.count() <= rows else df


def slices(texts: list[str], limit: int) -> Iterator[slice]:
    """Consecutive slices of texts of about limit characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers from each start on, as many as its size, one run after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of x in order, where each stands first, and the place of each of x among them, by one sort."""
    order = np.argsort(x, kind="stable")
    ahead = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ahead[1:] != ahead[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ahead[new], order[new], at


def give_back() -> None:
    """Return a process's free memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in consecutive parts of about limit bytes of text, one row at least, with the texts of a column (null: empty).

    Only a part's texts are Python objects at a time, so that a worker's memory does not grow with a batch.
    At the end what is free goes back to the system, as a worker waits for its next task beside others.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(start, end - start)
            yield part, part.column(column).fill_null("").to_pylist()
            start = end
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
