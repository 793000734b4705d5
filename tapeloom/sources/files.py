from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from uuid import uuid4

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from tapeloom.operators.runlog import payload_fault

#: What the executors' file systems call schemes of Hadoop's.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
LOG = "ts timestamp, agent string, payload string, ok boolean, summary string, data string"


def _as_glob(item: str) -> str:
    """item with what globs of the shell know (* ? and sets) kept and what only the file system's own globs know taken literally."""
    return re.sub(r"[{}\\]|\[(?!.[^/]*\])", r"\\\g<0>", item)


def _matcher(glob: str) -> str:
    """A pattern for the paths that a glob of _as_glob() names; like the shell's, none of its wildcards stands for a dot at the start of a name."""
    out, i = [], 0
    while i < len(glob):
        c, first = glob[i], i == 0 or glob[i - 1] == "/"
        end = glob.find("]", i + 2) if c == "[" else -1
        if c in "*?" or end > 0:
            out.append(("(?!\\.)" if first else "") + {"*": "[^/]*", "?": "[^/]"}.get(c, ""))
        if end > 0:
            inner = glob[i + 1 : end]
            out.append(f"[{'^' * (inner[0] in '!^')}{re.sub(r'([\\[&^])', r'\\\\\1', inner[inner[0] in '!^':])}]")
            i = end
        elif c not in "*?":
            i += c == "\\"
            out.append(re.escape(glob[i]))
        i += 1
    return "".join(out)


def _empty(jvm, found) -> list[str]:
    """Paths of the empty files among statuses, which come over as one text."""
    told = re.findall(r"path=(.*?); isDirectory=(?:true|false); length=(\d+);", jvm.scala.collection.mutable.ArraySeq.make(found).mkString("\n"), re.S)
    if len(told) != len(found):
        told = [(x.getPath().toString(), str(x.getLen())) for x in found]
    return [p for p, n in told if n == "0"]


def _unseen(glob: str) -> str:
    """The glob of those of its files whose names begin with an underscore, which Spark's readers pass over."""
    folder, _, name = glob.rpartition("/")
    lead = {"*": "_" + name, "?": "_" + name[1:], "_": name}.get(name[:1]) or ("_" + name.partition("]")[2] if name[:1] == "[" and "_" in name.partition("]")[0] else "")
    return lead and (f"{folder}/{lead}" if folder or glob.startswith("/") else lead)


def read_texts(spark: SparkSession, inputs: Sequence[str]) -> DataFrame:
    """(path, input_no, text) of the text files that paths and globs name: bad bytes replaced, line feeds for all line ends, empty files as empty texts.

    An input is a glob (* ? and sets in brackets) if any file matches it, else a path as it stands, whatever letters are in it. A file
    that several inputs name comes once, in the place of the first of them: input_no counts the files from 0, by input and within one by path.
    FileNotFoundError for an input that names nothing, ValueError for a folder, and for names that begin with an underscore, which
    Spark's readers pass over. No inputs give an empty table.
    Spark lists the files of a glob, and its tasks read each by the path that its status gives. Its readers leave out empty files, so
    those alone are told from the file system's list and named by this process.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    globs: list[tuple[int, str, str]] = []  # place, glob, pattern of its paths
    plain: list[tuple[str, int]] = []
    empty: list[tuple[str, int, str]] = []
    n = len(inputs)
    for i, item in enumerate(inputs):
        place = jvm.org.apache.hadoop.fs.Path(_as_glob(item))
        fs = place.getFileSystem(conf)
        found = fs.globStatus(place) if re.search(r"[*?\[]", item) else None
        if found:
            full = fs.makeQualified(place).toString()
            if fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{_as_glob(item)}/*")):
                raise ValueError(f"Input must name files alone: {item}")
            unseen = _unseen(_as_glob(item))
            if unseen and fs.globStatus(jvm.org.apache.hadoop.fs.Path(unseen)):
                raise ValueError(f"Input names files that begin with an underscore: {item}")
            own = _matcher(full)
            empty += [(p, i, "") for p in _empty(jvm, found) if re.fullmatch(own, p) and not any(re.fullmatch(m, p) for _, _, m in globs) and p not in dict(plain) and p not in {x for x, _, _ in empty}]
            globs.append((i, full, own))
            n += len(found)
            continue
        place = jvm.org.apache.hadoop.fs.Path(item)
        if not fs.exists(place):
            raise FileNotFoundError(f"Input not found: {item}")
        if fs.getFileStatus(place).isDirectory():
            raise ValueError(f"Input must be a file: {item}")
        if place.getName()[:1] in "._":
            raise ValueError(f"Input begins with an underscore or a dot: {item}")
        path = fs.makeQualified(place).toString()
        if not any(re.fullmatch(m, path) for _, _, m in globs) and path not in dict(plain) and path not in {x for x, _, _ in empty}:
            plain.append((path, i)) if fs.getFileStatus(place).getLen() else empty.append((path, i, ""))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("text")
    read = lambda paths, glob: spark.read.format("binaryFile").option("__globPaths__", str(glob).lower()).load(paths).select("path", text)
    out = spark.createDataFrame(empty, "path string, input_no int, text string")
    if plain:
        named = spark.createDataFrame(plain, "path string, input_no int")
        out = out.unionByName(read([p for p, _ in plain], False).join(F.broadcast(named) if len(plain) < 100_000 else named, "path").select("path", "input_no", "text"))
    for k, (i, full, own) in enumerate(globs):
        rows = read([full], True)
        for _, _, before in globs[:k]:
            rows = rows.where(~F.col("path").rlike(f"\\A(?:{before})\\z"))
        earlier = [(p,) for p, j in plain if j < i and re.fullmatch(own, p)]
        if earlier:
            rows = rows.join(spark.createDataFrame(earlier, "path string"), "path", "left_anti")
        # a file below a folder that came to be since then
        strange = F.when(~F.col("path").rlike(f"\\A(?:{own})\\z"), F.raise_error(F.concat(F.lit("Input must name files alone: "), "path")))
        out = out.unionByName(rows.select(F.coalesce(strange.cast("string"), "path").alias("path"), F.lit(i).alias("input_no"), "text"))
    # names alone are put in order; up to a million of them are sent to the tasks that read, beyond that texts and numbers meet in a shuffle
    place = F.row_number().over(Window.orderBy("input_no", "path")) - 1
    numbers = out.select("path", place.alias("_no"))
    return out.join(F.broadcast(numbers) if n <= 1_000_000 else numbers, "path").select("path", F.col("_no").alias("input_no"), "text")


def out_name(path: Column | str, clean: str | None = None, redact: str | None = None) -> Column:
    """stem.operations.extension of a path, where the operations applied are named in their order, or copy."""
    c = F.col(path) if isinstance(path, str) else path
    file = F.regexp_extract(c, r"([^/]*)\z", 1)
    done = "__".join([f"clean-{clean}"] * bool(clean) + [f"redact-{redact}"] * bool(redact)) or "copy"
    stem, ending = F.regexp_extract(file, r"\A(.+?)(\.[^.]+)?\z", 1), F.regexp_extract(file, r"\A(.+?)(\.[^.]+)?\z", 2)
    return F.concat(stem, F.lit(f".{done}"), ending)


def redaction_report(hits: Column | str) -> Column:
    """Hits as a JSON array of label, match, start and end; none as []."""
    c = F.col(hits) if isinstance(hits, str) else hits
    return F.to_json(F.transform(c, lambda h: F.struct(h["label"].alias("label"), h["match"].alias("match"), h["start"].alias("start"), h["end"].alias("end"))))


def write_texts(texts: DataFrame, path: str, by: str = "ops") -> None:
    """texts, which has a column that names the operations, as a table with a folder for each of them."""
    texts.write.mode("append").partitionBy(by).parquet(path)


def write_files(texts: DataFrame, folder: str, name: str = "out_name", text: str = "text", suffix: str = "") -> None:
    """A UTF-8 file for every row of texts in folder, which all executors reach, under the row's name and the suffix.

    A folder without a scheme is in the session's default file system, as for Spark's own writers; s3a is read as s3. The executors write them, each under a name of its own first, so that a task that runs again
    leaves a whole file. Of rows with one name the last written stays; a null text is an empty file,
    a row without a name is an error.
    """
    unnamed = F.col(name).isNull() | (F.col(name) == "")
    rows = texts.select(F.when(unnamed, F.raise_error(F.lit("a text has no name"))).otherwise(F.col(name)).cast("string").alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    spark = texts.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    uri = f"{SCHEMES.get(full.getScheme(), full.getScheme())}://{full.getAuthority() or ''}{full.getPath()}"

    def write(own: Iterator[Row]) -> None:
        fs, base = (LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file://") else FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for r in own:
            part = f"{base}/.{uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(r["text"].encode("utf-8", "replace"))
            fs.move(part, f"{base}/{r['name']}{suffix}")

    rows.foreachPartition(write)


def write_reports(hits: DataFrame, folder: str, name: str = "out_name", col: str = "hits") -> None:
    """The hits of every row as an indented JSON array in a file named after the row's own, with .redactions.json."""
    listed = F.to_json(F.transform(col, lambda h: F.struct(h["label"].alias("label"), h["match"].alias("match"), h["start"].alias("start"), h["end"].alias("end"))), {"pretty": "true"})
    write_files(hits.select(name, F.concat(F.coalesce(listed, F.lit("[]")), F.lit("\n")).alias("_report")), folder, name, "_report", ".redactions.json")


def split_payloads(runs: DataFrame, path: str, payload: str = "payload") -> dict[str, int]:
    """runs written in one pass to two tables below path: accepted, and rejected with a column reason; how many rows each got.

    Both have the columns of runs; one named reason is replaced. A payload is accepted if it is a JSON object; reasons are those of
    payload_fault(). Rows that repeat are written each; an empty table leaves both empty.
    """
    seen = Observation()
    kept = [f"`{c}`" for c in runs.columns if c not in ("reason", "_to")]
    marked = runs.select(*kept, payload_fault(F.col(f"`{payload}`")).alias("reason"))
    marked = marked.withColumn("_to", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")).observe(seen, *[F.count_if(F.col("_to") == x).alias(x) for x in ("accepted", "rejected")])
    marked.write.mode("append").partitionBy("_to").parquet(path)
    return dict(seen.get)


def read_split(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with its reason) as split_payloads() wrote runs of schema to path."""
    fields = [f for f in schema.fields if f.name not in ("reason", "_to")]
    whole = spark.read.schema(StructType([*fields, StructField("reason", StringType()), StructField("_to", StringType())])).parquet(path)
    names = [f"`{f.name}`" for f in fields]
    return whole.where("_to = 'accepted'").select(names), whole.where("_to = 'rejected'").select(*names, "reason")


def append_log(runs: DataFrame, path: str) -> None:
    """Runs as lines of JSON after those that are there; a run without a time gets that of writing."""
    runs.withColumn("ts", F.coalesce("ts", F.current_timestamp())).select(*[c.split(" ")[0] for c in LOG.split(", ")]).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The run log; an empty one if nothing is there."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(path)
