"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every text becomes the set of its word shingles, hashed by one function; the k smallest
   hashes are its sketch. Equal sets form one class, and only classes go on.
2. Inverted lists of the retained values give overlaps. Two sets that are similar enough share
   at least `need` retained values but for a chance of `miss`, so a class enters only the lists
   of its (size - need + 1) rarest values: lists of common passages stay out of it.
3. Candidate pairs pass a size filter and the union-sketch estimate, then the exact Jaccard
   similarity of the full sets decides.
Long lists never emit all their pairs. First each class is compared with two heads of its lists:
the one whose retained values are the commonest, which is the text that a group's edited copies
share most with, and another by hash. That joins most of a large group. Only members of lists that
still hold different components, as many as similar classes share, are then compared across those;
for them all values are retained.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import cut, fitting, parts, release, slices
from tapeloom.llm.graph import components

U = np.uint64
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SEGMENT = 1 << 17
#: bytes of a word beyond which its hash is a digest
LONG = 64
#: bits of a set's parity bitmap
BITS = 512
#: Bytes as they count: A-Z in lower case, all white space one byte.
FOLD = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 4096)
        _powers[:] = [np.cumprod(np.concatenate(([U(1)], np.full(n - 1, b, U)))) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the start of every word of data, whose words are divided by blanks.

    Works through segments cut at blanks, so that memory does not grow with the text.
    """
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = len(data)
        if end - at > SEGMENT:
            end = data.find(b" ", at + SEGMENT)
            end = len(data) if end < 0 else end
        b = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate(([False], b != 32, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edges[::2], edges[1::2]
        p, inverse = _power_tables(len(b) + 1)
        total = np.concatenate(([U(0)], np.cumsum((b.astype(U) + U(1)) * p[: len(b)])))
        own = _mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U))
        for i in np.flatnonzero(e - s > LONG):  # long words of equal polynomials are easily made
            own[i] = int.from_bytes(hashlib.blake2b(b[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
        hashes.append(own)
        starts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, U), np.zeros(0, np.int64))


def run_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes b[start:end]; runs ascend and don't overlap. Works through segments, as word_hashes() does."""
    out, i = np.zeros(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        own = np.zeros(j - i, U)
        if e[-1] <= SEGMENT:
            part = b[starts[i] : ends[j - 1]]
            p, inverse = _power_tables(len(part) + 1)
            total = np.concatenate(([U(0)], np.cumsum((part.astype(U) + U(1)) * p[: len(part)])))
            own = _mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U))
        for k in np.flatnonzero(e - s > LONG):
            own[k] = int.from_bytes(hashlib.blake2b(b[starts[i + k] : ends[i + k]].tobytes(), digest_size=8).digest(), "little")
        out[i:j], i = own, j
    return out


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 63-bit hashes of its shingles of width words.

    With fewer words, the whole sequence is the one shingle; without words the set is empty.
    """
    factors = [U(pow(BASE, j + 2, 1 << 64) | 1) for j in range(width)]
    for part in slices(texts, SEGMENT):
        blobs = [t.encode("utf-8", "replace") for t in texts[part]]
        hashes, starts = word_hashes(b" ".join(blobs).translate(FOLD))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in blobs]))
        sums = sum(hashes[j : len(hashes) - width + 1 + j] * factors[j] for j in range(width)) if len(hashes) >= width else np.zeros(0, U)
        sums = _mix(sums) >> U(1)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s >= width:
                yield np.unique(sums[s : e - width + 1])
            elif e > s:
                short = sum(int(h) * pow(BASE, j + 2, 1 << 64) for j, h in enumerate(hashes[s:e])) + int(e - s)
                yield _mix(np.array([short & MASK], U)) >> U(1)
            else:
                yield np.zeros(0, U)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64))


def _bitmaps(sets: list[np.ndarray]) -> pa.Array:
    """Of each set the parity of how many of its values fall on each of BITS places, as longs."""
    odd = [np.packbits((np.bincount((s % U(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64) for s in sets]
    return _lists(odd)


def needed(k: int, percent: int, miss: float = 1e-9) -> int:
    """The most values of a union sketch of k that two sets of similarity percent share but for a chance of miss."""
    t, below = percent / 100, 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > miss:
            return max(c, 1)
    return k


def marks(docs: DataFrame, width: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, text_hash, key (digest of its shingle set; null if empty), n_shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 2, 1 << 21):
            keys, sizes, sketches = [], [], []
            for found in shingle_sets(texts, width):
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sizes.append(len(found))
                sketches.append(found[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), _lists(sketches)], names=["doc_id", "text_hash", "key", "n_shingles", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, key binary, n_shingles long, sketch array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, shingles, bits) with the whole shingle set and bitmap of each class in wanted(cid, doc_id, text_hash); rows that repeat an id and text give it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, texts in parts(batches, 1, 1 << 21):
            cids = batch.column(0).to_pylist()
            new = [i for i, c in enumerate(cids) if not (c in seen or seen.add(c))]
            sets = list(shingle_sets([texts[i] for i in new], width))
            yield pa.RecordBatch.from_arrays([pa.array([cids[i] for i in new], pa.int64()), _lists(sets), _bitmaps(sets)], names=["cid", "shingles", "bits"])

    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    found = rows.join(fitting(wanted), (F.col("h") == F.col("text_hash")) & F.col("d").eqNullSafe(F.col("doc_id"))).select("cid", "text")
    sets = cut(found.mapInArrow(run, "cid long, shingles array<long>, bits array<long>"))
    if sets.groupBy("cid").count().where(F.col("count") > 1).head(1):  # rows that repeat, in several tasks; no text is shuffled to find them
        once = cut(sets.dropDuplicates(["cid"]))
        release(sets)
        return once
    return sets


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, percent: int, need: int) -> DataFrame:
    """pairs(a, b) that pass the union-sketch estimate; est: shared values of the union sketch."""
    a = sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.select("a", "b", union.alias("u"), F.array_intersect("sa", "sb").alias("i"))
    both = both.select("a", "b", F.size("u").alias("u"), F.size(F.array_intersect("u", "i")).alias("est"))
    return both.where(100 * F.col("est") >= F.when(F.col("u") < k, percent * F.col("u")).otherwise(100 * need)).select("a", "b", "est")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose full sets have an intersection of at least percent of their union."""
    a = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    sized = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return sized.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def _least(need: int, percent: int, k: int) -> Column:
    """How many retained values a class of n shingles shares with every similar one."""
    return F.when(F.floor(100 * F.col("n") / percent) <= k, F.ceil(percent * F.col("n") / 100)).otherwise(F.lit(need))


def _sized(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _mixed(rows: DataFrame) -> DataFrame:
    """(v) of the lists of rows(v, label) that hold several labels."""
    return rows.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")


def _open(listed: DataFrame, sketches: DataFrame, need: int, percent: int, k: int) -> DataFrame:
    """(cid, label) of the classes of listed(v, cid, label) that may be similar to one of another label: as many of their retained values as similar classes share stand in lists of several labels."""
    met = cut(listed.join(_mixed(listed), "v", "left_semi").select("cid", "label").distinct())
    values = sketches.join(met, "cid").select("cid", "label", "n", F.explode("sketch").alias("v"))
    counts = values.join(_mixed(values), "v", "left_semi").groupBy("cid").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.count("*").alias("c"))
    found = cut(counts.where(F.col("c") >= _least(need, percent, k)).select("cid", "label"))
    release(met)
    return found


def _cross_pairs(sets: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) among classes(cid, label), of different labels, that may be similar: all values are retained here, so nothing is left to chance.

    A class stands in the lists of as many of its rarest shingles as it may lack and one more. Long
    lists are dealt out in blocks. A pair passes where what follows the shared shingle in both can
    still make up the similarity, which shingles of no other class, the first of all, soon rule out,
    and where their bitmaps differ in no more places than similar sets differ in values: each value
    that only one set has turns one place, so this loses no pair. Sets of many more than BITS values
    fill the bitmap and are told apart by the exact sets alone.
    """
    held = sets.join(classes, "cid").select("cid", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("v"))
    common = held.groupBy("v").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("c > 1")
    by_class = Window.partitionBy("cid")
    held = held.join(common, "v")
    held = held.withColumn("place", F.col("n") - F.count("*").over(by_class) + F.row_number().over(by_class.orderBy("c", "v")))
    held = held.where((F.col("place") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1) & (F.col("lo") != F.col("hi")))
    # no partner is smaller than percent of n, so a class with less after the shared shingle can't be similar to any
    held = held.where((100 + percent) * (1 + F.col("n") - F.col("place")) >= percent * (F.col("n") + F.ceil(percent * F.col("n") / 100)))
    blocks = F.ceil(F.col("c") / block).cast("int")
    held = held.join(sets.select("cid", "bits"), "cid")
    side = held.withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = cut(side.select("v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.col("cid").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), (F.col("n") - F.col("place")).alias("after"), "bits"))
    other = side.select("v", "x", "y", F.col("own").alias("own2"), F.col("a").alias("b"), F.col("la").alias("lb"), F.col("na").alias("nb"), F.col("after").alias("after2"), F.col("bits").alias("bits2"))
    apart = sum(F.bit_count(F.col("bits")[j].bitwiseXOR(F.col("bits2")[j])) for j in range(BITS // 64))
    alike = (100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))
    enough = (100 + percent) * (1 + F.least("after", "after2")) >= percent * (F.col("na") + F.col("nb"))
    once = (F.col("x") == F.col("y")) | (F.col("own") != F.col("own2"))
    pairs = cut(side.join(other, ["v", "x", "y"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & once & _sized(percent) & enough & alike).select("a", "b").distinct())
    release(side)
    return pairs


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, k: int = 48, miss: float = 1e-9, heads: int = 2, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest id reachable, kept says that it is the row's own.
    Nulls: a null text is empty; empty texts are linked with nothing. A null id joins its group
    but never names it while another id is there; a group of null ids alone has a null
    component_id and is kept whole. Rows that repeat an id count as that document, so all of them
    are kept or dropped alike. Further columns, whatever their names, are not read. An empty table
    gives an empty table. miss is the chance that one pair of exactly that similarity shares too
    few retained values to be met; pairs above it, and sets of up to k * percent / 100 shingles, are safer still.
    """
    need = needed(k, percent, miss)
    seen = cut(marks(docs, width, k, id_col, text_col))
    classes = seen.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "key", F.col("least.doc_id").alias("text_id"), F.col("least.text_hash").alias("text_hash"), "doc_id", "n", "sketch"))

    # the lists that a class stands in: of its retained values, those of no other class first, then the rarer ones
    entries = classes.select("cid", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    by_class = Window.partitionBy("cid")
    size = F.least("n", F.lit(k))
    rare = entries.join(shared, "v").withColumn("size", size).withColumn("place", F.col("size") - F.count("*").over(by_class) + F.row_number().over(by_class.orderBy("c", "v")))
    rare = rare.withColumn("central", F.sum(F.log2("c")).over(by_class) / F.col("size"))
    listed = cut(rare.where(F.col("place") <= F.col("size") - _least(need, percent, k) + 1).select("v", "cid", "n", "central"))
    who = [F.col("cid"), F.col("n")]
    central = F.max(F.struct(F.col("central"), F.xxhash64("cid").alias("x"), *who))
    others = [F.min(F.struct(F.xxhash64("cid", F.lit(j)).alias("x"), *who)) for j in range(1, heads)]
    chosen = F.array(*[F.struct(h["cid"].alias("b"), h["n"].alias("nb")) for h in (central, *others)])
    lists = cut(listed.groupBy("v").agg(F.count("*").alias("c"), chosen.alias("heads")).where("c > 1"))

    star = listed.join(lists, "v").select(F.col("cid").alias("a"), F.col("n").alias("na"), F.inline("heads")).where((F.col("a") != F.col("b")) & _sized(percent))
    most = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    star = star.groupBy("a", "b").agg(F.count("*").alias("shared")).withColumn("place", F.row_number().over(most)).where(F.col("place") <= heads)
    sketches = classes.select("cid", "sketch")
    near = cut(_estimated(star.select("a", "b"), sketches, k, percent, need).select("a", "b"))

    def full_sets(wanted: DataFrame) -> DataFrame:
        rows = cut(classes.join(wanted, "cid").select("cid", F.col("text_id").alias("doc_id"), "text_hash"))
        sets = _full_sets(docs, rows, width, id_col, text_col)
        release(rows)
        return sets

    sets = full_sets(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    first = cut(_verified(near, sets, percent))
    release(sets)
    labels = cut(classes.select("cid").join(components(first).withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("label", "cid").alias("label")))
    members = listed.join(lists.select("v"), "v", "left_semi").join(labels, "cid").select("v", "cid", "label")
    open_ = _open(members, classes.select("cid", "n", "sketch"), need, percent, k)
    if open_.head(1):
        sets = full_sets(open_.select("cid"))
        candidates = _cross_pairs(sets, open_, percent, block)
        second = cut(_verified(_estimated(candidates, sketches, k, percent, need), sets, percent))
        joined = second.join(labels.withColumnRenamed("cid", "a").withColumnRenamed("label", "la"), "a").join(labels.withColumnRenamed("cid", "b").withColumnRenamed("label", "lb"), "b")
        merged = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = cut(labels.join(merged, "label", "left").select("cid", F.coalesce("final", "label").alias("label")))
        release(sets, candidates, second)

    named = cut(classes.select("cid", "key", "doc_id").join(labels, "cid").select("key", "doc_id", "label"))
    ids = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = cut(named.join(ids, "label").select("key", "component_id"))
    release(classes, listed, lists, near, first, open_)
    full = seen.where("n_shingles > 0").drop("sketch").join(named, "key")
    empty = seen.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    return full.select(columns).union(empty.select(columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
