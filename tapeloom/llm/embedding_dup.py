"""Near-duplicate embeddings by binary codes of iterative quantisation.

1. A rotation is learnt that makes codes of signs balanced: principal axes of a sample, then turns
   of an orthogonal matrix that bring the sample nearest to its own signs.
2. A code is cut into parts, one hash table each. Two vectors near enough differ by no more than a bound in
   length, so in one part at least by no more than that part's share of its square. A sign can only differ where the
   value is small, so one of the two reaches the other's part of the code by turning signs whose squared
   values add up to half that share. Each vector stands in its own bucket of every table and looks into all that it can so
   reach; nothing is left to chance.
3. What meets goes through a test on whole codes and on which values are large, which loses nothing; then the
   cosine of the original vectors decides.

Crowded buckets show groups of copies. Their means become balls: vectors within half the angle of one
mean are all linked with each other, so those pairs are counted, not made. The rest of a
crowded bucket is dealt out in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, fitting, release
from tapeloom.llm.graph import components

#: bits of a code, at most
BITS = 64
#: room for rounding in squared lengths and cosines of bounds; links themselves are decided by the cosine alone
EPS = 1e-9
#: means of crowded buckets that a task adds up at a time
MEANS = 1024


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, whether) of the vectors of a list column at length 1, filled up with zeros to dim; whether a vector is there, finite and not zero."""
    out = np.zeros((len(column), dim))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    parents = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    values = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)
    out[parents, np.arange(len(values)) - (np.cumsum(sizes) - sizes)[parents]] = values
    largest = np.abs(out).max(1, initial=0)
    good = np.isfinite(largest) & (largest > 0)
    out[~good] = 0
    out[good] /= largest[good, None]
    out[good] /= np.sqrt((out[good] ** 2).sum(1))[:, None]
    return out + 0.0, good


@dataclass
class Rotation:
    mean: np.ndarray
    #: orthonormal rows, one for each bit
    axes: np.ndarray

    def values(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.axes.T


def learn(units: np.ndarray, *, bits: int = BITS, turns: int = 50, seed: int = 0) -> Rotation:
    """The rotation for codes of `bits` bits, no more than dimensions, from a sample of vectors (any, none too)."""
    dim = units.shape[1]
    bits = min(bits, dim)
    mean = units.mean(0) if len(units) else np.zeros(dim)
    centred = units - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    flat = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(turns):
        u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    return Rotation(mean, np.ascontiguousarray((axes @ turn).T))


def _packed(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as whole numbers, the first at the lowest bit."""
    out = np.zeros(len(signs), np.int64)
    for i in range(signs.shape[1]):
        out |= signs[:, i].astype(np.int64) << np.int64(i)
    return out


def reached(costs: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, bits turned) of all sets of bits of each row whose costs add up to most or less; the empty set too."""
    rows, masks, spent = np.arange(len(costs)), np.zeros(len(costs), np.int64), np.zeros(len(costs))
    for i in range(costs.shape[1]):
        more = spent + costs[rows, i]
        fits = np.flatnonzero(more <= most)
        rows, masks, spent = np.concatenate((rows, rows[fits])), np.concatenate((masks, masks[fits] | 1 << i)), np.concatenate((spent, more[fits]))
    return rows, masks


def n_parts(bits: int, largest: int) -> int:
    """Parts of a code for tables in which the vectors of the largest label stand apart: a part has some bits more than their number has."""
    return max(1, min(bits // 2, 8, max(3, round(bits / (max(1, largest).bit_length() + 3)))))


class _Codes:
    def __init__(self, rotation: Rotation, parts: int, apart: float):
        """apart: the square of the largest distance of two linked vectors."""
        self.rotation, self.places, self.apart = rotation, np.array_split(np.arange(len(rotation.axes)), parts), apart

    def of(self, units: np.ndarray, own: bool) -> dict[str, np.ndarray]:
        """Rows (at: place of the vector, part, bits, code, large): own buckets, or those that it reaches beside them."""
        values = self.rotation.values(units)
        signs = values >= 0
        code, large = _packed(signs), _packed(np.abs(values) >= np.sqrt(self.apart) / 2)
        out = []
        for p, places in enumerate(self.places):
            bits = _packed(signs[:, places])
            at = np.arange(len(units))
            if not own:
                at, masks = reached(values[:, places] ** 2, self.apart / len(self.places) / 2 + EPS)
                at, masks = at[len(units) :], masks[len(units) :]
                bits = bits[at] ^ masks
            out.append((at, np.full(len(at), p), bits))
        at, part, bits = (np.concatenate([x[i] for x in out]) for i in range(3))
        return {"at": at, "part": part.astype(np.int32), "bits": bits, "code": code[at], "large": large[at]}


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _buckets(rows: DataFrame, codes: _Codes, dim: int, own: bool) -> DataFrame:
    """(id, label, part, bits, code, large) of rows(id, label, unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                c = codes.of(_matrix(batch.column(2), dim), own)
                at = pa.array(c["at"])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c[x]) for x in ("part", "bits", "code", "large"))], names=["id", "label", "part", "bits", "code", "large"])

    return rows.select("id", "label", "unit").mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, part int, bits long, code long, large long")


def _near(pairs: DataFrame, least: float, dim: int, kept: str) -> DataFrame:
    """pairs(.., ua, ub) of unit vectors with a cosine of at least `least`; kept: the other columns with their types."""
    names = [x.split(" ", 1)[0] for x in kept.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                a, b = (_matrix(batch.column(len(names) + x), dim) for x in range(2))
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(np.einsum("ij,ij->i", a, b) >= least))

    return pairs.select(*names, "ua", "ub").mapInArrow(run, kept)


def _balls(classes: DataFrame, homes: DataFrame, looks: DataFrame, codes: _Codes, cosine: float, dim: int, crowd: int) -> DataFrame | None:
    """(id, ball) of classes that lie within half the angle of `cosine` about the mean of a bucket of more than crowd classes that they stand in or look into; None without such a bucket."""
    key = ["label", "part", "bits"]
    crowded = cut(homes.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*key, "n", F.monotonically_increasing_id().alias("bucket")))
    if not crowded.head(1):
        release(crowded)
        return None
    members = cut(homes.join(fitting(crowded), key).select("id", "bucket"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            place = pa.array(np.tile(np.arange(dim), len(sums)), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.fromiter(sums, np.int64, len(sums)), dim)), place, pa.array(np.concatenate([*sums.values(), np.zeros(0)]))], names=["bucket", "place", "x"])

        for batch in batches:
            units = _matrix(batch.column(1), dim)
            buckets, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            totals = np.zeros((len(buckets), dim))
            np.add.at(totals, at, units)
            for b, t in zip(buckets.tolist(), totals, strict=True):
                sums[b] = sums[b] + t if b in sums else t
            if len(sums) > MEANS:
                yield out()
                sums.clear()
        yield out()

    units = classes.select("id", "unit")
    totals = members.join(units, "id").select("bucket", "unit").mapInArrow(added, "bucket long, place int, x double").groupBy("bucket", "place").agg(F.sum("x").alias("x"))
    vectors = totals.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("v"))

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, good = unit_vectors(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in found], pa.binary())], names=["bucket", "unit"]).filter(pa.array(good))

    centres = cut(vectors.mapInArrow(means, "bucket long, unit binary").join(crowded.select("bucket", "label", "n"), "bucket").select(F.col("bucket").alias("id"), "label", "unit", "n"))
    # means of one group fall in the same buckets: the one of most classes serves for all
    where = _buckets(centres, codes, dim, True).join(centres.select("id", "n"), "id")
    largest = where.groupBy(*key).agg(F.max(F.struct("n", "id")).alias("most"))
    roots = cut(where.join(largest, key).groupBy(F.col("id").alias("bucket")).agg(F.max("most").alias("most")).select("bucket", F.col("most.id").alias("ball"), F.col("most.n").alias("n")))
    asked = members.union(looks.join(fitting(crowded), key).select("id", "bucket")).join(fitting(roots), "bucket").select("id", "ball", "n").distinct()
    asked = asked.join(fitting(centres.select(F.col("id").alias("ball"), F.col("unit").alias("ub"))), "ball").join(units.withColumnRenamed("unit", "ua"), "id")
    within = _near(asked, float(np.sqrt((1 + cosine) / 2)) + EPS, dim, "id long, ball long, n long")
    balls = cut(within.groupBy("id").agg(F.max(F.struct("n", "ball")).alias("most")).select("id", F.col("most.ball").alias("ball")))
    release(crowded, members, centres, roots)
    return balls


def _met(homes: DataFrame, looks: DataFrame, balls: DataFrame | None, block: int) -> DataFrame:
    """Pairs (a, b) of classes of which one stands in a bucket that the other stands in or looks into, and that pass the test on whole codes; none of one ball."""
    key = ["label", "part", "bits"]
    none = F.lit(-1).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("ball", none) if balls is None else rows.join(balls, "id", "left").withColumn("ball", F.coalesce("ball", none))

    stand = placed(homes)
    look = stand.withColumn("own", F.lit(True)).unionByName(placed(looks).withColumn("own", F.lit(False)))
    # a bucket's classes in lists of one ball, or of none, and of about `block` each
    kinds = stand.groupBy(*key, "ball").agg(F.ceil(F.count("*") / block).cast("int").alias("lists"))
    asked = look.join(kinds.withColumnRenamed("ball", "of"), key).where((F.col("of") < 0) | (F.col("of") != F.col("ball")))
    asked = asked.withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).select(*key, "of", "list", "id", "own", F.col("code").alias("code2"), F.col("large").alias("large2"))
    there = stand.join(kinds, [*key, "ball"]).select(*key, F.col("ball").alias("of"), F.pmod(F.xxhash64("id"), F.col("lists")).cast("int").alias("list"), F.col("id").alias("home"), "code", "large")
    turned = F.col("code").bitwiseXOR(F.col("code2"))
    both, one = (F.bit_count(turned.bitwiseAND(x)) for x in (F.col("large").bitwiseAND(F.col("large2")), F.col("large").bitwiseXOR(F.col("large2"))))
    # a sign that differs where both values are large takes up the whole bound, a quarter of it where one is
    fits = (4 * both + one <= 4) & (F.col("id") != F.col("home")) & (~F.col("own") | (F.col("id") < F.col("home")))
    return cut(asked.join(there, [*key, "of", "list"]).where(fits).select(F.least("id", "home").alias("a"), F.greatest("id", "home").alias("b")).distinct())


def embedding_duplicates(rows: DataFrame, *, cosine: float = 0.98, sample: int = 20_000, crowd: int = 64, block: int = 2048, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows(vec_id, embedding, label).

    Two vectors are linked if their labels are equal (with label_col None all are) and their cosine in double precision is `cosine`, which is
    positive, or more. n_links counts the other rows linked with a row, component_id is the smallest id reachable, kept says that it is the row's own.
    No linked pair is lost: the tables reach every vector near enough. The rotation is learnt from about `sample`
    vectors chosen by hash, 64 MB at most; it decides on speed alone.
    Nulls: a null label, a vector that is null, empty or zero or holds a null or a value that is not finite links with nothing; nor do vectors of unequal length.
    A null id names a component only where no other id does; such a row alone has a null component_id and is kept. Rows
    that repeat an id count as vectors of their own. Equal vectors are one class, compared once. Further columns
    are not read; an empty table gives an empty table.
    """
    label = F.lit(0) if label_col is None else F.col(f"`{label_col}`")
    plain = rows.select(F.col(f"`{id_col}`").alias("vec_id"), label.alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    dim = plain.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(1, dim)
    kinds = [plain.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                units, good = unit_vectors(batch.column(2), dim)
                good &= batch.column(1).is_valid().to_numpy(zero_copy_only=False)
                sizes = pc.list_value_length(batch.column(2)).to_pylist()
                raw = [u.tobytes() if g else None for u, g in zip(units, good, strict=True)]
                keys = [hashlib.blake2b(x, digest_size=16, salt=n.to_bytes(8, "little")).digest() if x else None for x, n in zip(raw, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "size", "key", "unit"])

    seen = cut(plain.mapInArrow(keyed, f"vec_id {kinds[0]}, label {kinds[1]}, size int, key binary, unit binary"))
    good = seen.where("key IS NOT NULL")
    classes = good.groupBy("label", "key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("size").alias("size"))
    # vectors of unequal length stand under labels of their own
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), F.struct("label", "size").alias("label"), "key", "vec_id", "copies", "unit"))
    most = classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    n, largest = most[1] or 0, most[0] or 0

    share = min(sample, (64 << 20) // (8 * dim)) / max(1, n)
    chosen = classes.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("unit").toArrow()
    rotation = learn(_matrix(chosen.column("unit"), dim), seed=seed)
    parts, apart = n_parts(len(rotation.axes), largest), 2 - 2 * cosine
    codes = _Codes(rotation, parts, apart + EPS)

    homes = cut(_buckets(classes, codes, dim, True))
    looks = _buckets(classes, codes, dim, False)
    balls = _balls(classes, homes, looks, codes, cosine, dim, crowd)
    met = _met(homes, looks, balls, block)
    units = classes.select("id", "unit")
    pairs = met.join(units.select(F.col("id").alias("a"), F.col("unit").alias("ua")), "a").join(units.select(F.col("id").alias("b"), F.col("unit").alias("ub")), "b")
    links = cut(_near(pairs, cosine, dim, "a long, b long"))

    own = classes.select("id", "copies")
    ways = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(own.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    edges = links.select("a", "b")
    counts = [(F.col("copies") - 1).alias("x"), F.coalesce("others", F.lit(0)).alias("y")]
    if balls is not None:
        sized = balls.join(own, "id").groupBy("ball").agg(F.sum("copies").alias("held"), F.min("id").alias("first"))
        inside = cut(balls.join(sized, "ball").select("id", "held", "first"))
        edges = edges.union(inside.where("id <> first").select("first", "id"))
        linked = linked.join(inside.select("id", "held"), "id", "full")
        counts.append((F.coalesce("held", F.col("copies")) - F.col("copies")).alias("z"))
    label_of = components(edges)
    named = classes.select("id", "label", "key", "vec_id", "copies").join(linked, "id", "left").join(label_of.select(F.col("node").alias("id"), F.col("label").alias("root")), "id", "left")
    total = reduce(lambda a, b: a + b, counts)
    named = cut(named.select("key", F.col("label.label").alias("label"), "vec_id", F.coalesce("root", "id").alias("root"), total.cast("long").alias("n_links")))
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = cut(named.join(least, "root").select("label", "key", "n_links", "component_id"))
    release(classes, homes, met, links)
    columns = ["vec_id", "n_links", "component_id"]
    out = good.select("vec_id", "label", "key").join(named, ["label", "key"]).select(columns)
    alone = seen.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
