import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import queries
from tapeloom.llm.embedding_dup import _Codes, embedding_duplicates, learn, n_parts, reached

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label) by all pairs."""
    units = []
    for _, v, label in rows:
        x = None if v is None or any(e is None for e in v) else np.array(v, np.float64)
        fine = x is not None and label is not None and np.isfinite(x).all() and x.any()
        units.append(x / np.linalg.norm(x) if fine else None)
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= cosine:
                links[i], links[j], label[root(i)] = links[i] + 1, links[j] + 1, root(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(root(i), []).append(r[0])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(map(repr, ((r[0], links[i], ids[root(i)], r[0] == ids[root(i)]) for i, r in enumerate(rows))))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def test_query_equals_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = got(queries.op11_embedding_near_dup(spark, sf))
    assert found == brute(rows) and any(", 1, " in x for x in found)


@pytest.mark.parametrize(("crowd", "block"), [(128, 2048), (3, 4)])
def test_groups_of_copies(spark, crowd, block):
    """A tight group (a ball), a loose one whose members are linked in part, equal vectors, a chain, single ones."""
    rng = np.random.default_rng(3)
    rows = []
    for n, noise in ((60, 0.03), (60, 0.105), (12, 0.0), (40, 9.0)):
        centre = rng.standard_normal(24)
        centre /= np.linalg.norm(centre)
        rows += [(centre + noise * v / np.linalg.norm(v)).tolist() for v in rng.standard_normal((n, 24))]
    angle = np.arccos(0.98) * 0.9
    rows += [[float(np.cos(angle * i)), float(np.sin(angle * i))] + [0.0] * 22 for i in range(9)]
    rows = [(int(i), v, int(i) % 7 == 0 and 2 or 1) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    found = got(embedding_duplicates(spark.createDataFrame(rows, SHAPE), crowd=crowd, block=block))
    assert found == brute([(i, np.array(v, np.float32).tolist(), x) for i, v, x in rows])


def test_odd_rows(spark):
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 2.0], 1), (5, [1.0, float("nan"), 2.0], 1), (6, [float("inf"), 0.0, 0.0], 1),
        (7, [1.0, 2.0, 3.0], None), (8, [1.0, 2.0, 3.0], 1), (8, [1.0, 2.0, 3.0], 1), (9, [2.0, 4.0, 6.0], 1), (10, [1.0, 2.0, 3.0], 2), (None, [1.0, 2.0, 3.01], 1),
        (11, [1.0, 2.0, 3.0, 0.0], 1), (None, [-3.0, 1.0, 1.0], 1), (12, [3e38, 0.0, 0.0], 1), (13, [1e-38, 0.0, 1e-41], 1), (14, [-0.0, 0.0, 5.0], 1), (15, [0.0, -0.0, 2.0], 1),
    ]
    df = spark.createDataFrame(rows, SHAPE)
    odd = df.select("*", *[F.lit("x").alias(c) for c in ("id", "unit", "key", "part", "bits", "ball")])
    assert got(embedding_duplicates(odd)) == brute(rows)
    assert got(embedding_duplicates(df.limit(0))) == []
    assert embedding_duplicates(df.limit(0)).columns == ["vec_id", "n_links", "component_id", "kept"]
    one = spark.createDataFrame([(1, [2.0], 1), (2, [3.0], 1), (3, [-1.0], 1)], SHAPE)
    assert got(embedding_duplicates(one, crowd=1)) == brute([tuple(r) for r in one.collect()])


def test_every_near_pair_meets_in_a_table():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = a + rng.standard_normal(a.shape) * 0.034
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = (a * b).sum(1) >= 0.98
    assert 1000 < near.sum() < 3990
    rotation = learn(np.concatenate((a[:500], b[:500])))
    assert np.allclose(rotation.axes @ rotation.axes.T, np.eye(32))
    for parts in (2, 4):
        codes = _Codes(rotation, parts, 0.04 + 1e-9)
        met = np.zeros(len(a), bool)
        home = [codes.of(x, True) for x in (a, b)]
        for x, y in ((a, 1), (b, 0)):
            seen = {(i, p, v) for own in (True, False) for i, p, v in zip(*(codes.of(x, own)[c].tolist() for c in ("at", "part", "bits")), strict=True)}
            for i, p, v in zip(*(home[y][c].tolist() for c in ("at", "part", "bits")), strict=True):
                met[i] |= (i, p, v) in seen
        assert met[near].all()


def test_learning_turns_codes_towards_their_signs():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 16)) * np.linspace(2, 0.2, 16)
    loss = lambda r: ((np.where(r.values(x) >= 0, 1, -1) - r.values(x)) ** 2).sum()
    assert loss(learn(x, turns=50)) < loss(learn(x, turns=0))
    assert np.abs((learn(x).values(x) >= 0).mean(0) - 0.5).max() < 0.1
    rows, masks = reached(np.array([[1.0, 2.0, 4.0]]), 3.0)
    assert sorted(masks.tolist()) == [0, 1, 2, 3] and set(rows.tolist()) == {0}
    assert [n_parts(64, n) for n in (10, 1000, 50_000, 10**9)] == [8, 5, 3, 3] and n_parts(2, 5) == 1 and n_parts(1, 5) == 1
