import hashlib
import math
import re
from fractions import Fraction

from pyspark.sql import functions as F

from tapeloom.llm.mixing import TREE, Level, mix


def water(budget, children):
    """What each of children(capacity, weight by name) gets of budget."""
    given = dict.fromkeys(children, Fraction(0))
    open_ = {n for n, (_, w) in children.items() if w > 0}
    left = Fraction(budget)
    while open_:
        total = sum(children[n][1] for n in open_)
        full = {n for n in open_ if children[n][0] <= left * children[n][1] / total}
        if not full:
            for n in open_:
                given[n] = left * children[n][1] / total
            break
        for n in full:
            given[n] = Fraction(children[n][0])
        left -= sum(children[n][0] for n in full)
        open_ -= full
    return given


def brute(rows, weights, percent, max_epochs, seed):
    """Copies of each of rows(id, path, text)."""
    counts = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    held = {}
    for (_, path, _), n in zip(rows, counts, strict=True):
        held[path] = held.get(path, 0) + n
    depth = len(weights)

    def usable(path):
        return all(weights[i](path[: i + 1]) > 0 for i in range(depth))

    budgets = {(): Fraction(math.floor(Fraction(sum(held.values()) * percent, 100)))}
    for i in range(depth):
        for parent in [p for p in budgets if len(p) == i]:
            names = {p[: i + 1] for p in held if p[:i] == parent}
            capacity = {n: sum(h * max_epochs for p, h in held.items() if p[: i + 1] == n and usable(p)) for n in names}
            budgets.update(water(budgets[parent], {n: (capacity[n], weights[i](n)) for n in names}))
    copies = {}
    for path, h in held.items():
        whole = math.floor(budgets[path] + Fraction(1, 10**6))
        full = whole // h if h else 0
        rest = whole - full * h
        own = [j for j, r in enumerate(rows) if r[1] == path]
        key = {j: hashlib.md5(f"{seed}:{full}:{'' if rows[j][0] is None else rows[j][0]}".encode()).hexdigest() for j in own}
        for j in own:
            upto = sum(counts[i] for i in own if key[i] <= key[j])
            copies[j] = full + (1 if rest > 0 and upto <= rest else 0)
    return [copies[j] for j in range(len(rows))]


def tree_path(source, lang):
    end = ord(source[-1]) if source else None
    domain = "web" if source == "src0" else "books" if end is not None and end % 2 == 0 else "forums"
    return (domain, lang or "", source or "")


TREE_WEIGHTS = [lambda p: {"web": 2, "books": 3}.get(p[0], 1), lambda p: 3 if p[1] == "en" else 2, lambda p: 1 + (ord(p[2][-1]) if p[2] else 0) % 3]


def test_tree_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, tree_path(r.source, r.lang), r.text) for r in docs.collect()]
    for percent, epochs in ((60, 2), (80, 1), (150, 3), (0, 1)):
        got = {r.doc_id: r._copies for r in mix(docs, TREE, percent=percent, max_epochs=epochs, seed=7).collect()}
        assert got == dict(zip((r[0] for r in rows), brute(rows, TREE_WEIGHTS, percent, epochs, 7), strict=True))


def test_shortages_go_to_siblings_then_up(spark):
    # a holds little besides a child of no weight; b's children differ in what they hold
    leaves = {("a", "x"): 10, ("a", "none"): 500, ("b", "x"): 40, ("b", "y"): 400, ("c", "x"): 300}
    rows = [(i, path, "w " * 5) for i, path in enumerate(p for p, n in leaves.items() for _ in range(n // 5))]
    docs = spark.createDataFrame([(i, p[0], p[1], t) for i, p, t in rows], "doc_id long, top string, low string, text string")
    levels = [Level("d", "top", "1"), Level("s", "low", "CASE s WHEN 'none' THEN 0 WHEN 'x' THEN 2 ELSE 1 END")]
    weights = [lambda p: 1, lambda p: {"none": 0, "x": 2}.get(p[1], 1)]
    got = {r.doc_id: r._copies for r in mix(docs, levels, percent=40, seed=1, buckets=3).collect()}
    want = brute(rows, weights, 40, 1, 1)
    assert got == dict(enumerate(want))
    taken = {}
    for i, path, _ in rows:
        taken[path] = taken.get(path, 0) + 5 * got[i]
    # 500 tokens: a can use 10 only, so b and c share 490; b's x gives 40 and y the rest
    assert taken == {("a", "x"): 10, ("a", "none"): 0, ("b", "x"): 40, ("b", "y"): 205, ("c", "x"): 245}


def test_odd_rows(spark, odd):
    got = mix(odd, TREE, percent=50, seed=7)
    assert got.count() == 10
    rows = [(r.doc_id, tree_path(r.source, r.lang), r.text) for r in odd.collect()]
    want = brute(rows, TREE_WEIGHTS, 50, 1, 7)
    assert sorted(map(repr, [(r.doc_id, r._copies) for r in got.collect()])) == sorted(map(repr, [(r[0], n) for r, n in zip(rows, want, strict=True)]))
    assert mix(odd.limit(0), TREE, percent=50).count() == 0


def test_own_column_names(spark):
    rows = [(i, "a b c", "en", f"src{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("_leaf0", "_full", "_copies", "_key", "_row", "_n_tokens", "domain", "budget", "_md5_id"):
        docs = docs.withColumn(name, F.lit("x"))
    out = mix(docs, TREE, percent=60, seed=7)
    assert len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert len(got) == 30 and {r._leaf0 for r in got} == {"x"} and all(r._n_tokens == 3 and r._copies in (0, 1) for r in got) and {r.domain for r in got} == {"web", "books", "forums"} & {r.domain for r in got}


def test_more_tokens_than_an_int_holds_times_percent(spark):
    docs = spark.range(4).selectExpr("id AS doc_id", "repeat('a ', 12000000) AS text", "'en' AS lang", "'src1' AS source")
    assert mix(docs, TREE, percent=50, seed=7).where("_copies > 0").count() in (1, 2)
