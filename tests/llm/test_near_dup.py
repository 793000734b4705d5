import random
import re

import numpy as np

from tapeloom.llm.near_dup import BITS, _bitmaps, near_duplicates, needed


def shingles(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in lists[x]:
                if j > i:
                    counts[j] = counts.get(j, 0) + 1
        for j, c in counts.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def check(docs, width, percent, **more):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, width, percent)
    got = near_duplicates(docs, width=width, percent=percent, **more).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return want


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = check(docs, 3, 85)
    assert any(d != c for d, (_, c) in want.items())
    check(docs, 5, 80)


def test_chains_and_long_lists_in_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + i, " ".join([f"x{j}" for j in range(i)] + base[i:])) for i in range(12)]
    rows += [(200 + i, " ".join([*base[:30], *[f"u{i}_{j}" for j in range(30)]])) for i in range(40)]
    rows += [(300 + i, "one two") for i in range(3)] + [(400, ""), (401, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, heads=1, block=4)


def test_group_of_many_edits_in_blocks(spark):
    rng = random.Random(4)
    rows = []
    for g in range(3):
        base = [f"b{g}_{i}" for i in range(90)]
        for i in range(60):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 9))):
                words[rng.randrange(90)] = f"e{rng.randrange(400)}"
            rows.append((1000 * g + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"heads": 1, "block": 7, "k": 16}):
        want = check(docs, 3, 85, **more)
        assert 10 < len({c for _, c in want.values()}) < 150


def test_odd_rows(spark, odd):
    got = near_duplicates(odd, width=5, percent=80).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert by[8].component_id == 7 and by[None].component_id is None and by[None].kept
    assert near_duplicates(odd.limit(0)).count() == 0


def test_needed_grows_with_similarity():
    assert 5 <= needed(32, 80) < needed(32, 85) < needed(32, 95) <= 32


def test_bitmaps_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 9).astype(np.uint64))))
        x, y = _bitmaps([a, b]).to_pylist()
        assert len(x) == BITS // 64
        assert sum(((int(p) ^ int(q)) & ((1 << 64) - 1)).bit_count() for p, q in zip(x, y, strict=True)) <= len(np.setxor1d(a, b))
        assert _bitmaps([a]).to_pylist()[0] == x
