import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeloom.llm import bm25
from tapeloom.llm.bm25 import SCALE, Postings, impact, search, terms_of, top_k
from tapeloom.llm.near_dup import word_hashes


def _term_id(word):
    return int(word_hashes(word)[0].view("int64")[0])


def brute(docs, queries, k, n_terms):
    docs = [(d, terms_of(t)) for d, t in docs]
    total, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = Counter(w for _, words in docs for w in set(words))
    counts = [(d, Counter(words), len(words)) for d, words in docs]
    idf = lambda w: math.log1p((total - df[w] + 0.5) / (df[w] + 0.5))
    out = []
    for q, text in queries:
        own = Counter(terms_of(text))
        chosen = sorted((w for w in own if df[w]), key=lambda w: (-own[w] * idf(w), _term_id(w)))[:n_terms]
        scores = []
        for d, c, n in counts:
            s = sum(round(impact(c[w], n, mean) * idf(w) * SCALE) for w in chosen if c[w])
            if s > 0:
                scores.append((-s, d))
        out += [(q, d, i + 1, -s / SCALE) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 10, 16)
    got = sorted(map(tuple, search(docs.repartition(3), docs.where("doc_id % 50 = 0"), n_terms=16, queries_per_task=7).collect()))
    assert len(want) > 100
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want, strict=True))


def brute_whole(docs, queries, k):
    """All words of each query's text, with their counts."""
    counts = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in docs]
    total, mean = len(docs), sum(n for _, _, n in counts) / len(docs)
    df = Counter(w for _, c, _ in counts for w in c)
    idf = {w: math.log1p((total - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = []
    for q, text in queries:
        own = Counter(terms_of(text))
        scores = []
        for d, c, size in counts:
            s = sum(n * round(impact(c[w], size, mean) * idf[w] * SCALE) for w, n in own.items() if c[w])
            if s > 0:
                scores.append((-s, d))
        out += [(q, d, i + 1, -s / SCALE) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def equal(got, want):
    assert [tuple(g)[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-4 for g, w in zip(got, want, strict=True))


def test_registered_query_searches_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [r for r in rows if r[0] % 50 == 0]
    want = brute_whole(rows, asked, 10)
    assert sum(len(set(terms_of(t))) > 16 for _, t in asked) > len(asked) / 2
    equal(sorted(entry.queries()["op6_bm25_top_k"](spark, "/root/testdata/sf0.01").collect()), want)
    equal(sorted(search(docs.repartition(5), docs.where("doc_id % 50 = 0"), n_terms=None, queries_per_task=7).collect()), want)


def test_pruned_search_equals_exhaustive():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 400)
        lists = []
        for _ in range(rng.randint(1, 5)):
            ids = sorted(rng.sample(range(n), rng.randint(1, n)))
            size = rng.randint(1, 20)
            blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
            rows = [(b, [rng.randint(1, 3) for _ in b], [rng.choice((10, 20)) for _ in b]) for b in blocks]
            lists.append(Postings([(*r, max(impact(c, m, 15.0) for c, m in zip(r[1], r[2], strict=True))) for r in rows], rng.choice((0.5, 1.5)), 15.0))
        total = Counter()
        for x in lists:
            for d, s in zip(x.docs, x.scores, strict=True):
                total[d] += s
        want = sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:7]
        assert top_k(lists, 7) == want


def test_odd_rows(spark, odd):
    got = search(odd, odd, k=3).collect()
    assert {r.query_id for r in got} == {5, 6, 7, 8, 9}
    assert all(r.doc_id is not None for r in got)
    assert search(odd.limit(0), odd).count() == 0 and search(odd, odd.limit(0)).count() == 0
    assert odd.where(F.col("doc_id").isNull()).count() == 1


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark):
    rows = [(1, "red fox red"), (2, "blue whale"), (2, "red fox runs far"), (3, "green fox"), (3, "green fox"), (4, "far blue")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(9, "red fox blue green green")], "doc_id long, text string")
    want = brute_whole(rows, [(9, "red fox blue green green")], 10)
    assert sorted(w[1] for w in want) == [1, 2, 2, 3, 3, 4]
    for shards in (1, 2):
        equal(sorted(search(frame.repartition(shards), asked, n_terms=None).collect()), want)
        few = search(frame.repartition(shards), asked, n_terms=16).collect()
        assert sorted(r.doc_id for r in few) == [1, 2, 2, 3, 3, 4]


def test_rounds_with_thresholds_find_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    asked = docs.where("doc_id % 50 = 0")
    once = sorted(map(tuple, search(docs, asked).collect()))
    assert len(once) == 10 * asked.count()
    monkeypatch.setattr(bm25, "SHARD", 1 << 16)  # of many shards, so that there are rounds
    assert sorted(map(tuple, search(docs.repartition(6), asked, queries_per_task=9).collect())) == once
    assert sorted(map(tuple, search(docs, asked, k=3).collect())) == [r for r in once if r[2] <= 3]


def test_long_words_of_equal_polynomials_are_told_apart():
    a, b = b"a", b"b"
    for _ in range(11):
        a, b = a + b, b + a
    assert word_hashes(a)[0] != word_hashes(b)[0] and word_hashes(a)[0] == word_hashes(bytes(a))[0]


def test_small_batches_make_one_shard_of_the_same_rows(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", [1 + i * i for i in range(26)], k=rng.randint(1, 60))) for _ in range(300)] + [None, ""]
    terms, rows, counts, _ = bm25._postings([t or "" for t in texts[:40]])
    table = pa.table({"query_id": pa.array(rows, pa.int64()), "term": terms, "idf": 1 + (terms % 7) / 7, "n": pa.array(counts, pa.int64())})
    queries, batch = bm25.Queries(table), pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])

    def best(size, piece, group, tile):
        for name, value in (("PIECE", piece), ("GROUP", group), ("TILE", tile)):
            monkeypatch.setattr(bm25, name, value)
        queries.__dict__.pop("tiles", None)
        shard, = bm25._shards(queries, iter([batch.slice(i, size) for i in range(0, len(texts), size)]))
        query, row, score = bm25._best_whole(shard, 30.0, 5, np.zeros(len(queries.ids), np.int64))
        found = sorted(zip(query.tolist(), (-score).tolist(), row.tolist(), strict=True))
        return [x for q in range(40) for x in [f for f in found if f[0] == q][:5]]

    want = best(len(texts), 1 << 20, 1 << 11, 1 << 10)
    assert len(want) == 200
    assert best(7, 100, 16, 8) == want and best(50, 1 << 20, 64, 1 << 10) == want
