import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tapeloom.llm import queries
from tapeloom.llm.spelling import near_in, near_words, spelling_groups, word_counts

WORD = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs, damage=None, least=6):
    """Words of (id, text) by the letter of the contract."""
    out = Counter()
    for i, text in docs:
        for run in WORD.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                out[w] += 1
    return out


def neighbours(words):
    """All words one edit apart, by leaving out a letter of each."""
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
            if (left := w[:i] + w[i + 1 :]) in near:
                near[w].add(left)
                near[left].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= set(own) - {w}
    return near


def brute(counts, ratio=5):
    near, form = neighbours(counts), {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(rows)


def collected(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in counted(docs, 199).items() if n >= 5}
    found = collected(queries.op12_spelling_variants(spark, sf))
    assert found == brute(counts) and sum(r[1] is not None for r in found) > 3


def test_words_of_odd_texts(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()] + [(20, "École ÉCOLE école × x×yzabc÷d naïveté́ ABCdefÿ ’quoted’ ﬁgures Ā"), (21, "aaaaaaaa " * 300)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(docs[-2:], "doc_id long, text string"))
    for damage in (None, 3, 1):
        assert dict(map(tuple, word_counts(df, damage=damage).collect())) == counted(docs, damage)
    assert word_counts(df.limit(0), damage=3).count() == 0


def test_near_words_equal_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab" if rng.random() < 0.8 else "cé\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(900)})
    want = {(w, x) for w, own in neighbours(words).items() for x in own}
    assert {(words[i], words[j]) for i, j in near_in(words)} == {(a, b) for a, b in want if a < b}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    for block in (1, 16, 10_000):
        found = [tuple(r) for r in near_words(df, block=block).collect()]
        assert len(found) == len(want) and {(a, b) for a, _, b, _ in found} == want
        assert all(words[n] == a and words[m] == b for a, n, b, m in found)


def test_forms_and_roots(spark):
    counts = {"letter": 1000, "lettre": 40, "leter": 100, "leer": 12, "lettes": 200, "letten": 200, "lettenx": 30, "other": 5, "zzzzzz": 7, "é": 9, "": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("near", F.lit("x"))
    got = collected(spelling_groups(df.union(spark.createDataFrame([(None, 4, "y")], "word string, n long, near string"))))
    assert got == brute(counts)
    by = {r[0]: r for r in got}
    assert by["leer"][1:3] == ("leter", "letter") and by["lettenx"][1:3] == ("letten", "letter")
    assert spelling_groups(df.limit(0)).count() == 0
