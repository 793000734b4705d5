import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm.language import Model, held_out, language_spans, letters, train, viterbi, word_scores


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_spans(docs, train(docs.where(~held_out()))).join(docs.select("doc_id", "lang", held_out().alias("out")), "doc_id").where("out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_path_equals_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    counts = np.array([1, 5, 3, 6, 1])
    starts = np.cumsum(counts) - counts
    scores = rng.normal(size=(counts.sum(), 3))
    got = viterbi(scores, starts, counts, 0.7)

    def value(path, own):
        return sum(own[i, s] for i, s in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for s, n in zip(starts, counts, strict=True):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: value(p, scores[s : s + n]))
        assert np.isclose(value(best, scores[s : s + n]), value(got[s : s + n], scores[s : s + n]))


def test_mixed_text_and_scripts(spark):
    rng = random.Random(1)
    words = {"en": "the of and that with this from there would which".split(), "de": "der die und nicht eine schön über zwischen".split(), "ru": "это как его только был привет".split(), "el": "και το να είναι της".split()}
    rows = [(i * 10 + j, " ".join(rng.choices(w, k=30)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(8)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "el", "en", "ru"]
    text = "the which from there, und nicht über zwischen eine. это привет! και είναι 12"
    (r,) = language_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, penalty=3.0).collect()
    assert [(s.lang, s.first_word, s.end_word) for s in r.spans] == [("en", 0, 4), ("de", 4, 9), ("ru", 9, 11), ("el", 11, 13)]
    assert r.lang_pred == "de" and 0.3 < r.score < 0.6


def test_segments_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(1)
    model = Model(["a", "b"], rng.normal(size=(2, 1 << 15)).astype(np.float32), np.ones((2, 16), bool))
    data = letters("So, many wörter и слова stand 12 here again " * 40)
    whole = word_scores(data, model)
    monkeypatch.setattr("tapeloom.llm.language.SEGMENT", 50)
    parts = word_scores(data, model)
    assert np.allclose(whole[0], parts[0], atol=1e-4) and (whole[1] == parts[1]).all() and len(whole[1]) == data.count(b" ") - 1


def test_odd_rows(spark, odd):
    model = train(odd.where(~held_out()))
    rows = language_spans(odd, model).collect()
    assert len(rows) == 10
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in rows if r.doc_id in (7, 8)} == {"de"}
    none = train(odd.limit(0))
    assert {r.lang_pred for r in language_spans(odd, none).collect()} == {"und"}
    assert language_spans(odd.limit(0), model).count() == 0
    assert odd.select(held_out().alias("h")).where(F.col("h").isNull()).count() == 0


def test_numerals_are_no_letters():
    assert all(letters(x).strip() == b"" for x in ("²", "½", "Ⅷ", "①", "12 ٣"))
    assert letters("a²b é1").split() == [b"a", b"b", "é".encode()]


def test_marks_belong_to_their_letters(spark):
    assert letters("हिन्दी भाषा").split() == [w.encode() for w in "हिन्दी भाषा".split()]
    assert letters("ภาษาไทย ที่นี่").split() == [w.encode() for w in "ภาษาไทย ที่นี่".split()]
    assert letters("cafe\u0301 ECOLE\u0301 İstanbul").split() == ["café".encode(), "ecolé".encode(), "i̇stanbul".encode()]
    assert letters("\u0301 \u0301a 1\u0301b \u0301\u0301").split() == [b"a", b"b"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("हिन्दी भाषा में यह एक वाक्य है", "hi"), ("ภาษาไทย เป็น ภาษา ที่ ใช้", "th"), ("été à la crème brûlée", "fr"), ("the of and that with", "en")] * 6)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["यह भाषा", "ภาษา ที่", "cre\u0300me e\u0301te\u0301", "that of the"]
    got = language_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["hi", "th", "fr", "en"]


def test_stretches_do_not_change_a_path(monkeypatch):
    rng = np.random.default_rng(3)
    counts = np.array([1, 40, 7, 23, 8, 2])
    starts = np.cumsum(counts) - counts
    scores = rng.normal(size=(counts.sum(), 4))
    whole = viterbi(scores, starts, counts, 1.3)
    for n in (1, 2, 7, 8, 39, 40):
        monkeypatch.setattr("tapeloom.llm.language.STRETCH", n)
        assert (viterbi(scores, starts, counts, 1.3) == whole).all()


def test_a_million_words_in_time():
    import time

    rng = np.random.default_rng(4)
    scores = rng.normal(size=(1_000_000, 4)).astype(np.float32)
    began = time.perf_counter()
    path = viterbi(scores, np.array([0]), np.array([1_000_000]), 2.0)
    assert time.perf_counter() - began < 10 and len(path) == 1_000_000
