import numpy as np
import pytest
from test_line_dedup import brute as brute_lines
from test_mixing import TREE_WEIGHTS, tree_path
from test_mixing import brute as brute_mix
from test_near_dup import brute as brute_near
from test_packing import check as check_packed

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tapeloom.llm.common import LEAN, cut
from tapeloom.llm.language import _scripts, _trigrams, held_out, letters, train


def label(text, model, penalty=12.0):
    """Main language and its share, by a plain path over one word after the other."""
    words = letters(text or "").split()
    if not words:
        return "und", 0.0
    value, back = None, []
    for w in words:
        b = np.frombuffer(b" " + w + b" ", np.uint8)
        own = model.scores[:, _trigrams(b)[0]].astype(float).sum(1)
        may = model.scripts[:, _scripts(b)[0]]
        if may.any():
            own[~may] -= 1e4
        if value is None:
            value = own
            continue
        best = int(value.argmax())
        back.append([i if value[i] >= value[best] - penalty else best for i in range(len(own))])
        value = np.maximum(value, value[best] - penalty) + own
        value -= value.max()
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    size = np.zeros(len(model.languages))
    for s, w in zip(reversed(path), words, strict=True):
        size[s] += len(w)
    return model.languages[int(size.argmax())], size.max() / size.sum()


def rows_of(df):
    assert df.columns == pipeline.COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark, sf):
    """By stage its input and its output."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        after = cut(stage(spark, docs, sf))
        out[name] = docs, after
        docs = after
    return out


def test_language(stages):
    before, after = stages["language_id"]
    model = train(before.where(~held_out()))
    want = []
    for r in before.collect():
        lang, share = label(r.text, model)
        if lang != "und" and share >= pipeline.MIN_SCORE:
            want.append((r.doc_id, r.text, lang, r.source, r.n_chars))
    assert rows_of(after) == sorted(want, key=repr) and len(want) > 0.8 * before.count()


def test_lines(stages):
    before, after = stages["line_dedup"]
    rows = before.collect()
    texts = [t for _, _, t in brute_lines([(r.text, r.source) for r in rows], 10, 1 << 30)]
    assert rows_of(after) == sorted(((r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(rows, texts, strict=True)), key=repr)


def test_long_lines_go_too(spark, sf):
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, f"own words of text {i}\n{passage}\nend {i}", "en", f"site{i}", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [(i, t := f"own words of text {i}\nend {i}", "en", f"site{i}", len(t)) for i in range(10)]
    assert len(passage) > 200 and rows_of(pipeline.line_dedup(spark, docs, sf)) == want
    nine = docs.where("doc_id < 9")
    assert [r[1] for r in rows_of(pipeline.line_dedup(spark, nine, sf))] == [r[1] for r in rows[:9]]


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    rows = before.collect()
    found = brute_near([(r.doc_id, r.text) for r in rows], 5, 80)
    # a text without words is linked with nothing and stays
    want = [tuple(r) for r in rows if found[r.doc_id][0] == 0 or found[r.doc_id][1] == r.doc_id]
    assert rows_of(after) == sorted(want, key=repr) and len(want) < len(rows)


def test_weights(stages):
    before, after = stages["mixing"]
    rows = before.collect()
    copies = brute_mix([(r.doc_id, tree_path(r.source, r.lang), r.text) for r in rows], TREE_WEIGHTS, 80, 1, 7)
    assert rows_of(after) == sorted((tuple(r) for r, n in zip(rows, copies, strict=True) if n), key=repr)


def test_packed(stages):
    before, after = stages["packing"]
    check_packed(before, after.collect(), 4096)


def test_run_gives_the_last_stage(spark, sf, stages):
    want = stages["packing"][1]
    own = {name: "8192" if name.endswith("BatchSize") else str(64 << 20) for name in LEAN}
    for name, value in own.items():
        spark.conf.set(name, value)
    got = entry.queries()["pipeline"](spark, sf)
    assert {name: spark.conf.get(name) for name in LEAN} == own
    assert got.columns == want.columns
    count = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").sum("length").collect()))
    assert count(got) == count(want)


def test_odd_rows(spark, sf, odd):
    docs = odd
    for name, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
        if name == "near_dedup":
            # 8 is a near copy of 7, 6 a copy of 5; a repeated row stays with its document
            assert sorted(r.doc_id for r in docs.where("doc_id in (5, 6, 7, 8)").collect()) == [5, 5, 7]
    empty = odd.limit(0)
    for _, stage in pipeline.STAGES:
        empty = cut(stage(spark, empty, sf))
    assert empty.count() == 0
