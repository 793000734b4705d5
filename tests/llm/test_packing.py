import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapeloom.llm.packing import SumOfSquares, pack, word_encoder
from tapeloom.llm.queries import tokenizer_path


def check(docs, got, window):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {}
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(r.doc_id, []).append(ids)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == want.keys()
    for d, arrays in want.items():
        ends = {len(a) for a in arrays}
        assert {r.doc_tokens for r in pieces[d]} == ends
        assert sum(r.length for r in pieces[d]) == sum(map(len, arrays))
        for r in pieces[d]:
            assert any(zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for a in arrays)
        if len(arrays) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return by


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    docs = docs.cache()
    got = pack(docs, lambda: word_encoder(tokenizer_path())).collect()
    by = check(docs, got, 4096)
    whole = sum(r.length == r.doc_tokens for r in got)
    assert whole > 0.6 * docs.count() and len(by) > 10


def test_few_windows_and_small_cache(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pack(docs, lambda: word_encoder(tokenizer_path(), cached=50), window=64, open_windows=3).collect()
    check(docs, got, 64)


def test_odd_rows(spark, odd):
    got = pack(odd, lambda: word_encoder(tokenizer_path())).collect()
    check(odd, got, 4096)
    assert pack(odd.limit(0), lambda: word_encoder(tokenizer_path())).count() == 0


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "É́ x　y z  İ", "it's don't  WE'LL\t42 007", "é ́a ok", ""])
def test_encoder_equals_the_tokenizer(text):
    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert next(word_encoder(tokenizer_path())([text])).tolist() == want


def test_level_choice_is_that_of_the_sum_of_squares():
    rng = random.Random(5)
    packer = SumOfSquares(20, 10**6)
    for doc in range(300):
        size = rng.randint(1, 19)
        count = packer.count.copy()

        def cost(h, count=count, size=size):
            n = count.copy()
            if h:
                n[h] -= 1
            if h + size < 20:
                n[h + size] += 1
            return int((n[1:20] ** 2).sum())

        may = [h for h in range(0, 21 - size) if h == 0 or count[h]]
        assert cost(packer._best(size, True)) == min(map(cost, may))
        list(packer.place(doc, np.zeros(size, np.uint32), size))


def test_ids_equal_the_tokenizers_on_odd_strings():
    tokenizer, encode = Tokenizer.from_file(tokenizer_path()), word_encoder(tokenizer_path(), cached=500)
    rng = random.Random(10)
    odd = ["a", "B", "İ", "I", "ı", "é", "é", "x́", "̇", "ß", "ſ", "K", "Ω", "Σ", "ά", "中", "1", "²", "Ⅷ", "٣", "×", "÷", "Ã", "ÿ", ".", ",", ".", ",", "'", "'s", "-", "<", "≠", "\x02", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", " ", " ", "\n", "\t", "\x0b", "\U0001f600", "<|endoftext|>"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 7))) for _ in range(20000)]
    texts += ["", ".", "..", "a.", ".a", "a,. b", "İ.", "İ,", "\x1c,", "x́. y", "\x02 \x02", " \x02. "]
    for at in range(0, len(texts), 3000):
        part = texts[at : at + 3000]
        assert [x.tolist() for x in encode(part)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
