import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import queries
from tapeloom.llm.alignment import Pair, _Part, align, aligned, byte_letters, ranks
from tapeloom.llm.queries import tokenizer_path

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def whole():
    """Ids and ends of the tokens of a whole text, or None."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = byte_letters()

    def tokens(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + text).encode()
        return ((ids_a, np.cumsum([len(x) for x in bytes_a]).tolist()), (ids_b, np.cumsum([len(x) for x in bytes_b]).tolist())) if b"".join(bytes_a) == want == b"".join(bytes_b) else None

    return tokens


def by_hand(a, b):
    """Groups and links of ids with ends, by a walk over the ends of both."""
    groups, links, i, j = [], [], 0, 0
    (ids_a, ends_a), (ids_b, ends_b) = a, b
    x, y = 0, 0
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        if ends_a[i] == ends_b[j]:
            i, j = i + 1, j + 1
            groups.append((ids_a[x:i], ids_b[y:j]))
            x, y = i, j
        elif ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1
    return groups, links


def brute(docs, whole):
    known = [(i, t and whole(t)) for i, t in docs]
    done = [(i, by_hand(*x)) if x else (i, None) for i, x in known]
    count = Counter(link for _, x in done if x for link in x[1])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for (i, x), (_, t) in zip(done, known, strict=True):
        if not x:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = x
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((i, len(t[0][0]), len(t[1][0]), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, rows))


def test_galloping():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (5, 0), (1, 1), (7, 900), (900, 7), (400, 400), (3, 3)):
        a, b = (np.unique(rng.integers(0, 1200, k)) for k in (n, m))
        assert ranks(a, b).tolist() == np.searchsorted(b, a).tolist()
        assert ranks(b, a).tolist() == np.searchsorted(a, b).tolist()
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (sorted({n, *rng.integers(1, n + 1, int(rng.integers(0, 30))).tolist()}) for _ in range(2))
        groups, links = by_hand((list(range(len(a))), a), (list(range(len(b))), b))
        at_a, at_b, link_a, link_b = align(np.array(a), np.array(b))
        assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == links
        assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == [(x[-1], y[-1]) for x, y in groups]


def test_chunks_have_the_tokens_of_whole_texts(whole):
    rng = random.Random(8)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B", "the", "tion", ".", ",", "'s", "'", "12", "3", "é", "×", "÷", "ß", "▁", " ", " ", "́", "中", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "\x1c", "\x85", "İ", "x" * 70]
    plain = [b for b in bits if b != "▁"]
    texts = ["".join(rng.choice(bits if k % 9 == 0 else plain) for _ in range(rng.randint(1, 14))) for k in range(4000)]
    pair = Pair(*PATHS, cached=700)
    lost = 0
    for at in range(0, len(texts), 500):
        own = texts[at : at + 500]
        part = _Part(pair, own)
        kept = set(part.rows)
        for i, t in enumerate(own):
            tokens = whole(t)
            assert (i in kept) == (tokens is not None), repr(t)
            lost += tokens is None
        bounds = np.searchsorted(part.doc, np.arange(len(part.rows) + 1))
        for k, i in enumerate(part.rows):
            groups, links = by_hand(*whole(own[i]))
            known = [part.known[x] for x in part.at[bounds[k] : bounds[k + 1]]]
            assert b";".join(x[4] for x in known).decode() == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups), repr(own[i])
            assert np.frombuffer(b"".join(x[3] for x in known), np.int64).tolist() == [a << 32 | b for a, b in links]
    assert lost > 20


def test_query_equals_whole_texts(spark, sf, whole):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries.op13_tokenizer_alignment(spark, sf).collect()) == brute(docs, whole)


def test_odd_rows(spark, odd, whole):
    more = [(20, "one ▁ two"), (21, "tail blanks  \n"), (22, "<|endoftext|> x"), (None, None)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs = [tuple(r) for r in df.collect()]
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("row", "pair", "n", "b", "pairs")])
    for common in (1 << 17, 50, 0):
        assert sorted(repr(tuple(r)) for r in aligned(clash, PATHS, common=common).collect()) == brute(docs, whole)
    assert aligned(df.limit(0), PATHS).count() == 0
