"""Language ID of mixed text.

A word's script narrows its candidate languages, byte trigrams score it under each candidate, and
a Viterbi path over the words with a penalty for every switch labels the spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import parts

BUCKETS = 1 << 15
SEGMENT = 1 << 17
#: First code points of scripts and of what lies between them: fixed values.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0x20000, "han"), (0x32000, "other"))
NAMES = sorted({n for _, n in SCRIPTS})
FIRST = np.array([s for s, _ in SCRIPTS])
SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
#: All but letters and the marks on them: numerals of any kind are none, nor are marks without a letter.
OTHER = regex.compile(r"(?:\A|[^\p{L}\p{M}]+)\p{M}*")
#: Words that a path takes one after the other; longer texts are cut and their parts joined.
STRETCH = 2048


def letters(text: str) -> bytes:
    """The words of a text, which are runs of letters with their marks, composed, in lower case and between single blanks."""
    return b" " + OTHER.sub(" ", unicodedata.normalize("NFC", text.lower())).strip().encode("utf-8", "replace") + b" "


def _segments(data: bytes) -> Iterator[np.ndarray]:
    """data in pieces that begin and end with a blank."""
    at = 0
    while at + 1 < len(data):
        end = data.find(b" ", min(at + SEGMENT, len(data) - 1)) + 1
        yield np.frombuffer(data, np.uint8, end - at, at)
        at = end - 1


def _trigrams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram about every byte of a word, and where words begin among those bytes."""
    x = b.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int32)
    inside = b[1:-1] != 32
    begins = inside & (b[:-2] == 32)
    return h[inside], np.flatnonzero(begins[inside])


def _scripts(b: np.ndarray) -> np.ndarray:
    """The script of every word by its first letter."""
    starts = np.flatnonzero((b[:-1] == 32) & (b[1:] != 32)) + 1
    pad = np.concatenate((b, np.zeros(3, np.uint8))).astype(np.int32)
    c0, c1, c2, c3 = (pad[starts + i] for i in range(4))
    low = lambda c: c & 63
    two, three, four = (c0 & 31) << 6 | low(c1), (c0 & 15) << 12 | low(c1) << 6 | low(c2), (c0 & 7) << 18 | low(c1) << 12 | low(c2) << 6 | low(c3)
    code = np.where(c0 < 0x80, c0, np.where(c0 < 0xE0, two, np.where(c0 < 0xF0, three, four)))
    return SCRIPT[np.searchsorted(FIRST, code, "right") - 1]


@dataclass
class Model:
    languages: list[str]
    #: log probability of a bucket under each language
    scores: np.ndarray
    #: whether a language was seen in a script
    scripts: np.ndarray


def train(labelled: DataFrame, *, per_language: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all languages in labelled, from about per_language whole rows of each.

    Rows are chosen by the hash of their id, in the share that gives that number, so that the
    choice needs no sort. Only trigram counts reach the driver: a bounded table for each language.
    Rows without a text or a language teach nothing. Of an empty table comes a model of no language.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, len(NAMES)), bool))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n) * 2**20)])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")])
    width = BUCKETS + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                own = total.setdefault(lang.as_py(), np.zeros(width, np.int64))
                for b in _segments(letters(text.as_py())):
                    own[:BUCKETS] += np.bincount(_trigrams(b)[0], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(_scripts(b), minlength=len(NAMES))
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = np.zeros((len(languages), width))
    summed = chosen.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[summed["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64), summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    seen = scripts >= 0.01 * np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(languages, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), seen)


def word_scores(data: bytes, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x languages) and lengths in bytes of the words of letters()."""
    scores, lengths = [], []
    for b in _segments(data):
        grams, begins = _trigrams(b)
        own = np.stack([np.add.reduceat(s[grams], begins) for s in model.scores], 1)
        may = model.scripts[:, _scripts(b)].T
        own[~may & may.any(1, keepdims=True)] -= 1e4
        scores.append(own - own.max(1, keepdims=True))
        lengths.append(np.diff(np.append(begins, len(grams))))
    return np.concatenate(scores), np.concatenate(lengths)


def _forward(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, penalty: float, value: np.ndarray, begun: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of the best paths, whether a word keeps its predecessor's language, the language jumped from) after runs of scores' rows, the longest first, from the values before them; runs not begun pay nothing for their first word."""
    width = scores.shape[1]
    stays = np.zeros(scores.shape if keep else (0, width), bool)
    jumps = np.zeros(len(scores) if keep else 0, np.uint8 if width < 256 else np.uint16)
    live = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), "left")
    fee = np.where(begun, penalty, 0.0)
    for t, n in enumerate(live):
        at, v = starts[:n] + t, value[:n]
        best = v.argmax(1)
        top = (v[np.arange(n), best] - (penalty if t else fee[:n]))[:, None]
        if keep:
            stays[at], jumps[at] = v >= top, best
        value[:n] = np.maximum(v, top) + scores[at]
    return value, stays, jumps


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """For every word the language on the best path of its text; texts are runs of scores' rows.

    All texts advance one word a step together, the longest first, so a step is a few array operations. Texts of
    more than STRETCH words are cut into stretches that advance together too: first from every language, which gives what a stretch
    adds on the way from one language to another; sums of those are the values that each stretch begins with.
    """
    width = scores.shape[1]
    parts = -(-counts // STRETCH)
    text = np.repeat(np.arange(len(counts)), parts)
    number = np.arange(len(text)) - (np.cumsum(parts) - parts)[text]
    begin = starts[text] + number * STRETCH
    size = np.minimum(counts[text] - number * STRETCH, STRETCH)
    value = np.zeros((len(text), width))
    cut = np.flatnonzero(parts[text] > 1)
    if len(cut):
        order = cut[np.argsort(-size[cut], kind="stable")]
        each = np.repeat(order, width)
        entry = np.full((len(each), width), -np.inf)
        entry[np.arange(len(each)), np.tile(np.arange(width), len(order))] = 0
        ways, _, _ = _forward(scores, begin[each], size[each], penalty, entry, number[each] > 0, False)
        added = dict(zip(order.tolist(), ways.reshape(-1, width, width), strict=True))
        for i in cut.tolist():
            if number[i]:
                value[i] = before
            before = (value[i][:, None] + added[i]).max(0)
            before = before - before.max()
    order = np.argsort(-size, kind="stable")
    last, stays, jumps = _forward(scores, begin[order], size[order], penalty, value[order], number[order] > 0, True)
    # back from every language in which a stretch can end, then those ends from the last stretch on
    ends = np.tile(np.arange(width), (len(order), 1))
    path = np.zeros((len(scores), width), jumps.dtype)
    rows = np.arange(len(order))[:, None]
    lengths = size[order]
    live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = begin[order[:n]] + t
        own = ends[:n]
        path[at] = own
        ends[:n] = np.where(stays[at[:, None], own], own, jumps[at][:, None])
    entered, final = np.empty_like(ends), np.empty_like(last)
    entered[order], final[order] = ends, last
    state = np.zeros(len(text), np.int64)
    for i in range(len(text) - 1, -1, -1):
        alone = i + 1 == len(text) or text[i + 1] != text[i]
        state[i] = final[i].argmax() if alone else entered[i + 1][state[i + 1]]
    out = np.zeros(len(scores), jumps.dtype)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[at] = path[at, np.repeat(state, size)]
    return out


def _label(texts: list[str], model: Model, penalty: float) -> tuple[list[str], list[float], list[list[dict]]]:
    datas = [letters(t) for t in texts]
    full = [i for i, d in enumerate(datas) if len(d) > 2]
    labels, shares, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if not full or not model.languages:
        return labels, shares, spans
    counts = np.array([datas[i].count(b" ") - 1 for i in full])
    starts = np.cumsum(counts) - counts
    scores, lengths = word_scores(b"".join(datas[i][:-1] for i in full) + b" ", model)
    path = viterbi(scores, starts, counts, penalty)
    for i, s, n in zip(full, starts, counts, strict=True):
        own, size = path[s : s + n], lengths[s : s + n]
        by = np.bincount(own, size, len(model.languages))
        best = int(by.argmax())
        labels[i], shares[i] = model.languages[best], float(by[best] / by.sum())
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), int(n)]
        spans[i] = [{"first_word": a, "end_word": b, "lang": model.languages[own[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
    return labels, shares, spans


def language_spans(docs: DataFrame, model: Model, *, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, spans for every row; with whole all columns of docs, and these as _lang_pred, _score, _spans.

    spans are runs of words (letters only, from 0, end exclusive) of one language; lang_pred has
    the largest share of the text's letters, and score is that share. Ties go to the language first
    by name. Nulls: a null text, or one without a letter, is und with score 0 and no spans, as is
    every text under a model of no language. Repeated rows are labelled alike; further columns,
    also one named lang, are not read; with whole, columns named as its own three are replaced. The whole text counts, however long it is, at a cost in proportion to its length. Marks belong to their letters and composed and decomposed letters are alike. An empty table gives an empty one.
    """
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("_lang_pred", "_score", "_spans")]) if whole else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    at = rows.columns.index(text_col if whole else "text")
    kept = [f for i, f in enumerate(rows.schema) if whole or i != at]
    lead = "_" if whole else ""
    names = [*(f"c{i}" for i in range(len(kept))), "lang_pred", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string())]))
        for batch, texts in parts(batches, at, 1 << 22):
            labels, shares, spans = _label(texts, model, penalty)
            columns = [c for i, c in enumerate(batch.columns) if whole or i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labels), pa.array(shares, pa.float64()), pa.array(spans, span)], names=names)

    shape = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=False))
    found = rows.mapInArrow(run, f"{shape}, lang_pred string, score double, spans array<struct<first_word:long,end_word:long,lang:string>>")
    return found.toDF(*[f.name for f in kept], *[lead + n for n in names[-3:]])


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 by 4; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
