"""Grouping of spelling variants: words one edit apart, and the commoner form that a word goes back to.

Of two words one edit apart, the shorter of l letters, one half of those l stands in both, at the
same end; so words meet by that half. Where more than `block` words meet, the part in which the edit
can be is halved again, down to one letter. The words that meet are sorted, and each word goes
through the list with rows of a banded edit matrix: rows are kept as far as the next word in the list begins like the last
(their longest common prefix), and words that share a prefix of more than one edit are skipped together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, distinct, parts, release
from tapeloom.llm.near_dup import run_hashes

#: A-Z in lower case, a-z kept; what else stands in a word is told from the bytes around it.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
PART = 1 << 20
NEVER = 1 << 20
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def _crcs(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of runs of b, each going on from a crc32 before it."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), "left")
    for i, n in enumerate(left):
        at = order[:n]
        state[at] = _CRC[(state[at] ^ b[starts[at] + i]) & np.uint32(255)] ^ (state[at] >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def word_counts(docs: DataFrame, *, min_chars: int = 6, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of min_chars letters or more: maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.

    With damage a word whose h, the crc32 of `<id>:<word>`, is a multiple of it loses its letter at h modulo its length, before
    it is counted. Nulls: a null text has no words, a null id is an empty one. An empty table has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 1, PART):
            blobs = [t.encode("utf-8", "replace") for t in texts]
            b = np.frombuffer(b" ".join(blobs).translate(FOLD), np.uint8)
            lead = b == 0xC3
            after = np.concatenate(([False], lead[:-1])) if len(b) else lead
            letter = (b < 128) & (b != 32) | lead | after
            inside = np.concatenate(([False], letter, [False]))
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[::2], edges[1::2]
            wide = np.concatenate(([0], np.cumsum(lead)))
            chars = ends - starts - (wide[ends] - wide[starts])
            long = chars >= min_chars
            starts, ends, chars = starts[long], ends[long], chars[long]
            hashes = run_hashes(b, starts, ends)
            data = b.tobytes()
            of = np.searchsorted(np.cumsum([0] + [len(x) + 1 for x in blobs]), starts, "right") - 1
            lost: dict[bytes, int] = {}
            if damage:
                ids = [zlib.crc32(f"{x if x is not None else ''}:".encode()) for x in batch.column(0).to_pylist()]
                mixed = hashes ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                _, first, at = distinct(mixed)
                h = _crcs(b, starts[first], (ends - starts)[first], np.array(ids, np.uint32)[of[first]])
                gone = (h % damage == 0)[at]
                for i in np.flatnonzero(gone).tolist():
                    word, x = data[starts[i] : ends[i]].decode(), int(h[at[i]])
                    place = x % len(word)
                    if len(word) > min_chars:
                        left = (word[:place] + word[place + 1 :]).encode()
                        lost[left] = lost.get(left, 0) + 1
                starts, ends, hashes = starts[~gone], ends[~gone], hashes[~gone]
            _, first, at = distinct(hashes)
            n = np.bincount(at, minlength=len(first))
            words = [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([*words, *lost], pa.binary()).cast(pa.string()), pa.array([*n.tolist(), *lost.values()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_in(words: list[str], shared: int = 0) -> list[tuple[int, int]]:
    """Places (i, j), i < j, of the words exactly one edit apart in a sorted list of distinct words that all begin with the same `shared` letters."""
    out, n = [], len(words)
    lcp = [0] * n
    for k in range(1, n):
        a, b, d = words[k - 1], words[k], shared
        end = min(len(a), len(b))
        while d < end and a[d] == b[d]:
            d += 1
        lcp[k] = d
    for i in range(n - 1):
        word = words[i]
        m = len(word)
        # cells of a row: the edits between a prefix of a listed word and the prefixes of word one shorter, as long and one longer; 2 stands for more
        rows = [(2, 0, 1)] + [(1, 0, 1)] * m
        depth, k = m, i + 1
        while k < n:
            depth = min(depth, lcp[k])
            other = words[k]
            size = len(other)
            row = rows[depth]
            while depth < size:
                c = other[depth]
                x, y, z = row
                x = min(x + (not 0 < depth <= m or c != word[depth - 1]), y + 1)
                y = min(y + (depth >= m or c != word[depth]), z + 1, x + 1)
                z = min(z + (depth + 1 >= m or c != word[depth + 1]), y + 1)
                if x > 1 and y > 1 and z > 1:
                    break
                depth += 1
                row = (x, y, z)
                if depth < len(rows):
                    rows[depth] = row
                else:
                    rows.append(row)
            else:
                if -1 <= m - size <= 1 and row[m - size + 1] == 1:
                    out.append((i, k))
                k += 1
                continue
            # nothing that begins like this can be near
            k = bisect_left(words, other[: depth + 1] + "\U0010ffff", k + 1)
            if k < n:
                depth = min(depth, lcp[k])
    return out


def near_words(words: DataFrame, *, block: int = 64) -> DataFrame:
    """(word, n, near, near_n) for every two words of words(word, n), distinct and not null, one edit apart, in both orders."""
    size = F.length("word")
    both = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("l")).where("l >= 0")
    state = both.select("word", "n", "size", "l", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(NEVER).alias("bar"))
    keys = ["l", "i", "j", "bar", "head", "tail"]

    def halved(rows: DataFrame) -> DataFrame:
        """The two halves of what is open in a row; words of the second begin alike for less than `bar` letters, so no two meet in both."""
        half = F.floor((F.col("l") - F.col("i") - F.col("j")) / 2).cast("int")
        first = F.struct((F.col("i") + half).alias("i"), "j", "bar")
        second = F.struct("i", (F.col("j") + half).alias("j"), F.least("bar", F.col("i") + half).alias("bar"))
        halves = F.when(half > 0, F.array(first, second)).otherwise(F.array(F.struct("i", "j", "bar")))
        return rows.select("word", "n", "size", "l", F.inline(halves)).select("*", F.substring("word", F.lit(1), F.col("i")).alias("head"), F.substring("word", F.col("size") - F.col("j") + 1, F.col("j")).alias("tail"))

    def scanned(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: tuple[list, ...] = ([], [], [], [])
                for l, i, j, bar, listed in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    back = j > i
                    own = sorted((x["word"][::-1] if back else x["word"], x["n"]) for x in listed)
                    plain = [w for w, _ in own]
                    for x, y in near_in(plain, max(i, j)):
                        a, b = (plain[x][::-1], plain[y][::-1]) if back else (plain[x], plain[y])
                        if min(len(a), len(b)) == l and a[:bar] != b[:bar]:
                            for column, values in zip(out, ((a, b), (own[x][1], own[y][1]), (b, a), (own[y][1], own[x][1])), strict=True):
                                column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["word", "n", "near", "near_n"])

        lists = rows.groupBy(keys).agg(F.collect_list(F.struct("word", "n")).alias("own")).where(F.size("own") > 1)
        return lists.select("l", "i", "j", "bar", "own").mapInArrow(run, "word string, n long, near string, near_n long")

    found = None
    while True:
        rows = cut(halved(state))
        counts = cut(rows.groupBy(keys).agg(F.count("*").alias("c")).where("c > 1"))
        # one open letter, or one and two, is as narrow as it gets
        small = (F.col("c") <= block) | (F.col("l") - F.col("i") - F.col("j") < 2)
        met = cut(scanned(rows.join(counts.where(small), keys, "left_semi")))
        found = met if found is None else found.unionByName(met)
        large = counts.where(~small)
        if not large.head(1):
            release(rows, counts)
            return found
        state = rows.join(large, keys, "left_semi").select("word", "n", "size", "l", "i", "j", "bar")


def spelling_groups(words: DataFrame, *, ratio: int = 5, block: int = 64) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of words(word, n).

    form is the commonest of the words one edit apart (ties: the first in the order of code points) if
    it is ratio times as common or more, else null; root is the last of the forms that follow from each other. Words are distinct; rows
    with a null word go. An empty table gives an empty table. No list of more than block words is compared as
    one, but for words that differ in one or two letters at a given place.
    """
    words = cut(words.where("word IS NOT NULL").select("word", "n"))
    near = near_words(words, block=block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("x"), "near")).alias("most"))
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("most.near").alias("form"), (-F.col("most.x")).alias("form_n"))
    fits = F.col("form_n") >= ratio * F.col("n")
    rows = cut(rows.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    # each form is ratio times as common as the word before, so that a chain is short; following it takes as many rounds as its length has bits
    ends = cut(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(ends)
        ends = step
        if not step.where("moved").head(1):
            return rows.join(ends.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
