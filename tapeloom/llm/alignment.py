"""Alignment of two tokenizers' tokens over the same bytes.

The lists of the byte offsets where tokens end are intersected by galloping: the shorter list drives
an exponential search, then a binary one, into the longer. Common indices slice the tokens into
groups, and differences of ranks give the range of tokens of the one that a token of the other overlaps.

Neither tokenizer has a token across the end of a word before a blank or a line feed, so every such
end is common to both lists. Distinct chunks (a word with the white space before it) are encoded and
aligned together, in long runs, and kept by hash; a text is put together from its chunks.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tapeloom.llm.common import cut, distinct, parts, ragged, release
from tapeloom.llm.near_dup import run_hashes

#: Chunks that are encoded in one run.
TOGETHER = 4096
#: Linked pairs of ids that a task holds before it hands out their counts.
PAIRS = 1 << 21
PART = 1 << 22
LOW = (1 << 32) - 1


def ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of short how many of long are smaller; both ascend. Galloping from where an even spread would place it."""
    n = len(long)
    if not n or not len(short):
        return np.zeros(len(short), np.int64)
    at = np.arange(len(short)) * n // len(short)
    right = long[at] < short
    lo, hi = np.where(right, at + 1, 0), np.where(right, n, at)
    live, step = np.arange(len(short)), 1
    while len(live):
        to_right = right[live]
        probe = at[live] + np.where(to_right, step, -step)
        live, to_right, probe = (x[(probe >= 0) & (probe < n)] for x in (live, to_right, probe))
        less = long[probe] < short[live]
        lo[live[less]], hi[live[~less]] = probe[less] + 1, probe[~less]
        live, step = live[less == to_right], step * 2
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        less = long[mid] < short[live]
        lo[live[less]], hi[live[~less]] = mid[less] + 1, mid[~less]
        live = live[lo[live] < hi[live]]
    return lo


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of the common ends in a, in b, linked places in a, in b) of two lists of ends that end alike.

    Links are in the order of both lists: each token with all those of the other list whose bytes overlap its own.
    """
    if len(ends_a) > len(ends_b):
        at_b, at_a, link_b, link_a = align(ends_b, ends_a)
        return at_a, at_b, link_a, link_b
    rank = ranks(ends_a, ends_b)
    common = ends_b[rank] == ends_a
    first = np.concatenate(([0], (rank + common)[:-1]))
    n = rank - first + 1
    return np.flatnonzero(common), rank[common], np.repeat(np.arange(len(rank)), n), ragged(first, n)


def byte_letters() -> dict[str, int]:
    """The byte of each letter in which byte-level vocabularies spell it: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers of a worker, and what it knows of the chunks it met: those used since the last turn, and before it.

    Of a chunk are kept the numbers of its tokens in A and B and of groups, the linked pairs of ids (a << 32 | b, as
    bytes) and, with texts, the groups as text; None where the tokens' bytes are not the chunk's.
    """

    def __init__(self, path_a: str, path_b: str, cached: int = 1_000_000, texts: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        self.a, self.b, self.cached, self.texts = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), cached, texts
        self.a.encode_special_tokens = True
        letters, vocab = byte_letters(), self.a.get_vocab()
        self.bytes_a: list[bytes] = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece goes across the end of a word")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: how an id is spelt before another of its list, and as the last of it
        self.names = [[np.array([f"{i}{mark}" for i in range(len(t))], object) for mark in marks] for t, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]
        self.new: dict[int, tuple | None] = {}
        self.old: dict[int, tuple | None] = {}

    def run(self, chunks: list[bytes]) -> list[tuple | None]:
        """What is kept of chunks that follow each other; each but the last ends with a letter or mark, and all begin with white space."""
        data = b" a" + b"".join(chunks)
        text = data.decode()
        ids_a, ids_b = np.array(self.a.encode(text, add_special_tokens=False).ids), np.array(self.b.encode(text[1:]))
        if any(b"".join([t[i] for i in ids.tolist()]) != data for t, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            half = len(chunks) // 2
            return [*self.run(chunks[:half]), *self.run(chunks[half:])] if half else [None]
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        at_a, at_b, link_a, link_b = align(ends_a, ends_b)
        ends = 2 + np.cumsum([0] + [len(c) for c in chunks])
        upto = np.searchsorted(ends_a[at_a], ends)
        if (ends_a[at_a[upto]] != ends).any():
            raise RuntimeError("a token goes across the end of a word")
        linked = ids_a[link_a] << 32 | ids_b[link_b]
        last_a, last_b = at_a + 1, at_b + 1
        tokens_a, tokens_b = last_a[upto], last_b[upto]
        links = np.searchsorted(link_a, tokens_a)
        g, x = upto.tolist(), links.tolist()
        n_a, n_b, n = np.diff(tokens_a).tolist(), np.diff(tokens_b).tolist(), len(chunks)
        texts = [b""] * n
        if self.texts:
            spelt = np.empty(len(ids_a) + len(ids_b), object)
            group_a, group_b = (np.repeat(np.arange(len(at_a)), np.diff(last, prepend=0)) for last in (last_a, last_b))
            place_a, place_b = np.arange(len(ids_a)) + np.concatenate(([0], last_b))[group_a], np.arange(len(ids_b)) + last_a[group_b]
            for place, ids, last, (inner, final) in ((place_a, ids_a, at_a, self.names[0]), (place_b, ids_b, at_b, self.names[1])):
                spelt[place] = inner[ids]
                spelt[place[last]] = final[ids[last]]
            ids, cuts = spelt.tolist(), (tokens_a + tokens_b).tolist()
            texts = ["".join(ids[cuts[i] : cuts[i + 1]])[:-1].encode() for i in range(n)]
        out = [(n_a[i], n_b[i], g[i + 1] - g[i], linked[x[i] : x[i + 1]].tobytes(), texts[i]) for i in range(n)]
        return out

    def known(self, keys: list[int], chunk: Callable[[int], bytes]) -> list[tuple | None]:
        """What is kept of the chunks of keys, chunk(i) being that of keys[i]."""
        found = [self.new[k] if k in self.new else self.old.get(k, 0) for k in keys]
        missing = [i for i, x in enumerate(found) if x == 0]
        alone = []
        for at in range(0, len(missing), TOGETHER):
            part = [(i, chunk(i)) for i in missing[at : at + TOGETHER]]
            alone += [x for x in part if not _ended(x[1])]
            part = [x for x in part if _ended(x[1])]
            for (i, _), value in zip(part, self.run([c for _, c in part]) if part else (), strict=True):
                found[i] = value
        for i, c in alone:
            (found[i],) = self.run([c])
        self.new.update(zip(keys, found, strict=True))
        if len(self.new) > self.cached // 2:
            self.old, self.new = self.new, {}
        return found


def _ended(chunk: bytes) -> bool:
    """Whether a blank after chunk begins a new one."""
    last, before = chunk[-1], chunk[-2:-1]
    return 0x20 < last < 0x7F or before == b"\xc3" and last not in (0x97, 0xB7)


def chunk_starts(b: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks of the bytes b start: where texts begin, and at a blank or line feed after an ASCII mark, letter or digit or a Latin-1 letter."""
    last, before = b[:-1], np.concatenate((b[:1] * 0, b[:-2]))
    ended = (last > 32) & (last < 127) | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    return np.union1d(np.flatnonzero(((b[1:] == 32) | (b[1:] == 10)) & ended) + 1, begins)


#: What a worker keeps for its next tasks, by files.
_kept: dict[tuple, Pair] = {}


class _Part:
    """Texts of a part: which rows have tokens, their chunks (at: place among the distinct ones, doc: place among those rows) and what is known of the distinct ones."""

    def __init__(self, pair: Pair, texts: list[str]):
        rows = [i for i, t in enumerate(texts) if t]
        blobs = [b" " + texts[i].encode("utf-8", "replace") for i in rows]
        data = b"".join(blobs)
        begins = np.cumsum([0] + [len(x) for x in blobs])[:-1].astype(np.int64)
        b = np.frombuffer(data, np.uint8)
        starts = chunk_starts(b, begins) if rows else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data)).astype(np.int64) if rows else starts
        keys, first, at = distinct(run_hashes(b, starts, ends))
        known = pair.known(keys.tolist(), lambda i: data[starts[first[i]] : ends[first[i]]])
        doc = np.searchsorted(begins, starts, "right") - 1
        bad = np.array([x is None for x in known], bool)
        lost = np.zeros(len(rows), bool)
        lost[doc[bad[at]]] = True
        kept = ~lost[doc]
        self.rows = [r for r, x in zip(rows, lost, strict=True) if not x]
        self.at, self.doc = at[kept], (np.cumsum(~lost) - 1)[doc[kept]]
        self.known = [x or (0, 0, 0, b"", b"") for x in known]
        self.sizes = np.array([len(x[3]) // 8 for x in self.known], np.int64)
        self.pairs = np.frombuffer(b"".join(x[3] for x in self.known), np.int64)


def _pair(paths: tuple[str, str], texts: bool) -> Pair:
    if (paths, texts) not in _kept:
        _kept.clear()  # those of the pass before are not asked for again
        _kept[paths, texts] = Pair(*paths, texts=texts)
    return _kept[paths, texts]


def link_counts(docs: DataFrame, paths: tuple[str, str], text_col: str = "text") -> DataFrame:
    """(pair, n): how many links of all texts hold the ids a and b (a << 32 | b) linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, pairs, counts = _pair(paths, False), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def summed(of: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, _, at = distinct(np.concatenate([x for x, _ in of]))
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([n for _, n in of]))
            return keys, total

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for _, texts in parts(batches, 0, PART):
            part = _Part(pair, texts)
            waiting.append((part.pairs, np.repeat(np.bincount(part.at, minlength=len(part.known)), part.sizes)))
            if sum(len(x) for x, _ in waiting) > PAIRS:
                pairs, counts = summed([(pairs, counts), *waiting])
                waiting = []
                if len(pairs) > PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                    pairs = counts = np.zeros(0, np.int64)
        if waiting:
            pairs, counts = summed([(pairs, counts), *waiting])
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pair long, n long")
    return rows.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0")


def aligned(docs: DataFrame, paths: tuple[str, str], *, common: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs.

    paths names a byte-level vocabulary (A) and a piece model (B). A blank stands before each text. Groups lie
    between the ends that tokens of both share; a link is an A and a B token whose bytes overlap. The
    count of a pair of ids is that of its links in all texts; n_best counts the links whose count no other pair of
    the B id exceeds, count_sum adds up the counts. groups_sha256 is the hash of the groups as a1,a2|b1;a3|b2.
    Nulls: a null or empty text, and one whose tokens' bytes are not its own, has zeros and an empty hash and counts
    nowhere. Rows that repeat are aligned alike and count each; further columns are not read; an empty table gives an
    empty table. Texts of any length: only the chunks of a part, one text at least, are held at a time.
    The counts of the `common` most frequent pairs are broadcast, a fixed bound; those of the others, none of which is
    frequent, meet the texts that hold them in a shuffled join.
    """
    spark = docs.sparkSession
    counts = cut(link_counts(docs, paths, text_col).withColumn("b", F.col("pair").bitwiseAND(F.lit(LOW))))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    # one row for each id of B's vocabulary is broadcast
    counts2 = cut(counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    top = counts2.orderBy(F.desc("n"), "pair").limit(common).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, (often, own, is_best) = _pair(paths, True), sent.value
        row = TaskContext.get().partitionId() << 33
        for batch, texts in parts(batches, 1, PART):
            part, n = _Part(pair, texts), len(texts)
            rows = np.array(part.rows, np.int64)
            place = np.minimum(np.searchsorted(often, part.pairs), max(0, len(often) - 1))
            hit = often[place] == part.pairs if len(often) else np.zeros(len(part.pairs), bool)
            of = np.repeat(np.arange(len(part.known)), part.sizes)
            each = np.zeros((5, len(part.known)), np.int64)
            for i in range(3):
                each[i] = [x[i] for x in part.known]
            np.add.at(each[3], of[hit], is_best[place[hit]].astype(np.int64))
            np.add.at(each[4], of[hit], own[place[hit]])
            sums = np.zeros((6, n), np.int64)
            for to, values in zip((0, 1, 2, 4, 5), each, strict=True):
                np.add.at(sums[to], rows[part.doc], values[part.at])
            np.add.at(sums[3], rows[part.doc], part.sizes[part.at])
            hashes, bounds = [""] * n, np.searchsorted(part.doc, np.arange(len(rows) + 1)).tolist()
            at = part.at.tolist()
            for i, r in enumerate(part.rows):
                hashes[r] = hashlib.sha256(b";".join([part.known[x][4] for x in at[bounds[i] : bounds[i + 1]]])).hexdigest()
            # the pairs that are not among the frequent ones, by text
            rare = np.bincount(of[~hit], minlength=len(part.known))
            others = part.pairs[~hit]
            k = rare[part.at]
            held = others[ragged((np.cumsum(rare) - rare)[part.at], k)]
            of_row = np.repeat(rows[part.doc], k)
            order = np.lexsort((held, of_row))
            held, of_row = held[order], of_row[order]
            new = np.ones(len(held), bool)
            new[1:] = (held[1:] != held[:-1]) | (of_row[1:] != of_row[:-1])
            begins = np.flatnonzero(new)
            offsets = pa.array(np.searchsorted(of_row[begins], np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (held[begins], np.diff(np.append(begins, len(held))))]
            ids = pa.array(np.arange(row, row + n), pa.int64())
            row += n
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), *(pa.array(x, pa.int64()) for x in sums), pa.array(hashes, pa.string()), *lists], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    sums = ", ".join(f"{c} long" for c in names[2:8])
    found = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"row long, doc_id {kind}, {sums}, groups_sha256 string, pairs array<long>, times array<long>"))
    sent.unpersist()
    release(counts)
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rest = rest.join(counts2, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    added = found.drop("pairs", "times").join(rest, "row", "left")
    return added.select(*names[1:6], (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
