"""Exact top-k by BM25 over an inverted index that each task makes of its own rows.

A shard is a run of rows; its index stays in the task's memory. Impacts use the statistics of all
rows, so shards' results merge exactly. A set of queries at a time is broadcast and meets every
shard where it is, so postings are neither shuffled nor written.

Rows are searched in rounds of growing size, each with the k-th best scores of the rounds before as
thresholds: a shard hands out only what reaches them, a few times k rows for a query and round
however many shards there are. Queries of few words are pruned by block-max WAND. Those of whole texts
and the rows of a shard are laid in tiles and groups of like vocabulary and length. Of a tile and a
group words that are common in both are multiplied as matrices, the others' lists are added, all in
single precision; what could reach the threshold, the error taken off, gets its exact score. Queries
that can't reach it by the best score of each word in the group are left out of that group.

Impacts are whole numbers (2**-24 each), so sums don't depend on their order and ties are ties.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import cut, parts, ragged, slices
from tapeloom.llm.license_scan import FOLD
from tapeloom.llm.near_dup import word_hashes

BLOCK = 128
#: queries of a tile and rows of a group, at most
TILE, GROUP = 1 << 10, 1 << 11
#: of a tile and a group the share of pairs that hold a word in both, from which on it is multiplied as a column
DENSE = 0.004
#: kinds of vocabulary, told apart by the words that most queries hold; they only order the work
KINDS, COMMON = 8, 128
#: a round has this many times the rows of all rounds before and one more
GROWTH = 4
#: characters in a shard, and of it in what is cut into words at once
SHARD, PIECE = 1 << 25, 1 << 20
SCALE = 1 << 24
#: postings that are added at once
ADDED = 1 << 16
K1, B = 1.2, 0.75
NEVER = (1 << 63) - 1


def terms_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters, digits and all that is not ASCII, with A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def _statistics(docs: DataFrame) -> tuple[int, int]:
    """The numbers of rows and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).fill_null("").to_pylist()
            for part in slices(texts, SHARD):
                blank = np.frombuffer(b" ".join([b"", *(t.encode("utf-8", "replace").translate(FOLD) for t in texts[part])]), np.uint8) == 32
                yield pa.RecordBatch.from_arrays([pa.array([part.stop - part.start], pa.int64()), pa.array([np.count_nonzero(blank[:-1] > blank[1:])], pa.int64())], names=["n", "words"])

    n, words = docs.select("text").mapInArrow(run, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    return n or 0, words or 0


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, the place among them of each word in turn, and the number of words of each text."""
    folded = [t.encode("utf-8", "replace").translate(FOLD) for t in texts]
    terms, at = word_hashes(b" ".join(folded))
    lengths = np.diff(np.searchsorted(at, np.cumsum([len(t) + 1 for t in folded])), prepend=0)
    coded = pa.array(terms.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy(), lengths


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values of x start, and their sizes."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(x)))


def _postings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, rows, counts, lengths) of the words of texts, by term and then row; a row is a place in texts."""
    terms, code, lengths = _tokens(texts)
    order = np.argsort(terms)
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    key = place[code] << 32 | np.repeat(np.arange(len(texts)), lengths)
    key.sort()
    starts, counts = _runs(key)
    rows = (key[starts] & 0xFFFFFFFF).astype(np.int32)
    return terms[order][key[starts] >> 32], rows, counts, lengths[rows]


def _held(docs: DataFrame) -> DataFrame:
    """(term, df) of all words of docs(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for part in slices(texts, SHARD):
                terms = _postings(texts[part])[0]
                starts, n = _runs(terms)
                yield pa.RecordBatch.from_arrays([pa.array(terms[starts]), pa.array(n)], names=["term", "df"])

    return docs.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def impact(count, length, mean: float):
    """BM25's weight of a word for a row, before rarity; numbers or arrays."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / (mean or 1)))


class Postings:
    """A term's blocks in one shard, in the order of documents."""

    def __init__(self, blocks: list[tuple[list[int], list[int], list[int], float]], idf: float, mean: float):
        self.docs = [d for b in blocks for d in b[0]]
        self.scores = [round(impact(c, n, mean) * idf * SCALE) for b in blocks for c, n in zip(b[1], b[2], strict=True)]
        self.last = [b[0][-1] for b in blocks]
        self.tops = [round(b[3] * idf * SCALE) for b in blocks]
        self.top = max(self.tops)


def top_k(lists: list[Postings], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best, the smaller documents at ties; block-max WAND.

    A document that comes later loses a tie, so everything that can't exceed the k-th score is skipped.
    """
    heap: list[tuple[int, int]] = []
    least = 0
    live = [[x.docs[0], x, 0] for x in lists]  # where a list stands
    while live:
        live.sort(key=lambda c: c[0])
        bound, pivot = 0, -1
        for i, c in enumerate(live):
            bound += c[1].top
            if bound > least:
                pivot = i
                break
        if pivot < 0:
            break
        doc = live[pivot][0]
        while pivot + 1 < len(live) and live[pivot + 1][0] == doc:
            pivot += 1
        bound, end = 0, NEVER
        for c in live[: pivot + 1]:
            b = bisect_left(c[1].last, doc)
            if b < len(c[1].last):
                bound += c[1].tops[b]
                end = min(end, c[1].last[b])
        if bound <= least:  # nothing up to the nearest end of a block, or the next list, can do
            target = end + 1
            if pivot + 1 < len(live):
                target = min(target, live[pivot + 1][0])
            moved = live[: pivot + 1]
        elif live[0][0] == doc:
            score = sum(c[1].scores[c[2]] for c in live[: pivot + 1])
            if score > least or len(heap) < k:
                if len(heap) < k:
                    heappush(heap, (score, -doc))
                else:
                    heapreplace(heap, (score, -doc))
                if len(heap) == k:
                    least = heap[0][0]
            target, moved = doc + 1, live[: pivot + 1]
        else:
            target, moved = doc, [c for c in live[:pivot] if c[0] < doc]
        for c in moved:
            at = bisect_left(c[1].docs, target, c[2])
            c[0], c[2] = (c[1].docs[at], at) if at < len(c[1].docs) else (NEVER, at)
        live = [c for c in live if c[0] != NEVER]
    return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))


def key_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n) of all words of queries(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).fill_null("").to_pylist()
            for part in slices(texts, SHARD):
                terms, rows, counts, _ = _postings(texts[part])
                yield pa.RecordBatch.from_arrays([pa.array(ids[part][rows], pa.int64()), pa.array(terms), pa.array(counts, pa.int64())], names=["query_id", "term", "n"])

    return queries.mapInArrow(run, "query_id long, term long, n long")


class Queries:
    """Queries(query_id, term, idf, n) as arrays: by query, and their distinct words in the order of terms."""

    def __init__(self, rows: pa.Table):
        query, term, idf, n = (rows.column(c).to_numpy() for c in ("query_id", "term", "idf", "n"))
        by = np.lexsort((term, query))
        self.ids, starts = np.unique(query[by], return_index=True)
        self.bounds = np.append(starts, len(query))
        self.terms, first, at = np.unique(term, return_index=True, return_inverse=True)
        self.idf, self.at, self.n = idf[first], at[by].astype(np.int32), n[by].astype(np.int32)

    @cached_property
    def kinds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The column of each common word (else -1), the middle of each kind, and the kind of each query."""
        common = np.argsort(-np.bincount(self.at, minlength=len(self.terms)), kind="stable")[:COMMON]
        column = np.full(len(self.terms), -1, np.int32)
        column[common] = np.arange(len(common))
        held = np.empty((len(self.ids), COMMON), np.float32)
        for i in range(0, len(self.ids), TILE):
            ends = self.bounds[i : i + TILE + 1]
            own = column[self.at[ends[0] : ends[-1]]]
            held[i : i + TILE] = _held_common(len(ends) - 1, np.repeat(np.arange(len(ends) - 1), np.diff(ends))[own >= 0], own[own >= 0])
        middle = held[:1]
        while len(middle) < KINDS:
            middle = np.concatenate((middle, held[[np.argmin((held @ middle.T).max(1))]]))
        for _ in range(8):
            kind = (held @ middle.T).argmax(1)
            for i in np.unique(kind):
                total = held[kind == i].sum(0)
                middle[i] = total / (np.linalg.norm(total) or 1)
        return column, middle.T.copy(), (held @ middle.T).argmax(1)

    @cached_property
    def tiles(self) -> list[tuple[np.ndarray, ...]]:
        """Of each tile its queries, their distinct words and in how many each is; then of each word of each query its place among those, the query's and its count."""
        sizes, kind, out = np.diff(self.bounds), self.kinds[2], []
        order = np.lexsort((sizes, kind))
        for part in _stretches(kind[order], TILE):
            who = order[part]
            own = ragged(self.bounds[who], sizes[who])
            words, at, n = np.unique(self.at[own], return_inverse=True, return_counts=True)
            out.append((who, words, n, at.astype(np.int32), np.repeat(np.arange(len(who), dtype=np.int16), sizes[who]), self.n[own].astype(np.float32)))
        return out


def _held_common(n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each of n rows a vector of length 1 (or 0) by the common words that it holds."""
    out = np.zeros((n, COMMON), np.float32)
    out[rows, columns] = 1
    out -= out.mean(1, keepdims=True)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def _stretches(x: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of equal values of x, of most at most each."""
    for start, size in zip(*(a.tolist() for a in _runs(x)), strict=True):
        n = -(-size // most)
        for i in range(n):
            yield slice(start + size * i // n, start + size * (i + 1) // n)


def _best(q: Queries, texts: list[str], mean: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, row of texts, score) of the k best of texts for each query of few words, the smaller rows at ties; block-max WAND."""
    terms, rows, counts, lengths = _postings(texts)
    place, rows, counts, lengths = _asked(q, terms, rows, counts, lengths)
    size = np.bincount(place, minlength=len(q.terms))
    start = np.cumsum(size) - size
    impacts = impact(counts, lengths, mean)
    out = [(np.zeros(0, np.int64),) * 3]
    made: dict[int, Postings] = {}
    for i in range(len(q.ids)):
        own = [t for t in q.at[q.bounds[i] : q.bounds[i + 1]].tolist() if size[t]]
        for t in own:
            if t not in made:
                cuts = [slice(a, min(a + BLOCK, start[t] + size[t])) for a in range(start[t], start[t] + size[t], BLOCK)]
                made[t] = Postings([(rows[c].tolist(), counts[c].tolist(), lengths[c].tolist(), float(impacts[c].max())) for c in cuts], float(q.idf[t]), mean)
        found = np.array(top_k([made[t] for t in own], k), np.int64).reshape(-1, 2)
        out.append((np.full(len(found), i), found[:, 1], found[:, 0]))
    return tuple(np.concatenate([x[c] for x in out]) for c in range(3))


def _asked(q: Queries, terms: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Of postings the places in q.terms and the columns, for the terms that q asks for."""
    place = np.minimum(np.searchsorted(q.terms, terms), len(q.terms) - 1)
    asked = q.terms[place] == terms
    return [place[asked], *(c[asked] for c in columns)]


def _add(sums: np.ndarray, to: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None, rows: np.ndarray, scores: np.ndarray) -> None:
    """Add each run of postings, times its weight, to sums from its place on."""
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + ADDED, ADDED)).tolist()
    for part in map(slice, cuts[:-1], cuts[1:]):
        if part.stop > part.start:
            n = sizes[part]
            own = ragged(starts[part], n)
            place = np.repeat(to[part], n)
            place += rows[own]
            more = scores[own]
            if weights is not None:
                more *= np.repeat(weights[part], n)
            np.add.at(sums, place, more)


class _Group:
    """Rows of a shard of like vocabulary and length, and their postings by word and then row."""

    def __init__(self, rows: np.ndarray, places: np.ndarray, own: np.ndarray, scores: np.ndarray):
        self.rows, self.places, self.own, self.exact = rows, places, own.astype(np.int32), scores
        self.scores = scores.astype(np.float32)
        self.starts, self.sizes = _runs(places)
        self.tops = np.maximum.reduceat(self.scores, self.starts)
        self.words = places[self.starts]
        self.by_row = np.sort(own << 32 | np.arange(len(own))) & 0xFFFFFFFF
        self.of_row = np.searchsorted(own[self.by_row], np.arange(len(rows) + 1))

    def sums(self, tile: tuple[np.ndarray, ...], at: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the tile, about the scores of the rows) of those queries of a tile that can reach their bound. at: the place of each word of the queries among the group's, or -1."""
        who, words, n, word, query, weight = tile
        at = at[words]
        here = at >= 0
        may = np.bincount(query, weight * np.where(here, self.tops[at], 0)[word], len(who)) >= bound
        who = np.flatnonzero(may)
        if len(who) < len(may):
            own = np.flatnonzero(may[query])
            word, query, weight = word[own], (np.cumsum(may) - 1)[query[own]], weight[own]
            n = np.bincount(word, minlength=len(words))
        size = np.where(here, self.sizes[at], 0)
        many = n * size >= max(1, DENSE * len(who) * len(self.rows))
        column = np.full(len(words), -1, np.int32)
        column[many] = np.arange(np.count_nonzero(many))
        right = np.zeros((np.count_nonzero(many), len(self.rows)), np.float32)
        own = ragged(self.starts[at[many]], size[many])
        right[np.repeat(np.arange(len(right)), size[many]), self.own[own]] = self.scores[own]
        left = np.zeros((len(who), len(right)), np.float32)
        own = np.flatnonzero(column[word] >= 0)
        left[query[own], column[word[own]]] = weight[own]
        sums = left @ right
        size[many] = 0
        size, start = size[word], self.starts[at][word]
        for one in (True, False):  # most words stand in a query once
            run = np.flatnonzero((size > 0) & ((weight == 1) == one))
            _add(sums.reshape(-1), query[run].astype(np.int64) * len(self.rows), start[run], size[run], None if one else weight[run], self.own, self.scores)
        return who, sums

    def scored(self, q: Queries, queries: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The exact scores of pairs of a query and a row, which come by row. weight: a zero for each word of the queries, as which it is left."""
        out = np.empty(len(rows), np.int64)
        for start, n in zip(*(a.tolist() for a in _runs(rows)), strict=True):
            own = self.by_row[self.of_row[rows[start]] : self.of_row[rows[start] + 1]]
            weight[self.places[own]] = self.exact[own]
            asked = queries[start : start + n]
            sizes = q.bounds[asked + 1] - q.bounds[asked]
            at = ragged(q.bounds[asked], sizes)
            out[start : start + n] = np.add.reduceat(weight[q.at[at]] * q.n[at], np.cumsum(sizes) - sizes)
            weight[self.places[own]] = 0
        return out


class _Shard:
    """Rows of which only the words that q asks for are kept, until they make groups."""

    def __init__(self, q: Queries):
        self.q, self.size, self.parts = q, 0, []

    def add(self, ids: np.ndarray, texts: list[str]) -> None:
        terms, code, lengths = _tokens(texts)
        place = np.minimum(np.searchsorted(self.q.terms, terms), len(self.q.terms) - 1).astype(np.int32)
        asked = (self.q.terms[place] == terms)[code]
        rows = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        self.parts.append((ids, lengths, place[code[asked]], rows[asked]))
        self.size += sum(map(len, texts))

    def groups(self, mean: float) -> Iterator[_Group]:
        """The groups of its rows, numbered as they came."""
        self.ids, lengths = (np.concatenate([x[c] for x in self.parts]) for c in (0, 1))
        column, middle, _ = self.q.kinds
        kind = []
        for _, own, place, row in self.parts:
            common = column[place]
            kind.append((_held_common(len(own), row[common >= 0], common[common >= 0]) @ middle).argmax(1))
        kind = np.concatenate(kind)
        order = np.lexsort((-lengths, kind))
        stretches = list(_stretches(kind[order], GROUP))
        to = np.empty(len(lengths), np.int64)
        bits, bits_own = len(self.q.terms).bit_length(), GROUP.bit_length()
        for i, part in enumerate(stretches):
            to[order[part]] = i << (bits + bits_own) | np.arange(part.stop - part.start)
        key, at, first = np.empty(sum(len(x[2]) for x in self.parts), np.int64), 0, 0
        for i, (ids, _, place, row) in enumerate(self.parts):
            key[at : at + len(row)] = to[first : first + len(ids)][row] | place.astype(np.int64) << bits_own
            at, first, self.parts[i] = at + len(row), first + len(ids), ()
        self.parts = []
        key.sort()
        starts, counts = _runs(key)
        key, counts = key[starts], counts.astype(np.int32)
        del starts
        cuts = np.searchsorted(key, np.arange(len(stretches) + 1) << (bits + bits_own)).tolist()
        for part, a, b in zip(stretches, cuts[:-1], cuts[1:], strict=True):
            rows, place, own = order[part], key[a:b] >> bits_own & ((1 << bits) - 1), key[a:b] & ((1 << bits_own) - 1)
            if b > a:
                yield _Group(rows, place, own, np.rint(impact(counts[a:b], lengths[rows][own], mean) * self.q.idf[place] * SCALE).astype(np.int64))


def _shards(q: Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    """Shards of batches(id, text), of about SHARD characters each whatever the size of a batch."""
    shard = _Shard(q)
    for part, texts in parts(batches, 1, min(SHARD, PIECE)):
        shard.add(part.column(0).to_numpy(), texts)
        if shard.size >= SHARD:
            yield shard
            shard = _Shard(q)
    if shard.parts:
        yield shard


def _best_whole(shard: _Shard, mean: float, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of those of the k best rows of a shard, the smaller ids at ties, that score least[query] or more; some others with them.

    Raises least where a k-th score is higher.
    """
    q = shard.q
    # a sum in single precision is off by a 2**-24th for each word of the query at most, as scores aren't negative; twice that is taken off
    exact = 1 - (np.diff(q.bounds) + 8) * 2.0**-23
    at, weight = np.full(len(q.terms), -1, np.int32), np.zeros(len(q.terms), np.int64)
    out = [(np.zeros(0, np.int64),) * 3]
    for group in shard.groups(mean):
        at[group.words] = np.arange(len(group.words))
        for tile in q.tiles:
            who = tile[0]
            bound = (np.maximum(least[who], 1) * exact[who]).astype(np.float32) * np.float32(1 - 2**-22)
            may, sums = group.sums(tile, at, bound)
            who, bound = who[may], bound[may]
            one, row = np.divmod(np.flatnonzero(sums >= bound[:, None]), len(group.rows))
            many = np.bincount(one, minlength=len(who)) > 4 * k
            for i in np.flatnonzero(many).tolist():  # only what could be among the k best here
                bound[i] = max(bound[i], np.partition(sums[i], -k)[-k] * np.float32(exact[who[i]] ** 2 * (1 - 2**-22)))
            if many.any():
                high = sums[one, row] >= bound[one]
                one, row = one[high], row[high]
            by = np.argsort(row, kind="stable")
            query, row = who[one[by]], row[by]
            score, own = group.scored(q, query, row, weight), shard.ids[group.rows[row]]
            by = np.lexsort((own, -score, query))
            query, own, score = query[by], own[by], score[by]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            full = nth == k - 1
            least[query[full]] = np.maximum(least[query[full]], score[full])
            keep = (nth < k) & (score >= np.maximum(least[query], 1))
            out.append((query[keep], own[keep], score[keep]))
        at[group.words] = -1
    return tuple(np.concatenate([x[c] for x in out]) for c in range(3))


def _top(found: DataFrame, k: int) -> DataFrame:
    """found(query_id, doc_id, score) with its place as rank, as far as the k-th."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, n_terms: int | None = None, queries_per_task: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, rank, score: for every row of queries the k best rows of docs by BM25.

    With n_terms None a query is all words of its text, each as often as it stands there. Else it is
    the n_terms words of its whole text that weigh most by count and rarity (ties: the smaller term
    hash), each once. The search is exact in either case. Ties in score go to the smaller id. A query
    none of whose words is in docs has no result. Nulls: a row with a null id is neither query nor
    indexed, and counts in no statistics; a null text has no words. Rows of docs that repeat an id are
    rows of their own; queries that repeat an id are one query of the words of all. Further columns
    are not read. Ids are whole numbers. queries_per_task queries, about, are searched at a time.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total, words = _statistics(rows)
    mean, context = words / max(1, total), rows.sparkSession.sparkContext
    of_queries = key_terms(asked).groupBy("query_id", "term").agg(F.sum("n").alias("n"))
    idf = F.log1p((F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    chosen = of_queries.join(_held(rows), "term").withColumn("idf", idf)
    if n_terms is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc(F.col("n") * F.col("idf")), "term")
        chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_terms).withColumn("n", F.lit(1).cast("long"))
    chosen = cut(chosen.select("query_id", "term", "idf", "n"))
    sets = max(1, -(-chosen.select("query_id").distinct().count() // queries_per_task))
    # about eight bytes a word make shards; the rounds before the last hold a quarter of the rows, a sixteenth and so on
    shards = max(1, words * 8 // SHARD)
    rounds = 1 if n_terms is not None else 1 + math.ceil(math.log(shards, GROWTH))
    bucket = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(GROWTH ** (rounds - 1)))

    def best(sent, least, part: DataFrame) -> DataFrame:
        def named(query: np.ndarray, docs: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sent.value.ids[query]), pa.array(docs), pa.array(score)], names=["query_id", "doc_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bound = least.value.copy()
            if n_terms is None and len(sent.value.ids):
                for shard in _shards(sent.value, batches):
                    yield named(*_best_whole(shard, mean, k, bound))
                return
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(), batch.column(1).fill_null("").to_pylist()
                for own in slices(texts, SHARD) if len(sent.value.ids) else ():
                    by = np.argsort(ids[own], kind="stable")
                    query, row, score = _best(sent.value, [texts[own.start + i] for i in by], mean, k)
                    yield named(query, ids[own][by][row], score)

        return part.mapInArrow(run, "query_id long, doc_id long, score long")

    def of_set(number: int) -> DataFrame:
        own = Queries(chosen.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == number).toArrow())
        sent, least, found = context.broadcast(own), np.zeros(len(own.ids), np.int64), None
        for i in range(rounds):
            ahead, beyond = GROWTH ** (rounds - 1 - i), GROWTH ** (rounds - i)
            part = rows if rounds == 1 else rows.where((bucket % ahead == 0) & ((bucket % beyond != 0) if i else F.lit(True)))
            if i < rounds - 1:  # few rows of every file make few shards
                part = part.repartition(max(1, GROWTH**i))
            more = best(sent, context.broadcast(least), part)
            found = more if found is None else found.unionByName(more)
            if i < rounds - 1:
                found = cut(_top(found, k).drop("rank"))
                reached = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).toArrow()
                least = least.copy()
                least[np.searchsorted(own.ids, reached.column("query_id").to_numpy())] = reached.column("least").to_numpy()
        return found

    found = of_set(0)
    for number in range(1, sets):
        found = found.unionByName(of_set(number))
    return _top(found, k).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), (F.col("score") / SCALE).alias("score"))
