"""Packing of tokenised documents into windows by the sum-of-squares rule.

A document goes to the fill level whose choice leaves the least sum of squared counts of partially
filled windows; a level array holds those counts. Longer documents are first cut into full windows
and a rest. Every partition is packed on its own, online, with a bounded number of open windows:
beyond it the fullest is filled up with the head of the document at hand. Windows still open at the
end fill each other up, and the last one is cut where powers of two need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm.common import parts
from tapeloom.llm.near_dup import FOLD, word_hashes

END = 2
#: Between words that are encoded together; a word with this character is encoded alone.
BETWEEN = "\x02"
TOGETHER = 256
Encode = Callable[[list[str]], Iterator[np.ndarray]]


class _Words:
    """A worker's tokenizer and the ids of the words it met, by hash: those used since the last turn, and before it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.between,) = self.ids(BETWEEN)
        self.new: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def known(self, keys: list[int], word: Callable[[int], str], cached: int) -> list[bytes]:
        """The ids of the words of keys, word(i) being that of keys[i]; about cached words are kept."""
        found = [self.new.get(k) or self.old.get(k) for k in keys]
        missing = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(missing), TOGETHER):
            part = missing[at : at + TOGETHER]
            words = [word(i) for i in part]
            alone = [BETWEEN in w for w in words]
            joined = f" {BETWEEN} ".join(w for w, x in zip(words, alone, strict=True) if not x)
            ids = np.array(self.ids(joined), "<u4")
            cuts = np.split(ids, np.flatnonzero(ids == self.between))
            runs = iter([cuts[0], *(x[1:] for x in cuts[1:])])
            for i, w, x in zip(part, words, alone, strict=True):
                found[i] = (np.array(self.ids(w), "<u4") if x else next(runs)).tobytes()
        self.new.update(zip(keys, found, strict=True))
        if len(self.new) > cached // 2:
            self.old, self.new = self.new, {}
        return found


#: What a worker keeps for its next tasks, by file.
_kept: dict[str, _Words] = {}


def _spaced(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """b with a blank before every comma and full stop that ends a word behind a letter or digit, and where those marks are in b.

    Letters and digits are those of ASCII and Latin-1 alone: none of them joins a mark, in whatever case.
    """
    at = np.flatnonzero((b == 44) | (b == 46))
    at = at[(at > 1) & (np.append(b, 32)[at + 1] == 32)]
    last, before = b[at - 1], b[at - 2]
    simple = (last >= 97) & (last <= 122) | (last >= 48) & (last <= 57)
    latin = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    at = at[simple | latin]
    return np.insert(b, at, 32), at


def word_encoder(path: str, *, cached: int = 1_000_000) -> Encode:
    """Encodes whole texts with a tokenizer that drops white space, takes A-Z as a-z and never joins words.

    As its ids of a text are those of its blank-separated words one after the other, each distinct
    word, told by its 64-bit hash, is encoded once and kept, about cached words at most. It ends a token
    where a mark follows a letter or digit, so a comma or full stop there counts as a word of its own.
    A text that holds one of the tokenizer's added tokens is encoded whole.
    """
    if path not in _kept:
        _kept[path] = _Words(path)
    words = _kept[path]

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        whole = [any(a in t for a in words.added) for t in texts]
        blobs = [b"" if w else t.encode("utf-8", "replace").translate(FOLD) for t, w in zip(texts, whole, strict=True)]
        spaced, marks = _spaced(np.frombuffer(b" ".join(blobs), np.uint8))
        data = spaced.tobytes()
        hashes, starts = word_hashes(data)
        keys, first, at = np.unique(hashes, return_index=True, return_inverse=True)

        def word(i: int) -> str:
            begin = int(starts[first[i]])
            end = data.find(b" ", begin)
            return data[begin : end if end >= 0 else len(data)].decode("utf-8", "replace")

        found = words.known(keys.tolist(), word, cached)
        pool, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        n = sizes[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[at] - upto[:-1], n) + np.arange(upto[-1])]
        begins = np.cumsum([0] + [len(x) + 1 for x in blobs])
        bounds = upto[np.searchsorted(starts, begins + np.searchsorted(marks, begins))]
        for i, text in enumerate(texts):
            yield np.array(words.ids(text), "<u4") if whole[i] else ids[bounds[i] : bounds[i + 1]]

    return encode


class SumOfSquares:
    """Pieces are (doc, start, ids, doc_tokens); closed windows are handed out as lists of pieces."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.most = window, open_windows
        #: windows by fill level, and how many there are
        self.level: list[list[list]] = [[] for _ in range(window)]
        self.count = np.zeros(window + 1, np.int64)
        self.open = 0

    def place(self, doc, ids: np.ndarray, total: int) -> Iterator[list]:
        start = 0
        while len(ids) - start >= self.window:
            yield [(doc, start, ids[start : start + self.window], total)]
            start += self.window
        if start == len(ids):
            return
        level = self._best(len(ids) - start, self.open < self.most)
        if level < 0:  # no open window has the room: the head of the document fills up the fullest
            fullest = int(np.flatnonzero(self.count[: self.window])[-1])
            gap = self.window - fullest
            yield [*self._take(fullest), (doc, start, ids[start : start + gap], total)]
            start += gap
            level = self._best(len(ids) - start, True)
        rest = ids[start:].copy()
        pieces = [*(self._take(level) if level else []), (doc, start, rest, total)]
        if level + len(rest) == self.window:
            yield pieces
        else:
            self._put(level + len(rest), pieces)

    def _best(self, size: int, new: bool) -> int:
        """The level for a piece: of those with a window, and level 0 if new, the one of least cost, the fullest at ties; -1 if none has room."""
        fits = self.window - size
        # squares change by 2 N(level + size) + 1 where the window comes and by 1 - 2 N(level) where it leaves
        cost = 2 * self.count[size : self.window + 1] + 1
        cost[-1] = 0  # a full window counts no more
        cost[1:] += 1 - 2 * self.count[1 : fits + 1]
        never = np.iinfo(np.int64).max
        cost[1:][self.count[1 : fits + 1] == 0] = never
        if not new:
            cost[0] = never
        level = fits - int(np.argmin(cost[::-1]))
        return level if cost[level] < never else -1

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.level[level].pop()

    def _put(self, level: int, pieces: list) -> None:
        self.count[level] += 1
        self.open += 1
        self.level[level].append(pieces)

    def close(self) -> Iterator[list]:
        """The open windows: the emptiest fill up the fullest, and the last is cut at powers of two."""
        left = [w for level in self.level for w in level]
        first, last = 0, len(left) - 1
        spare: list = []
        while first <= last:
            pieces = left[last]
            last -= 1
            gap = self.window - sum(len(p[2]) for p in pieces)
            while gap and (spare or first <= last):
                if not spare:
                    spare, first = left[first][::-1], first + 1
                doc, start, ids, total = spare.pop()
                pieces.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    spare.append((doc, start + gap, ids[gap:], total))
                gap -= min(gap, len(ids))
            if gap == 0:
                yield pieces
            else:
                spare = pieces[::-1]
        size = sum(len(p[2]) for p in spare)
        while spare:
            room = min(1 << (size.bit_length() - 1), self.window)
            size -= room
            pieces = []
            while room:
                doc, start, ids, total = spare.pop()
                pieces.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield pieces


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, make_encoder: Callable[[], Encode], *, window: int = 4096, open_windows: int = 1024, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COLUMNS, a row for each piece: which ids of a document stand where in which sequence.

    A document is its text's ids and end_id; every id lies in one piece. Sequences have window ids
    or a power of two of them, so none is padded. sequence_id holds the partition in its upper bits.
    Nulls: a null or empty text is its end_id alone; a null id is kept. Rows that repeat an id are
    documents of their own. Further columns are not read. An empty table gives an empty table.
    A task holds open_windows windows at most, besides the rows at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = make_encoder(), SumOfSquares(window, open_windows)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def note(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", *(c.split(" ")[0] for c in COLUMNS.split(", "))])

        kind = None
        for batch, texts in parts(batches, 1, 1 << 21):
            kind = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                whole = np.append(ids, np.uint32(end_id))
                for pieces in packer.place(doc, whole, len(whole)):
                    note(pieces)
            if rows:
                yield flush()
        for pieces in packer.close():
            note(pieces)
        if rows:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")
