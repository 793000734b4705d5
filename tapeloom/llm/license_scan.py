"""Fuzzy search for short licence notices.

A notice that stands in a text with at most e errors keeps one of any e + 1 pieces of it whole.
An automaton over the pieces of all notices, and over the exact phrases, finds those seeds in
the text's words; around a seed the regex library's bounded-error matching verifies the edits.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exact phrases and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that the fuzzy search looks for, in the words of their publishers.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the gnu general public license version": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: Windows that a task remembers.
KNOWN = 10_000
#: Bytes as they count: A-Z in lower case, letters, digits and all of UTF-8's other bytes kept, the rest blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def allowed(notice: str) -> int:
    """Errors that a notice may have: one for each ten characters, two at least."""
    return max(2, len(notice) // 10)


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """notice cut into errors + 1 pieces of nearly equal length, with their places."""
    n = errors + 1
    cuts = [i * len(notice) // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _in_window(text: str, pattern: regex.Pattern, least: int, known: dict) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the best match in text, then of those in the parts before and after it. known: what was found in windows of the same text."""
    key = (pattern, text)
    if key not in known:
        if len(known) > KNOWN:
            known.clear()
        out, open_ = [], [(0, len(text))]
        while open_:
            lo, hi = open_.pop()
            m = pattern.search(text, lo, hi)
            if m and m[0]:
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                open_ += [part for part in ((lo, m.start()), (m.end(), hi)) if part[1] - part[0] >= least]
        known[key] = out
    return known[key]


class Scanner:
    """Built once per task."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        seeds: dict[str, list] = {}
        for phrase in phrases:
            seeds.setdefault(f" {phrase} ", []).append(("exact", phrase, 0, 0))
        self.patterns = {}
        for notice in notices:
            errors = allowed(notice)
            self.patterns[notice] = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={errors}}}")
            for at, piece in pieces(notice, errors):
                seeds.setdefault(piece, []).append(("seed", notice, at, errors))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()
        self.phrases, self.notices = phrases, notices
        self.known: dict[tuple[regex.Pattern, str], list[tuple[int, int, int]]] = {}

    def scan(self, text: str) -> dict:
        words = text.encode("utf-8", "replace").translate(FOLD).split()
        line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
        exact: list[tuple[int, str]] = []
        seen: dict[tuple[str, int], int] = {}
        for last, (size, uses) in self.automaton.iter(line):
            start = last - size + 1
            for kind, phrase, at, errors in uses:
                if kind == "exact":
                    exact.append((start + 1, phrase))
                else:
                    lo, hi = max(0, start - at - errors), start - at + len(phrase) + errors
                    seen[phrase, lo] = max(hi, seen.get((phrase, lo), 0))
        matches: list[tuple[int, int, str, int, int]] = []
        windows: dict[str, list[tuple[int, int]]] = {}
        for (notice, lo), hi in sorted(seen.items(), key=lambda x: x[0][1]):
            # seeds of one place, which stands shifted by the errors at most, share a window; it never grows beyond that
            own = windows.setdefault(notice, [])
            if own and lo <= own[-1][0] + 2 * allowed(notice):
                own[-1] = (own[-1][0], max(hi, own[-1][1]))
            else:
                own.append((lo, hi))
        for notice, spans in windows.items():
            pattern, least, found = self.patterns[notice], len(notice) - allowed(notice), {}
            for lo, hi in spans:
                for start, end, edits in _in_window(line[max(0, lo) : hi], pattern, least, self.known):
                    found[lo + start, lo + end] = edits
            matches += [(start, end, notice, edits, len(notice)) for (start, end), edits in found.items()]
        blanks = [m.start() for m in re.finditer(" ", line)] if exact or matches else []
        n_before = lambda i: bisect_right(blanks, i) - 1  # noqa: E731  the word that stands at i
        places = sorted(n_before(i) for i, _ in exact)
        base = {self.phrases[p] for _, p in exact}
        out = []
        if matches:
            chars = [m.span() for m in WORD.finditer(text)]
            best: list[tuple[int, int, str, int, int]] = []
            for m in sorted(matches, key=lambda m: (m[3] / m[4], m[0], m[2])):  # of notices that overlap, the nearest
                i = bisect_left(best, m)  # best stays sorted and free of overlaps, so its neighbours alone can overlap m
                if (i == 0 or best[i - 1][1] <= m[0]) and (i == len(best) or m[1] <= best[i][0]):
                    best.insert(i, m)
            for start, end, notice, edits, size in best:
                # edges of a match can fall on blanks beside its words
                first, last = n_before(start + (line[start] == " ")), n_before(end - 1 - (line[end - 1] == " "))
                first, last = min(first, len(words) - 1), min(max(first, last), len(words) - 1)
                out.append({"label": self.notices[notice], "first_word": first, "last_word": last, "start": chars[first][0], "end": chars[last][1], "edits": edits, "score": 1 - edits / size})
        return {
            "n_words": len(words), "n_base": len(places), "first_word": places[0] if places else None, "last_word": places[-1] if places else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {m["label"] for m in out})),
            "score": 1.0 if base else max((m["score"] for m in out), default=0.0), "matches": out,
        }


MATCH = [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())]
TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": pa.list_(pa.struct(MATCH))}


def license_scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of TYPES for every row; matches has the notices' spans in words and code points.

    Base columns count exact phrases at whole words, overlapping ones too. score is 1 with an exact
    phrase, else the best match's share of unedited characters, else 0. Nulls: a null text is
    empty and has no words. Repeated rows are scanned alike; further columns are not read; an empty table gives an empty one. A long
    text costs one bounded search for each place where a piece of a notice stands, so time grows with its length alone.
    Phrases are lower-case words divided by one blank.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            rows = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in TYPES.items())], names=["doc_id", *TYPES])

    kind = docs.schema[id_col].dataType.simpleString()
    match = ",".join(f"{n}:{'string' if t == pa.string() else 'double' if t == pa.float64() else 'long'}" for n, t in MATCH)
    shape = ", ".join(f"{n} {'string' if t == pa.string() else 'double' if t == pa.float64() else 'long' if t == pa.int64() else f'array<struct<{match}>>'}" for n, t in TYPES.items())
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {shape}")
