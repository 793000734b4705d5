"""Masking of personal data at three levels, in ordered passes, with every hit.

Each pass reads the text as the passes before left it, and a hit's offsets (code points) are
those in that text; orig_start and orig_end are those in the text given.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tapeloom.functions.dialect import DIGIT, literal, pythonic, spelt

LEVELS = ("light", "standard", "heavy")

#: Kinds of streets and months, as they are written in full and short.
STREETS = "St|Street|Rd|Road|Ave|Avenue|Blvd|Boulevard|Ln|Lane|Dr|Drive|Ct|Court|Cir|Circle|Pl|Place|Way|Pkwy|Parkway"
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: Label, least level and pattern of the passes with a pattern of their own, in order. A look at the first
#: character goes before that at what precedes it, so that most places of a text fail at once.
FIXED = [
    ("EMAIL", 0, "(?iu)<B>[A-Z<x>0-9._%+-]+@[A-Z<x>0-9.-]+\\.[A-Z<x>]{2,}<B>"),
    ("PHONE", 0, "(?=[+(]|<D>)(?<!<W>)(?:\\+?1[<s>.-]?)?(?:\\(<S>*<D>{3}<S>*\\)|<D>{3})[<s>.-]?<D>{3}[<s>.-]?<D>{4}(?!<W>)"),
    ("SSN", 0, "(?=<D>)(?<!<W>)<D>{3}-<D>{2}-<D>{4}(?!<W>)"),
    ("CARD", 0, "(?=<D>)(?<!<W>)(?:<D>[ -]*?){13,19}<B>"),
    ("ADDRESS", 0, f"(?iu)(?=<D>)(?<!<W>)<D>{{1,6}}<S>+[A-Za-z<x>0-9.'-]+(?:<S>+[A-Za-z<x>0-9.'-]+){{0,4}}<S>+(?:{STREETS})\\.?<B>"),
    ("ZIP", 1, "(?=<D>)(?<!<W>)<D>{5}(?:-<D>{4})?(?!<W>)"),
    ("DATE", 1, "(?=<D>)(?<!<W>)(?:<D>{1,2}[/-]<D>{1,2}[/-]<D>{2,4}|<D>{4}-<D>{1,2}-<D>{1,2})(?!<W>)"),
    ("DATE", 1, f"(?iu)(?=[JFMASOND])(?<!<W>)(?:{MONTHS})<S>+<D>{{1,2}}(?:st|nd|rd|th)?(?:,<S>*<D>{{4}})?<B>"),
]
#: Patterns of the passes for an introduced name, long numbers and two capitalised words.
INTRODUCED = "(?iu)(?=m)(?<!<W>)my name is<S>+([A-Z<x>][a-z<x>]+(?:<S>+[A-Z<x>][a-z<x>]+){0,2})<B>"
NUMBER = "(?=<D>)(?<!<W>)<D>{4,}(?!<W>)"
FULL_NAME = "(?=[A-Z])(?<!<W>)([A-Z][a-z]+)<S>+([A-Z][a-z]+)(?!<W>)"
HIT = StructType([StructField("label", StringType()), StructField("match", StringType()), *[StructField(c, IntegerType()) for c in ("start", "end", "pass_no", "orig_start", "orig_end")]])


@dataclass(frozen=True)
class Pass:
    number: int
    label: str
    pattern: str
    #: whether only the first group, the end of the match, is the hit, and all its occurrences in the match are masked
    grouped: bool = False
    #: pattern of a character without which there is no match; a mask has none of them
    needs: str = ""
    #: the pattern in Python's dialect
    python: str = ""


def ordered_terms(terms: Iterable[str]) -> list[str]:
    """The terms without white space at the ends and without empty ones, the longest first."""
    return sorted((t.strip() for t in terms if t and t.strip()), key=len, reverse=True)


def passes(level: str = "light", names: Iterable[str] = (), orgs: Iterable[str] = (), locations: Iterable[str] = ()) -> list[Pass]:
    """The passes of a level, in order; any other level is light. Terms count from standard on."""
    rank = LEVELS.index(level) if level in LEVELS else 0
    out = [Pass(i + 1, label, spelt(p), needs="@" if label == "EMAIL" else DIGIT, python=pythonic(p)) for i, (label, least, p) in enumerate(FIXED) if rank >= least]
    if rank >= 1:
        out.append(Pass(9, "NAME", spelt(INTRODUCED), grouped=True, python=pythonic(INTRODUCED)))
        for number, label, terms in ((10, "NAME", names), (11, "ORG", orgs), (12, "LOCATION", locations)):
            out += [Pass(number, label, spelt("(?iu)<B>") + literal(t) + spelt("<B>"), python=pythonic("(?iu)<B>") + re.escape(t) + pythonic("<B>")) for t in ordered_terms(terms)]
    if rank >= 2:
        out += [Pass(13, "NUM", spelt(NUMBER), needs=DIGIT, python=pythonic(NUMBER)), Pass(14, "NAME", spelt(FULL_NAME), python=pythonic(FULL_NAME))]
    return out


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _matches(text: Column, p: Pass, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(p.pattern), F.lit(group))


def _found(text: Column, p: Pass) -> Column:
    """The matches of one pass over text as an array of the text before each, the match and its hit; empty without a match."""
    whole = _matches(text, p)
    gaps = lambda m: F.slice(F.split(text, p.pattern, -1), 1, F.size(m))
    if not p.grouped:
        pair = lambda m: F.zip_with(gaps(m), m, lambda a, x: F.struct(a.alias("gap"), x.alias("m"), x.alias("hit")))
    else:
        hit = lambda m: F.zip_with(m, _matches(text, p, 1), lambda x, g: F.struct(x.alias("m"), g.alias("hit")))
        pair = lambda m: F.zip_with(gaps(m), hit(m), lambda a, x: F.struct(a.alias("gap"), x["m"].alias("m"), x["hit"].alias("hit")))
    return _bound(whole, lambda m: F.when(F.size(m) > 0, pair(m)).otherwise(F.array().cast("array<struct<gap:string,m:string,hit:string>>")))


def _with_mask(text: Column, found: Column, p: Pass) -> Column:
    """text with the mask for every hit in found."""
    mask = F.lit(f"[{p.label}]")
    masked = (lambda x: F.replace(x["m"], x["hit"], mask)) if p.grouped else lambda x: mask
    done = F.array_join(F.transform(found, lambda x: F.concat(x["gap"], masked(x))), "")
    used = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["m"]))
    return F.when(F.size(found) > 0, F.concat(done, F.substring(text, used + 1, F.length(text)))).otherwise(text)


def _guarded(state: Column, todo: list[Pass], step: Callable[[Column, Pass], Column], text: Callable[[Column], Column]) -> Column:
    """state after a step for each pass; passes in a row that need the same character are skipped together where it is missing."""
    def run(s: Column, group: list[Pass]) -> Column:
        for p in group:
            s = step(s, p)
        return s

    for needs, own in groupby(todo, key=lambda p: p.needs):
        group = list(own)
        state = _bound(state, partial(lambda s, needs, group: F.when(F.rlike(text(s), F.lit(needs)), run(s, group)).otherwise(s), needs=needs, group=group)) if needs else run(state, group)
    return state


def redact_text(c: Column | str, level: str = "light", names: Iterable[str] = (), orgs: Iterable[str] = (), locations: Iterable[str] = ()) -> Column:
    """c after all passes of the level. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c

    def step(text: Column, p: Pass) -> Column:
        return _bound(text, lambda t: _bound(_found(t, p), lambda found: _with_mask(t, found, p))) if p.grouped else F.regexp_replace(text, F.lit(p.pattern), F.lit(f"[{p.label}]"))

    return _guarded(c, passes(level, names, orgs, locations), step, lambda s: s)


class Places:
    """Where the letters of a text that passes have changed stood in the text given: masks, by place, as (start, end) now and then."""

    def __init__(self) -> None:
        self.masks: list[tuple[int, int, int, int]] = []

    def before(self, place: int, end: bool = False) -> int:
        """The place then of the letter at place now, or of the end of what ends there; within a mask that of the mask's own start or end."""
        i = bisect_left(self.masks, (place if end else place + 1,)) - 1
        if i < 0:
            return place
        _, last, first_then, last_then = self.masks[i]
        if place < last or end and place == last:
            return last_then if end else first_then
        return last_then + place - last

    def change(self, spans: list[tuple[int, int]], size: int) -> None:
        """spans of the text, by place and without overlaps, become masks of size letters; one that reaches into older masks is one mask with them."""
        old, new, moved, i = self.masks, [], 0, 0
        for start, end in spans:
            while i < len(old) and old[i][1] <= start:
                new.append((old[i][0] + moved, old[i][1] + moved, *old[i][2:]))
                i += 1
            lo, hi, first, last = start, end, self.before(start), self.before(end, True)
            while i < len(old) and old[i][0] < end:
                lo, hi, first, last = min(lo, old[i][0]), max(hi, old[i][1]), min(first, old[i][2]), max(last, old[i][3])
                i += 1
            new.append((lo + moved, hi + moved + size - (end - start), first, last))
            moved += size - (end - start)
        self.masks = new + [(a + moved, b + moved, c, d) for a, b, c, d in old[i:]]


def hits_in(text: str, todo: list[tuple[Pass, re.Pattern]]) -> tuple[str, list[tuple]]:
    """The text after all passes, and (label, match, start, end, pass_no, orig_start, orig_end) of every hit, in the order of passes and places."""
    places, hits = Places(), []
    for p, pattern in todo:
        found = list(pattern.finditer(text))
        if not found:
            continue
        mask, spans = f"[{p.label}]", []
        for m in found:
            start, end = m.span(int(p.grouped))
            hits.append((p.label, text[start:end], start, end, p.number, places.before(start), places.before(end, True)))
            at = m.start() if p.grouped else start
            while (at := text.find(text[start:end], at, m.end())) >= 0:
                spans.append((at, at + end - start))
                at += end - start
        places.change(spans, len(mask))
        out, at = [], 0
        for start, end in spans:
            out += [text[at:start], mask]
            at = end
        text = "".join([*out, text[at:]])
    return text, hits


def redaction_hits(df: DataFrame, text_col: str = "text", level: str = "light", names: Iterable[str] = (), orgs: Iterable[str] = (), locations: Iterable[str] = ()) -> DataFrame:
    """df with redacted (the text after all passes) and hits, an array of HIT in the order of passes and places.

    A hit's start and end are places in the text of its pass; orig_start and orig_end are those in the text given, so that for a hit without a mask in it the
    slice there equals match. Of a null text both are null. Rows that repeat are treated alike, an empty table gives an empty one. Columns of df with these two names
    are replaced, all others pass through. One narrow stage; a text's passes run in a Python worker, which gives each hit its places in one search a pass.
    """
    todo = passes(level, names, orgs, locations)
    kept = [c for c in df.columns if c not in ("redacted", "hits")]
    rows = df.select(F.struct(F.lit(True).alias("is"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(p, re.compile(p.python)) for p in todo]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 5]
        for batch in batches:
            done = [(None, None) if t is None else hits_in(t, compiled) for t in batch.column(1).to_pylist()]
            flat = [h for _, hits in done for h in hits or ()]
            fields = pa.StructArray.from_arrays([pa.array([h[i] for h in flat], k) for i, k in enumerate(kinds)], names=HIT.names)
            ends = np.cumsum([0] + [len(hits or ()) for _, hits in done]).astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(ends), fields, mask=pa.array([t is None for t, _ in done], pa.bool_())) if len(done) else pa.array([], pa.list_(fields.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), hits], names=["row", "redacted", "hits"])

    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("redacted", StringType()), StructField("hits", ArrayType(HIT))]))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "redacted", "hits")
