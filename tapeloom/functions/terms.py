"""Masking of a caller's terms from a table of any number of them.

Words of a text and of the terms meet by n-grams: a term is looked up by the words it holds, in whatever
case, and then held against the text letter by letter, so that the plan is the same for ten terms and for a million.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

#: Order in which kinds are masked; others follow by name.
KINDS = ("NAME", "ORG", "LOCATION")
HIT = StructType([StructField("label", StringType()), StructField("match", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
WORD = re.compile(r"\w+")
#: Letters that a match without regard to case takes for i, beyond those that folding makes alike.
DOTS = str.maketrans("İı", "ii")


def _folded(text: str) -> str:
    """A key that is equal for texts that match without regard to case; some that don't match share one too."""
    return text.translate(DOTS).casefold()


def _pattern(term: str) -> re.Pattern:
    return re.compile(rf"(?i)\b{re.escape(term)}\b")


class Terms:
    """Terms (rank, label, term) by the words they hold. A term of no word at all stands for what lies between two words."""

    def __init__(self, terms: list[tuple[int, str, str]]):
        self.by: dict[str, list[tuple[int, str, str, int]]] = {}
        sizes: dict[str, set[int]] = {}
        self.between: dict[str, list[tuple[int, str, str, int]]] = {}
        for rank, label, term in terms:
            words = list(WORD.finditer(term))
            if not words:
                self.between.setdefault(term, []).append((rank, label, term, 0))
                continue
            self.by.setdefault(_folded(term[words[0].start() : words[-1].end()]), []).append((rank, label, term, words[0].start()))
            sizes.setdefault(_folded(words[0][0]), set()).add(len(words))
        self.sizes = {w: sorted(n) for w, n in sizes.items()}
        self.patterns: dict[str, re.Pattern] = {}

    def found(self, text: str) -> list[tuple[int, int, int, str]]:
        """(rank, start, end, label) of every place where a term stands in text; overlapping ones too."""
        spans = [m.span() for m in WORD.finditer(text)]
        out = []
        for i, (start, end) in enumerate(spans):
            for n in self.sizes.get(_folded(text[start:end]), ()):
                if i + n <= len(spans):
                    for rank, label, term, lead in self.by.get(_folded(text[start : spans[i + n - 1][1]]), ()):
                        if term not in self.patterns:
                            self.patterns[term] = _pattern(term)
                        m = self.patterns[term].match(text, start - lead) if start >= lead else None
                        if m:
                            out.append((rank, *m.span(), label))
            if self.between and i + 1 < len(spans):
                gap = (end, spans[i + 1][0])
                out += [(rank, *gap, label) for rank, label, _, _ in self.between.get(text[gap[0] : gap[1]], ())]
        return out


def _taken(text: str, found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Those of found that passes of one term each, in the order of ranks, would mask, by place.

    What overlaps a place that is masked already is gone; a term that begins or ends with a mark needs a letter
    beside it, which a mask is not.
    """
    starts: list[int] = []
    out: list[tuple[int, int, int, str]] = []  # by start, without overlaps
    for rank, start, end, label in sorted(found):
        i = bisect_left(starts, start)
        left, right = out[i - 1] if i else None, out[i] if i < len(out) else None
        clear = (left is None or left[2] <= start) and (right is None or end <= right[1])
        # masks of passes before are no letters; those of the same pass are made at once
        cut_off = left and left[2] == start and left[0] < rank and not WORD.match(text[start]) or right and right[1] == end and right[0] < rank and not WORD.match(text[end - 1])
        if clear and not cut_off:
            starts.insert(i, start)
            out.insert(i, (rank, start, end, label))
    return out


def ranked(terms: DataFrame) -> DataFrame:
    """(rank, label, term) of terms(kind, term): by kind, the longer first, then by term; without white space at their ends, empty and null ones and repeats."""
    kind = F.upper(F.col("kind"))
    place = F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    term = F.regexp_replace("term", r"(?U)\A\s+|\s+\z", "")
    clean = terms.select(place.alias("p"), kind.alias("label"), term.alias("term")).where("label IS NOT NULL AND term <> ''").distinct()
    order = ("p", "label", F.desc(F.length("term")), "term")
    return clean.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "label", "term")


def redact_term_table(df: DataFrame, terms: DataFrame, *, text_col: str = "text", terms_per_pass: int = 200_000) -> DataFrame:
    """df with redacted (the text with every term as [KIND]) and hits, an array of HIT with places in the text given, in its order.

    terms(kind, term) is a table; terms match as whole words, in whatever case. The result is that of one pass for
    each term over what the passes before left: names, organisations, places, then other kinds, of each kind the longest first
    (ties: by term). So of overlapping terms the first in that order stands, and a term that is itself a kind in use (`name`) goes into
    the masks made before it, as those passes do.
    Nulls: a null text has a null result; null and empty terms are none. Rows that repeat are masked alike; columns of df
    named redacted or hits are replaced, all others pass through; empty tables give what they hold.
    The number of terms is checked: terms_per_pass of them at a time go to the workers, and where there are more, the texts go through as many
    workers one after the other. No text is shuffled. The list of terms itself is ranked in one task.
    """
    spark = df.sparkSession
    listed = ranked(terms).toLocalIterator(prefetchPartitions=True)
    groups: list[list[tuple[int, str, str]]] = [[]]
    for r in listed:
        if len(groups[-1]) == terms_per_pass:
            groups.append([])
        groups[-1].append((r["rank"], r["label"], r["term"]))
    labels = {label for g in groups for _, label, _ in g}
    named = [x for g in groups for x in g if any(_pattern(x[2]).search(f"[{label}]") for label in labels)] if any(groups) else []

    kept = [c for c in df.columns if c not in ("redacted", "hits")]
    rows = df.select(F.struct(F.lit(True).alias("is"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.array().cast("array<struct<rank:int,start:int,end:int,label:string>>").alias("found"))
    place = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
    for group in groups:
        sent = spark.sparkContext.broadcast(group)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Terms(sent.value)
            for batch in batches:
                found = [x + [dict(zip(("rank", "start", "end", "label"), y, strict=True)) for y in own.found(t or "")] for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, place)], names=["row", "text", "found"])

        rows = rows.mapInArrow(look, rows.schema)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[tuple[str, int], str] = {}

        def mask(label: str, rank: int) -> str:
            if (label, rank) not in masks:
                text = f"[{label}]"
                for later, other, term in named:
                    if later > rank:
                        text = _pattern(term).sub(f"[{other}]", text)
                masks[label, rank] = text
            return masks[label, rank]

        hit = pa.list_(pa.struct([("label", pa.string()), ("match", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, hits = [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                taken = _taken(t, [(x["rank"], x["start"], x["end"], x["label"]) for x in found]) if found else []
                at, out = 0, []
                for rank, start, end, label in taken:
                    out += [t[at:start], mask(label, rank)]
                    at = end
                texts.append(None if t is None else "".join([*out, t[at:]]))
                hits.append(None if t is None else [{"label": label, "match": t[start:end], "start": start, "end": end} for _, start, end, label in taken])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(hits, hit)], names=["row", "redacted", "hits"])

    shape = StructType([rows.schema["row"], StructField("redacted", StringType()), StructField("hits", ArrayType(HIT))])
    done = rows.mapInArrow(masked, shape)
    return done.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "redacted", "hits")

