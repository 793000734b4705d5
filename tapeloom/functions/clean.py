"""Cleaning of transcripts: line ends, wrapped lines, spacing and quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.dialect import SPACE, SPACES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _each(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return c


# The patterns below are fixed values.


def clean_ws(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return _each(_col(c), (f"{SPACE}+", " "), (r"\A | \z", ""))


def normalize_lines(c: Column | str) -> Column:
    """Line feeds for all line ends, and no white space at either end of a line."""
    blank = f"[{SPACES}&&[^\\n]]"
    return _each(_col(c), (r"\r\n?", "\n"), (f"{blank}*\\n{blank}*", "\n"), (f"\\A{blank}+|{blank}+\\z", ""))


def join_wrapped(c: Column | str) -> Column:
    """A line that ends no sentence and the next one, if that begins in lower case (a quote may precede it), on one line."""
    return _each(_col(c), ("(?<=[^.!?:\\n])\\n(?=[\"'“”‘’]?[a-z])", " "))


def collapse_blank_lines(c: Column | str) -> Column:
    """One blank line for several; no white space at the ends but one final line feed."""
    return F.concat(_each(_col(c), (r"\n{3,}", "\n\n"), (f"\\A{SPACE}+|{SPACE}+\\z", "")), F.lit("\n"))


def punctuation_spacing(c: Column | str) -> Column:
    """No space before a mark or inside parentheses, one between a mark and a letter."""
    return _each(_col(c), (f"{SPACE}+([,.;:!?])", "$1"), ("([,.;:!?])([A-Za-z])", "$1 $2"), (f"\\({SPACE}+", "("), (f"{SPACE}+\\)", ")"))


def plain_quotes(c: Column | str) -> Column:
    return F.translate(_col(c), "“”‘’", "\"\"''")


def clean_text(c: Column | str, mode: str = "standard") -> Column:
    """All of the above, and runs of blanks and tabs as one blank; quotes become plain in mode standard alone. Null stays null."""
    c = punctuation_spacing(collapse_blank_lines(join_wrapped(normalize_lines(c))))
    if mode == "standard":
        c = plain_quotes(c)
    return _each(c, ("[ \\t]{2,}", " "))
