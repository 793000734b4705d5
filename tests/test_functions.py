import random
import re

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import clean_text, clean_ws, format_ts, redact_text, redaction_hits
from tapeloom.functions.dialect import spelt
from tapeloom.functions.redact import ordered_terms


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_clean_golden(spark):
    texts = ["so we went\nto the store,\nthen home.\nnext", "a\n\n\n\nb", "mail a@b.com now", "( x )  y ,z", "“Hi”  there", "", None]
    light = ["so we went to the store, then home.\nnext\n", "a\n\nb\n", "mail a@b. com now\n", "(x) y, z\n", "“Hi” there\n", "\n", None]
    got = values(spark, texts, clean_text("text", "light"), clean_text("text"))
    assert [g[0] for g in got] == light
    assert [g[1] for g in got] == [*light[:4], '"Hi" there\n', "\n", None]


def restated(text, mode):
    """Cleaning as a walk over lines."""
    lines = [x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    out = [lines[0]]
    for line in lines[1:]:
        if out[-1] and line and out[-1][-1] not in ".!?:" and re.match("[\"'“”‘’]?[a-z]", line):
            out[-1] += " " + line
        else:
            out.append(line)
    text = re.sub("\n{3,}", "\n\n", "\n".join(out)).strip() + "\n"
    for p, r in ((r"\s+([,.;:!?])", r"\1"), (r"([,.;:!?])([A-Za-z])", r"\1 \2"), (r"\(\s+", "("), (r"\s+\)", ")")):
        text = re.sub(p, r, text)
    if mode == "standard":
        text = text.translate(str.maketrans("“”‘’", "\"\"''"))
    return re.sub("[ \t]{2,}", " ", text)


def test_clean_equals_a_walk_over_lines(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "B", "c d", "é", " ", "\n", "\n", "\r\n", "\r", "\t", ".", ",", ":", "(", ")", "“", "’", "\xa0", "\x1c", " ", "\U0001f600"]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    got = values(spark, texts, clean_text("text", "light"), clean_text("text"))
    assert got == [(restated(t, "light"), restated(t, "standard")) for t in texts]


def test_times_and_white_space(spark):
    got = values(spark, ["-3", "0.3", "59.99", "3599.95", "3600", "3725.4", None], format_ts(F.col("text").cast("double")))
    assert [g[0] for g in got] == ["00:00.0", "00:00.3", "00:59.9", "59:59.9", "00:00.0", "02:05.4", None]
    assert values(spark, [" a　\x1f b\xa0", "\n"], clean_ws("text")) == [("a b",), ("",)]


CORNERS = "\x1c\x1f\x85\xa0    　​‍﻿́٠１\xb2Ⅷ①\xbd中\xe9İıſK_\U0001f600"


@pytest.mark.parametrize(
    ("ours", "python", "form", "flags"),
    [
        ("a<S>+b", r"a\s+b", "a{}b", 0), ("<B><D>{5}<B>", r"\b\d{5}\b", "12345{}", 0), ("<B><D>{5}<B>", r"\b\d{5}\b", "{}12345", 0), ("<D>{4,}", r"\d{4,}", "{0}{0}{0}{0}", 0),
        ("<B>[A-Z][a-z]+", r"\b[A-Z][a-z]+", "{}Ab", 0), ("(?<!<W>)<D>{3}", r"(?<!\w)\d{3}", "{}123", 0), ("(?iu)[A-Z<x>]+", "[A-Z]+", "{}", re.I),
    ],
)
def test_dialect_equals_pythons(spark, ours, python, form, flags):
    texts = [form.format(c) for c in CORNERS]
    got = values(spark, texts, F.regexp_extract_all("text", F.lit(spelt(ours)), F.lit(0)))
    assert [g[0] for g in got] == [[m[0] for m in re.finditer(python, t, flags)] for t in texts]


def test_redaction_golden(spark):
    texts = ["my name is name", "zip 12345, a@b.co b@c.de 555-201-3333", "x@y.com", None, "é\U0001f600 a@b.co 4111 1111 1111 1111", "My Name is ANN lee MARY Jo, and my name is Bo."]
    got = values(spark, texts, redact_text("text", "standard"), redact_text("text", "light"), redact_text("text", "standard", names=("email", " ")))
    assert [g[0] for g in got] == ["my [NAME] is [NAME]", "zip [ZIP], [EMAIL] [EMAIL] [PHONE]", "[EMAIL]", None, "é\U0001f600 [EMAIL] [CARD]", "My Name is [NAME] Jo, and my name is [NAME]."]
    assert got[0][1] == "my name is name" and got[1][1].startswith("zip 12345")
    assert got[2][2] == "[[NAME]]"
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, text string, hits string")
    out = {r.i: r for r in redaction_hits(rows, level="standard").collect()}
    assert [(h.label, h.match, h.start, h.end) for h in out[1].hits] == [("EMAIL", "a@b.co", 11, 17), ("EMAIL", "b@c.de", 18, 24), ("PHONE", "555-201-3333", 27, 39), ("ZIP", "12345", 4, 9)]
    assert [(h.start, h.end) for h in out[0].hits] == [(11, 15)] and out[3].hits is None
    assert [(h.match, h.start) for h in out[4].hits] == [("a@b.co", 3), ("4111 1111 1111 1111", 11)]
    assert all(out[i].redacted == got[i][0] for i in range(6))


def test_levels_and_terms(spark):
    text = ["ref 700001 by Mary Poppins of ACME Corp. at Oak Hill, acme corporation"]
    assert values(spark, text, redact_text("text", "heavy")) == [("ref [NUM] by [NAME] of ACME Corp. at [NAME], acme corporation",)]
    assert values(spark, text, redact_text("text", "standard", orgs=("acme", "acme corp"), locations=("oak hill",))) == [("ref 700001 by Mary Poppins of [ORG]. at [LOCATION], [ORG] corporation",)]
    assert values(spark, text, redact_text("text", "whatever")) == [(text[0],)]
    assert ordered_terms([" ab ", "", "c", None, "abc"]) == ["abc", "ab", "c"]
