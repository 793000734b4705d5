import random
import re

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import redact_term_table, redact_text, redaction_hits
from tapeloom.functions.terms import Terms, _taken

TERMS = "kind string, term string"


def passes(text, terms):
    """One pass for each (label, term) in turn."""
    for label, term in terms:
        text = re.sub(rf"(?i)\b{re.escape(term)}\b", f"[{label}]", text)
    return text


def ordered(terms):
    clean = {(k.upper(), t.strip()) for k, t in terms if k and t and t.strip()}
    return sorted(clean, key=lambda x: ({"NAME": 0, "ORG": 1, "LOCATION": 2}.get(x[0], 3), x[0], -len(x[1]), x[1]))


def test_places_equal_one_pass_a_term():
    rng = random.Random(1)
    for _ in range(6000):
        terms = sorted({"".join(rng.choice("aAb -é") for _ in range(rng.randint(1, 4))).strip() for _ in range(4)} - {""}, key=lambda x: (-len(x), x))
        text = "".join(rng.choice("aAbBé --_") for _ in range(rng.randint(0, 14)))
        out, at = "", 0
        for _, start, end, _ in _taken(text, Terms([(i, "Z9", t) for i, t in enumerate(terms)]).found(text)):
            out, at = out + text[at:start] + "[Z9]", end
        assert out + text[at:] == passes(text, [("Z9", t) for t in terms]), (terms, text)


@pytest.mark.parametrize("at_once", [200_000, 3])
def test_a_table_equals_one_pass_a_term(spark, at_once):
    terms = [("name", "Mary Poppins"), ("NAME", " mary "), ("NAME", "name"), ("ORG", "ACME"), ("org", "acme corp"), ("ORG", "Corp."), ("LOCATION", "Oak Hill"), ("LOCATION", "hill"), ("LOCATION", "org"), ("Ship", "Poppins"), ("NAME", ""), (None, "x"), ("NAME", None), ("NAME", "straße"), ("NAME", "--"), ("NAME", "mary ")]
    texts = ["Mary Poppins of ACME Corp. at OAK HILL; mary, hill", "my name is MARY", None, "", "acme corp acme Corp.x Oakhill", "STRASSE Straße a--b -- c", "Name poppins" * 3, "é\U0001f600 Mary " * 400]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row long, text string, hits string")
    got = redact_term_table(df, spark.createDataFrame(terms, TERMS), terms_per_pass=at_once).orderBy("row").collect()
    assert [r.redacted for r in got] == [None if t is None else passes(t, ordered(terms)) for t in texts]
    assert all(h.match == t[h.start : h.end] for t, r in zip(texts, got, strict=True) for h in r.hits or ())
    assert got[2].hits is None and got[3].hits == [] and [h.label for h in got[0].hits] == ["NAME", "ORG", "LOCATION", "NAME", "LOCATION"]
    plain = [(r.redacted,) for r in df.where("row < 5").select(redact_text("text", "standard", names=("Oak",), orgs=("acme", "acme corp")).alias("redacted")).collect()]
    table = redact_term_table(df.where("row < 5"), spark.createDataFrame([("NAME", "Oak"), ("ORG", "acme"), ("ORG", "acme corp")], TERMS))
    # the passes with patterns mask the introduced name first
    assert [r.redacted for r in table.orderBy("row").collect()] == [p[0] and p[0].replace("is [NAME]", "is MARY") for p in plain]
    empty = spark.createDataFrame([], TERMS)
    assert [r.redacted for r in redact_term_table(df, empty).orderBy("row").collect()] == texts
    assert redact_term_table(df.limit(0), spark.createDataFrame(terms, TERMS)).count() == 0


def test_ten_thousand_terms(spark):
    terms = [("NAME", f"Person {i}") for i in range(6000)] + [("ORG", f"Firm{i} & Sons") for i in range(4000)]
    df = spark.range(2000).select("id", F.concat(F.lit("PERSON "), F.col("id") * 4, F.lit(" met firm"), F.col("id") * 3, F.lit(" & sons, person 1x.")).alias("text"))
    got = redact_term_table(df, spark.createDataFrame(terms, TERMS))
    size = len(got._jdf.queryExecution().toString())
    few = redact_term_table(df, spark.createDataFrame(terms[:2], TERMS))
    assert abs(size - len(few._jdf.queryExecution().toString())) < 400
    by = {r.id: r.redacted for r in got.collect()}
    assert by[7] == "[NAME] met [ORG], person 1x." and by[1400] == "[NAME] met firm4200 & sons, person 1x." and by[1999].startswith("PERSON 7996 met")


def test_places_in_the_text_given(spark):
    texts = ["My Name is ANN lee. mail a@b.co b@c.de 555-201-3333 zip 12345, Ann at 1 Oak Hill Rd on 2024-01-02 Email my name is name 99999999 Foo Bar", None, "", "é\U0001f600 a@b.co 123456"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "i long, text string, _state int")
    got = redaction_hits(df, level="heavy", names=("Ann", "email")).orderBy("i").collect()
    plain = [h for h in got[0].hits if "[" not in h.match and h.match != "EMAIL"]
    assert len(plain) == 13 and all(texts[0][h.orig_start : h.orig_end] == h.match for h in plain)
    masks = [h for h in got[0].hits if h.match == "EMAIL"]
    assert [texts[0][h.orig_start : h.orig_end] for h in masks] == ["a@b.co", "b@c.de"]
    assert got[1].hits is None and got[2].hits == [] and [(h.orig_start, h.orig_end) for h in got[3].hits] == [(3, 9), (3, 9), (10, 16)]
    rng = random.Random(3)
    bits = ["a@b.co", " ", "12345", "555-201-3333", "Ann Lee", "my name is Bo", ",", "é", "2024-01-02", "x"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    out = redaction_hits(df, level="heavy").join(df.select("i", redact_text("text", "heavy").alias("want")), "i").collect()
    assert all(r.redacted == r.want for r in out)
    assert all(r.text[h.orig_start : h.orig_end] == h.match for r in out for h in r.hits if "[" not in h.match)
