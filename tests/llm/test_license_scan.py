import re

from tapeloom.llm.license_scan import NOTICES, PHRASES, Scanner, allowed, license_scan, pieces


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    hits = 0
    for r in docs.collect():
        g = got[r.doc_id]
        want = brute(r.text)
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == want
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
        assert 0 <= g.score <= 1 and (g.score == 1) >= bool(g.n_base)
        hits += g.n_base
    assert hits > 5 and any("apache" in g.labels for g in got.values())


def test_overlaps_and_edges():
    s = Scanner(PHRASES, NOTICES)
    for text in ("CC by cc BY cc-by", "all rights reserved all rights reserved", "xcc by cc byx", "GENERAL,public\nlicense", "é cc by é", "cc\x00by"):
        got = s.scan(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute(text)


def test_edits_within_the_bound_are_found():
    s = Scanner(PHRASES, NOTICES)
    got = s.scan("Foo. Licensd under teh Apache License, Version 2.0! bar")
    assert got["labels"] == "apache-2.0" and got["n_base"] == 0 and 0.8 < got["score"] < 1
    (m,) = got["matches"]
    assert (m["first_word"], m["last_word"]) == (1, 8) and m["edits"] <= 4
    assert "Foo. Licensd under teh Apache License, Version 2.0! bar"[m["start"] : m["end"]] == "Licensd under teh Apache License, Version 2.0"
    assert s.scan("Licensed under CC BY 4.0")["labels"] == "cc-by"
    assert s.scan("Licensed under CC BY-NC 4.0")["labels"] == "cc-by,cc-by-nc"
    assert s.scan("nothing of the kind, all is right and reversed")["labels"] == ""


def test_edited_and_clean_copies_side_by_side_are_all_found():
    s = Scanner(PHRASES, NOTICES)
    clean, edited = "all rights reserved", "all rihts resrved"
    for parts in ((edited, clean), (clean, edited), (edited, clean, edited), (clean, edited, clean), (edited, edited, clean, clean, edited)):
        text = " ".join(parts)
        at, want = 0, []
        for p in parts:
            want.append((at, at + len(p), 2 if p == edited else 0))
            at += len(p) + 1
        assert [(m["start"], m["end"], m["edits"]) for m in s.scan(text)["matches"]] == want


def test_pieces_cover_a_notice():
    for n in NOTICES:
        parts = pieces(n, allowed(n))
        assert "".join(p for _, p in parts) == n and len(parts) == allowed(n) + 1 and min(len(p) for _, p in parts) > 3


def test_odd_rows(spark, odd):
    rows = license_scan(odd).collect()
    assert len(rows) == 10 and {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert license_scan(odd.limit(0)).count() == 0


def test_notices_in_one_window_and_many_hits():
    import time

    text = "relesed under the mit license released under the mit license relased under the mit licence"
    scanner = Scanner(PHRASES, NOTICES)
    found = scanner.scan(text)["matches"]
    assert [m["first_word"] for m in found] == [0, 5, 10] and [m["edits"] for m in found] == [1, 0, 2]
    many = "cc by all rights reserved x " * 20000
    began = time.perf_counter()
    assert scanner.scan(many)["n_base"] == 40000
    assert time.perf_counter() - began < 20


def test_many_edited_copies_in_time():
    import random
    import time

    rng = random.Random(3)
    notice, copies = "all rights reserved", []
    while sum(map(len, copies)) < 300_000:
        at = [rng.randrange(len(notice)) for _ in range(rng.randint(0, 1))]
        copies.append("".join("x" if i in at and c != " " else c for i, c in enumerate(notice)) + " w" * rng.randint(0, 3))
    text = " ".join(copies)
    began = time.perf_counter()
    found = Scanner(PHRASES, NOTICES).scan(text)["matches"]
    assert time.perf_counter() - began < 20 and len(found) == len(copies)
