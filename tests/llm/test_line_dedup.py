import random

from pyspark.sql import functions as F

from tapeloom.llm.line_dedup import boilerplate, dedup_lines

BLANK = " \t\r"


def brute(rows, min_sites, max_chars=None):
    """(lines, removed, text) of each of rows(text, site)."""
    sites, texts = {}, {}
    for text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(BLANK) and (max_chars is None or len(line) <= max_chars):
                texts.setdefault(line.strip(BLANK), set()).add(text)
                sites.setdefault(line.strip(BLANK), set()).update([] if site is None else [site])
    bad = {x for x, t in texts.items() if len(t) >= min_sites and len(sites[x]) >= min_sites}
    out = []
    for text, _ in rows:
        if text is None:
            out.append((0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(BLANK) not in bad]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(docs, **bounds):
    rows = [(r.text, r.source) for r in docs.collect()]
    got = dedup_lines(docs, **bounds)
    assert got.columns == [*docs.columns, "_n_lines", "_n_removed"]
    want = brute(rows, **bounds)
    assert sorted(map(repr, [(r._n_lines, r._n_removed, r.text) for r in got.collect()])) == sorted(map(repr, want))
    return want


def test_spreads_around_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for spread in range(6, 16):
        for i in range(spread):  # a footer on `spread` sites, with blanks of its own
            rows.append((f"body {spread} {i} {rng.random()}\n  footer {spread}\t\r\n\nend {i}", f"site{i}"))
    rows += [(f"only here {i}\none site's line", "site0") for i in range(40)]
    rows += [("a whole copy\non many sites", f"site{i}") for i in range(40)]
    rows += [(f"text {i}\nno site", None) for i in range(40)]
    want = check(spark.createDataFrame(rows, "text string, source string"), min_sites=10)
    removed = [n for _, n, _ in want]
    # footers of 10 to 15 sites; every `end i` stands in at most ten texts, of one site each
    assert sum(removed) == sum(range(10, 16))
    assert removed[-120:] == [0] * 120


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert any(n for _, n, _ in check(docs, min_sites=10))
    check(docs, min_sites=10, max_chars=200)
    check(docs, min_sites=3, max_chars=80)


def test_odd_rows(spark, odd):
    for bounds in ({"min_sites": 2}, {"min_sites": 1}):
        check(odd, **bounds)
    assert dedup_lines(odd.limit(0)).count() == 0
    assert boilerplate(odd.limit(0)).count() == 0
    emptied = dedup_lines(odd.where("doc_id in (5, 6, 9)"), min_sites=1).where("doc_id = 9").first()
    assert emptied.text == "" and emptied._n_removed == 1


def test_own_column_names_and_passes(spark):
    rows = [(i, f"own {i}\nfoot a\nfoot b\n{'x' * 300}", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("_drop", "_n_lines", "_n_removed", "_text_key", "_kept", "row", "n_lines", "line_key", "a.b"):
        docs = docs.withColumn(name, F.lit("x"))
    for more in ({}, {"keys_per_pass": 1}):
        out = dedup_lines(docs, min_sites=10, **more)
        assert len(set(out.columns)) == len(out.columns)
        got = sorted((r.doc_id, r.text, r._n_lines, r._n_removed, r._drop, r.row) for r in out.collect())
        assert got == [(i, f"own {i}", 4, 3, "x", "x") for i in range(12)]
