"""Rows on which a query is right and its SQL is not: instr() finds other places first, RE2's classes are ASCII alone."""

from tapeloom.plans import QUERIES


def test_a_hit_has_its_own_place(spark, tmp_path):
    # the digits of the zip stand in the name of the mail address, too
    spark.createDataFrame([(812345,), (388888,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    rows = QUERIES["redact_hit_places"](spark, str(tmp_path)).where("label = 'ZIP'").collect()
    assert {(r.doc_id, r.match, r.orig_start, r.orig_end, r.original) for r in rows} == {(812345, "12345", 167, 172, "12345"), (388888, "38888", 171, 176, "38888")}


def texts_of(spark, path, texts, name):
    """The rows of a query over documents of these texts."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return QUERIES[name](spark, str(path))


def test_a_street_is_no_part_of_a_word(spark, tmp_path):
    texts = ["von 82.197.113.214 geieein. Stää zu ü", "von 82.197.113.214 geieein. St zu ü", "ü1 Oak Hill Rd"]
    got = texts_of(spark, tmp_path, texts, "redact_light").orderBy("doc_id").collect()
    assert [r.text for r in got] == [texts[0], "von 82.197.113.[ADDRESS] zu ü", texts[2]]


STANDARD = ["von 82.197.113.214 geieein. Stää zu", "zip ü12345, 12345ß, 12345", "May 5ä, May 5, 2024", "my name is Annä, my name is Ann"]


def test_numbers_dates_and_names_end_with_the_word(spark, tmp_path):
    got = texts_of(spark, tmp_path, STANDARD, "redact_standard").orderBy("doc_id").collect()
    assert [r.text for r in got] == [STANDARD[0], "zip ü12345, 12345ß, [ZIP]", "May 5ä, [DATE]", "my name is Annä, my name is [NAME]"]


def test_counts_are_of_whole_words(spark, tmp_path):
    texts = [*STANDARD, "von 82.197.113.214 geieein. St zu ü"]
    got = {r.label: r.n for r in texts_of(spark, tmp_path, texts, "redaction_counts").collect()}
    assert got == {"ADDRESS": 1, "ZIP": 1, "DATE": 1, "NAME": 1}
