import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats and a column whose name clashes with the operators' own."""
    long = " ".join(f"wort{i % 977} är" for i in range(30000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (None, "a text without an id\nline", None, "b", 3),
        (5, "same words here again\nfooter", "en", "a", 9), (5, "same words here again\nfooter", "en", "a", 9), (6, "same words here again\nfooter", "en", "b", 9),
        (7, long, "de", "c", 1), (8, long + " ende", "de", "c", 1), (9, "\U0001f600 é \x00 12", "fr", "c", 1),
    ]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, DOCS)
    for name in ("v", "label", "key", "n", "a"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame
