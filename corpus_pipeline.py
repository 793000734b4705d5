"""A corpus pipeline over documents: language ID, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and reads again
for the next. All stages but the last return the columns of documents; further columns of the input
are not read, whatever their names, and an empty table gives an empty one. As a stage's result is
written after it returns, stages leave the session's settings for small batches, those of lean(), set; run() puts them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, fitting, lean, release
from tapeloom.llm.language import held_out, language_spans, train
from tapeloom.llm.line_dedup import dedup_lines
from tapeloom.llm.mixing import TREE, mix
from tapeloom.llm.near_dup import near_duplicates
from tapeloom.llm.packing import pack, word_encoder
from tapeloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text goes if less than this share of its letters is in its main language.
MIN_SCORE = 0.5
#: Words whose ids a worker keeps: a bound of its memory alone.
WORDS = 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one known language for the most part; lang is then that language. A text that is null or has no letter goes; ties in share go to the first language by name, rows that repeat are treated alike."""
    lean(spark)
    labels = language_spans(docs.select(COLUMNS), train(docs.where(~held_out())), whole=True)
    kept = labels.where((F.col("_lang_pred") != "und") & (F.col("_score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("_lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of any length that stand on ten sites and in ten distinct texts or more. No row goes; a null text stays null, with a null n_chars; rows that repeat count once."""
    lean(spark)
    cleaned = dedup_lines(docs, min_sites=10)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five words, similarity 0.8. Null and empty texts are linked with nothing and stay; rows that repeat an id and a text are kept or dropped alike."""
    lean(spark)
    gone = cut(near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    keyed = docs.withColumn("_hash2", F.xxhash64("text"))
    return keyed.join(fitting(gone), (F.col("_hash") == F.col("_hash2")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The share of each leaf of the tree that its weights give of four fifths of all tokens, none twice. Null values count as empty ones, a null text as no tokens; rows that repeat an id stand together."""
    lean(spark)
    return mix(docs, TREE, percent=80, max_epochs=1, seed=7).where("_copies > 0").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences. A null or empty text is its end id alone; rows that repeat an id are documents of their own."""
    lean(spark)
    return pack(docs, lambda: word_encoder(tokenizer_path(), cached=WORDS))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the language model nor the tokenizer: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, asked = None, lean(spark)
    try:
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
            if before is not None:
                release(before)
            before = docs
    finally:
        for name, own in asked.items():
            spark.conf.set(name, own)
    return docs
