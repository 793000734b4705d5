"""The queries of this subpackage, as registered in __spark_entry__.py, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import line_dedup, mixing, tool_calls
from tapeloom.llm.alignment import aligned
from tapeloom.llm.bm25 import search
from tapeloom.llm.common import table
from tapeloom.llm.embedding_dup import embedding_duplicates
from tapeloom.llm.language import held_out, language_spans, train
from tapeloom.llm.license_scan import license_scan
from tapeloom.llm.line_dedup import dedup_lines
from tapeloom.llm.media import media_features, to_media
from tapeloom.llm.mixing import TREE, mix
from tapeloom.llm.near_dup import near_duplicates
from tapeloom.llm.packing import pack, word_encoder
from tapeloom.llm.pii import pii_spans
from tapeloom.llm.spelling import spelling_groups, word_counts
from tapeloom.llm.tool_calls import SCHEMAS, calls_of, link_calls


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(table(spark, sf_dir, "documents"))).drop("error")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"), min_sites=10)
    return cleaned.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_calls(*calls_of(table(spark, sf_dir, "conversations")), SCHEMAS)
    return linked.withColumn("layer", F.coalesce("layer", F.lit(-1)))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_hash")


def op6_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 50 = 0"), k=10)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents")).drop("found")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return language_spans(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), TREE, percent=60, max_epochs=2, seed=7)
    return mixed.where("_copies > 0").select("doc_id", "domain", "lang", "source", F.col("_n_tokens").alias("n_tokens"), F.col("_copies").alias("copies"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    from public_tokenizers import path

    return path(name)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), lambda: word_encoder(tokenizer_path()))


def op11_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), min_chars=6, damage=199)
    return spelling_groups(words.where("n >= 5"), ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_line_dedup, op3_license_scan, op4_tool_calls, op5_minhash_near_dup, op6_bm25_top_k, op7_pii, op8_language_id, op9_mixing, op10_sum_of_squares_packing, op11_embedding_near_dup, op12_spelling_variants, op13_tokenizer_alignment)}
ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op4_tool_calls": tool_calls.ORACLE, "op9_mixing": mixing.ORACLE}
