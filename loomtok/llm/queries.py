"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtok.llm import chat, html_extract, line_dedup, packing, pii, quality, sentencepiece_fst, simhash, tiff, token_count
from loomtok.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "text", "lines_dropped")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extraction(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.sentencepiece(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.tiff_pages(tiff.rendered(table(spark, sf_dir, "embeddings", "vec_id", "embedding")), "vec_id", "media", values=True)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.as_text(chat.chat_format(chat.typed(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumn("posterior", F.round("posterior", 6))  # as far as two engines agree


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dups(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_html_extraction, op3_sentencepiece, op4_packing, op5_tiff, op6_chat_formatting, op7_token_counts, op8_quality_rules, op9_pii, op10_simhash)
}
ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op5_tiff": tiff.ORACLE, "op6_chat_formatting": chat.ORACLE, "op8_quality_rules": quality.ORACLE}
