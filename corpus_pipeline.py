"""The corpus pipeline: quality rules, line dedup, near-dedup, PII masking, packing. Each stage is written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtok.llm import line_dedup, packing, pii, quality, simhash
from loomtok.llm.common import delete, scratch, shared_folder, spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    return quality.stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of more than 10 documents stay in the first one only; documents left without a line go."""
    return line_dedup.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies stays; one without a doc_id only if the group has no others."""
    return simhash.stage(docs, without_id=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are masked."""
    return pii.stage(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens with the documents' ids and text."""
    return packing.stage(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality_rules), ("line_dedup", lines), ("simhash", near_duplicates), ("pii", personal_data), ("packing", windows)]

#: EM, the tries and the random field have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read as the next one's input.

    A stage's rows are deleted when the next one's are written whole, so that two stages' rows are held at most, and
    so are the tables that it wrote on its way. After an error nothing is left; else the last stage's rows are.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    before = None
    try:
        for name, stage in STAGES:
            with scratch():
                stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                delete(spark, f"{folder}/{before}")
            before = name
    except BaseException:
        delete(spark, folder)
        raise
    return docs
