"""Counting: pieces, characters, pairs, symbols, substrings. Each has one shuffle on the counted key, after partial counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.functions import buffers
from loomtok.functions import text as T
from loomtok.plans.config import TrainerKind


def prepared(texts: DataFrame, max_chars: int, column: str = "text") -> DataFrame:
    """(text): what training counts, non-empty and truncated."""
    return texts.where(T.has_text(column)).select(T.truncate(column, max_chars).alias("text"))


def counted(rows: DataFrame, words: bool = False) -> DataFrame:
    """(piece, freq) of the texts in ``rows`` (text): raw byte-level pieces, or words.

    Pieces are cut and counted in the Arrow batches' own buffers, so that what leaves a batch are its distinct pieces;
    native expressions give the same rows in three times the time, since they make an array of strings for each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in buffers.counted(batch.column(0), words):
                yield pa.RecordBatch.from_arrays(list(found), ["piece", "n"])

    return rows.select("text").mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("freq"))


def piece_counts(rows: DataFrame, kind: TrainerKind = TrainerKind.byte_bpe) -> DataFrame:
    """(piece, freq), exact. Byte-level pieces are encoded once each, after the counting: that is one to one."""
    if kind is not TrainerKind.byte_bpe:
        return counted(rows, words=True)
    return counted(rows).select(T.byte_encode("piece").alias("piece"), "freq")


def top_pieces(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent pieces, ties in binary order."""
    return counts.orderBy(F.desc("freq"), "piece").limit(k)


def frequent(counts: DataFrame, min_freq: int) -> DataFrame:
    return counts.where(F.col("freq") >= min_freq)


def alphabet(counts: DataFrame) -> DataFrame:
    """(symbol): the characters of all counted words."""
    return counts.select(F.explode(T.code_points("piece")).alias("symbol")).distinct()


def pair_counts(words: DataFrame, symbols: str = "syms") -> DataFrame:
    """(l, r, freq) of adjacent symbols, weighted by the words' frequency."""
    return words.select(F.inline(T.adjacent(symbols)), "freq").groupBy("l", "r").agg(F.sum("freq").alias("freq"))


def symbol_counts(words: DataFrame, symbols: str = "syms") -> DataFrame:
    """(symbol, freq)."""
    return words.select(F.explode(symbols).alias("symbol"), "freq").groupBy("symbol").agg(F.sum("freq").alias("freq"))


def pair_scores(words: DataFrame, symbols: str = "syms", frequencies: bool = False) -> DataFrame:
    """(l, r, freq, score): how much more often two symbols meet than their own frequencies say, which l_freq and r_freq give if asked for."""
    one = symbol_counts(words, symbols)
    left = one.select(F.col("symbol").alias("l"), F.col("freq").alias("l_freq"))
    right = one.select(F.col("symbol").alias("r"), F.col("freq").alias("r_freq"))
    score = F.col("freq").cast("double") / (F.col("l_freq").cast("double") * F.col("r_freq").cast("double"))
    return pair_counts(words, symbols).join(left, "l").join(right, "r").select("l", "r", "freq", score.alias("score"), *["l_freq", "r_freq"] * frequencies)


def seed_counts(counts: DataFrame, longest: int, min_freq: int = 1, characters: bool = True) -> DataFrame:
    """(token, freq, required): all ``characters``, which are required, and all substrings of 2 to ``longest`` code points."""
    tokens = F.explode(F.concat(*[T.code_points("piece")] * characters, T.substrings("piece", longest)))
    found = frequent(counts, min_freq).select(tokens.alias("token"), "freq").groupBy("token").agg(F.sum("freq").alias("freq"))
    return found.withColumn("required", F.char_length("token") == 1)


def filter_stats(texts: DataFrame, min_chars: int, max_chars: int, by: str | None = None, column: str = "text") -> DataFrame:
    """(num_docs, num_skipped, num_empty, num_chars): empty texts count nowhere else, short ones are skipped, the rest are truncated."""
    there, long = T.has_text(column), T.long_enough(column, min_chars)
    aggs = [
        F.count_if(there & long).alias("num_docs"),
        F.count_if(there & ~long).alias("num_skipped"),
        F.count_if(~there).alias("num_empty"),
        F.coalesce(F.sum(F.when(there & long, F.char_length(T.truncate(column, max_chars)))), F.lit(0)).alias("num_chars"),
    ]
    return (texts.groupBy(by) if by else texts.groupBy()).agg(*aggs)
