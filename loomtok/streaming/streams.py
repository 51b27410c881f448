"""Structured Streaming: texts that arrive as files, encoded into shards batch by batch, and running piece counts."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtok.functions import text as T
from loomtok.plans.dataset import dtype_of, in_shards, placed, write_shards
from loomtok.plans.tokenizer import Tokenizer
from loomtok.sources import files


def texts(spark: SparkSession, folder: str, field: str = "text", kind: str = "parquet", schema: str | None = None, per_batch: int = 100) -> DataFrame:
    """A stream of non-empty texts from files of a folder as they arrive."""
    rows = spark.readStream.format(kind).schema(schema or f"{field} string").option("maxFilesPerTrigger", per_batch).load(folder)
    return rows.select(F.col(field).alias("text")).where(T.has_text("text"))


def encoded(stream: DataFrame, tokenizer: Tokenizer, min_chars: int = 1, max_chars: int = 20_000, bos_token: str = "", eos_token: str = "") -> DataFrame:
    """(ids) of a stream of texts; stateless, so it can be appended."""
    kept = stream.where(T.long_enough("text", min_chars)).withColumn("text", T.truncate("text", max_chars))
    return tokenizer.encode_frame(kept.withColumn("one", F.lit(1)), ["one"], "text", bos_token, eos_token).select("ids")


def running_counts(stream: DataFrame, byte_level: bool = True) -> DataFrame:
    """(piece, freq) so far, for the update or complete mode. The state grows with the distinct pieces."""
    pieces = T.byte_pieces("text") if byte_level else T.words("text")
    return stream.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("freq"))


def to_shards(stream: DataFrame, tokenizer: Tokenizer, out_dir: str, checkpoint: str, per_shard: int = 50_000_000, eos_token: str = "", min_chars: int = 1, max_chars: int = 20_000) -> StreamingQuery:
    """Appends each batch's tokens to shards in ``out_dir``.

    A batch's beginning in the token stream is written with its number before the next one may begin, so a batch that is
    run again begins at the same place and writes the same files.
    """
    out, dtype = files.absolute(out_dir), dtype_of(tokenizer.vocab_size)
    state = files.join(out, "state.json")

    def batch(rows: DataFrame, number: int) -> None:
        now = json.loads(files.read_text(state) or '{"batch": -1, "before": 0, "after": 0}')
        base = now["before"] if now["batch"] == number else now["after"]
        ids = encoded(rows, tokenizer, min_chars, max_chars, "", eos_token)
        staged = files.join(out, f"staged-{number}")
        ids.select(F.lit(0).alias("file_idx"), F.spark_partition_id().cast("bigint").alias("part"), F.monotonically_increasing_id().alias("pos"), "ids").write.mode("overwrite").parquet(staged)
        written = write_shards(in_shards(placed(rows.sparkSession.read.parquet(staged), base), per_shard), files.join(out, "shards"), np.dtype(dtype), base, per_shard)
        after = base + sum(written.values()) - (base % per_shard if base // per_shard in written else 0)
        files.write_text(state, json.dumps({"batch": number, "before": base, "after": after}))
        files.remove(staged)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
