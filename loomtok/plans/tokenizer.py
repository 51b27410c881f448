"""The interactive tokenizer: single texts, batches and files, as lists, arrays or tensors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtok.functions import text as T
from loomtok.operators.encode import Encoder, Model, encode_column
from loomtok.plans import model_file
from loomtok.sources import inputs, readers

_DTYPES = {"int16": np.int16, "short": np.int16, "int32": np.int32, "int": np.int32, "int64": np.int64, "long": np.int64, "uint8": np.uint8}


def _tensor(values: np.ndarray, dtype: str):
    """A torch tensor where torch is installed, else the numpy array."""
    if dtype not in _DTYPES:
        raise ValueError(f"unsupported dtype {dtype}")
    values = values.astype(_DTYPES[dtype])
    try:
        import torch
    except ModuleNotFoundError:
        return values
    return torch.from_numpy(values)


class Tokenizer:
    """A trained model. One instance isn't for several threads: its memo of pieces changes."""

    def __init__(self, tokenizer_path: str | None = None) -> None:
        self._path, self._encoder = "", None
        if tokenizer_path:
            self.load(tokenizer_path)

    def load(self, tokenizer_path: str) -> None:
        self._encoder = Encoder(model_file.load(tokenizer_path))
        self._path = tokenizer_path

    @property
    def _ready(self) -> Encoder:
        if self._encoder is None:
            raise RuntimeError("no tokenizer is loaded")
        return self._encoder

    @property
    def model(self) -> Model:
        return self._ready.model

    @property
    def tokenizer_path(self) -> str:
        return self._path

    @property
    def vocab_size(self) -> int:
        return len(self._ready.vocab)

    @property
    def model_name(self) -> str:
        return self._ready.model.kind

    def token_to_id(self, token: str) -> int | None:
        return self._ready.vocab.get(token)

    def special_id(self, token: str) -> int | None:
        """The id of a configured token; none for an empty name, an error for an unknown one."""
        if not token:
            return None
        if (found := self.token_to_id(token)) is None:
            raise ValueError(f"token {token!r} isn't in the vocabulary")
        return found

    def encode(self, text: str, bos_token: str = "", eos_token: str = "", reset_cache: bool = False) -> list[int]:
        if reset_cache:
            self._ready.memo.clear()
        bos, eos = self.special_id(bos_token), self.special_id(eos_token)
        return [bos] * (bos is not None) + self._ready.encode(text) + [eos] * (eos is not None)

    def encode_batch(self, texts: list[str], bos_token: str = "", eos_token: str = "", reset_cache: bool = False) -> list[list[int]]:
        if reset_cache:
            self._ready.memo.clear()
        return [self.encode(t, bos_token, eos_token) for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self._ready.decode(ids)

    def encode_to_torch(self, text: str, bos_token: str = "", eos_token: str = "", dtype: str = "int64", reset_cache: bool = False):
        return _tensor(np.array(self.encode(text, bos_token, eos_token, reset_cache), np.int64), dtype)

    def encode_batch_to_torch(self, texts: list[str], bos_token: str = "", eos_token: str = "", pad_id: int = 0, dtype: str = "int64", reset_cache: bool = False) -> dict:
        """input_ids, filled up on the right to the longest, and lengths."""
        rows = self.encode_batch(texts, bos_token, eos_token, reset_cache)
        lengths = np.array([len(r) for r in rows], np.int64)
        ids = np.full((len(rows), int(lengths.max(initial=0))), pad_id, np.int64)
        for k, r in enumerate(rows):
            ids[k, : len(r)] = r
        return {"input_ids": _tensor(ids, dtype), "lengths": _tensor(lengths, "int64")}

    def encode_frame(self, df: DataFrame, keep: list[str], text: str = "text", bos_token: str = "", eos_token: str = "", memo: int = 50_000) -> DataFrame:
        """The columns ``keep`` and ids of each text of a DataFrame, in parallel."""
        return encode_column(df, self.model, keep, text, memo, self.special_id(bos_token), self.special_id(eos_token))

    def tokenize_inputs_to_torch(self, inputs_: list[str], text_field: str = "text", min_chars: int = 1, max_chars: int = 20_000, bos_token: str = "", eos_token: str = "", dtype: str = "int64", reset_cache: bool = False) -> dict:
        """token_ids of all documents in order, doc_offsets, doc_lengths, num_docs, num_skipped and sources.

        The result is held by the driver, as one Arrow column; :func:`offsets` sums up lengths of what stays distributed.
        """
        spark = SparkSession.builder.getOrCreate()
        if reset_cache:
            self._ready.memo.clear()
        sources = inputs.resolve(inputs_, cache_dir=inputs.cache_for(spark))
        kept = readers.read(spark, sources, text_field).withColumn("text", F.when(T.long_enough("text", min_chars), T.truncate("text", max_chars)))
        ids = self.encode_frame(kept, ["file_idx", "part", "pos"], "text", bos_token, eos_token).orderBy("file_idx", "part", "pos").select("ids").toArrow().column(0)
        docs = ids.drop_null().combine_chunks()
        bounds = docs.offsets.to_numpy() - docs.offsets[0].as_py() if len(docs) else np.zeros(1, np.int64)
        return {
            "token_ids": _tensor(docs.flatten().to_numpy(), dtype),
            "doc_offsets": _tensor(bounds, "int64"),
            "doc_lengths": _tensor(np.diff(bounds), "int64"),
            "num_docs": len(docs),
            "num_skipped": ids.null_count,
            "sources": [s.source for s in sources],
        }


def token_ids(df: DataFrame, model: Model, column: str) -> DataFrame:
    """``df`` with id (bigint): that of the token in ``column``, null for what the vocabulary hasn't. The vocabulary is broadcast."""
    known = df.sparkSession.createDataFrame([(t, i) for t, i in {**model.vocab, **model.added}.items()], "__token string, id bigint")
    return df.join(F.broadcast(known), F.col(column) == F.col("__token"), "left").drop("__token")


def padded(ids: DataFrame, group: str, pad_id: int = 0, column: str = "ids") -> DataFrame:
    """``ids`` with input_ids, filled up to the longest of its ``group``, and length."""
    longest = F.max(F.size(column)).over(Window.partitionBy(group))
    return ids.withColumn("input_ids", T.pad(column, longest, pad_id)).withColumn("length", F.size(column))


def offsets(ids: DataFrame, order: list[str], block: str, length: str = "length") -> DataFrame:
    """``ids`` with doc_offset, the tokens before each document in ``order``; ``block`` is a column that leads the order.

    Sums run in two levels, within a block and over blocks, so that no task sees all documents.
    """
    totals = ids.groupBy(block).agg(F.sum(length).alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(block, before.alias("__before"))
    inside = F.coalesce(F.sum(length).over(Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ids.withColumn("__inside", inside).join(starts, block).withColumn("doc_offset", (F.col("__inside") + F.col("__before")).cast("bigint")).drop("__inside", "__before")
