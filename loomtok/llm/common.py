"""What several operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtok.sources.shared import ensure_folder as shared_folder
from loomtok.sources.shared import delete, scratch, settled, spread

__all__ = ["delete", "fresh", "on_worker", "parts", "scratch", "set_text", "settled", "shared_folder", "spread", "strings", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the corpus, or some of its columns, with work for all cores even if it is one small file."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows.select(*columns) if columns else rows)


def on_worker(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker and kept there from task to task."""
    home = sys.modules.setdefault("_loomtok_worker", types.ModuleType("_loomtok_worker")).__dict__
    if name not in home:
        home[name] = make()
    return home[name]


#: Rows whose texts are Python strings at once.
ROWS = 1000


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of ``ROWS`` rows, so that a worker holds few texts twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def strings(texts: pa.Array) -> Iterator[str | None]:
    """The values of an array of texts, ``ROWS`` at a time as Python strings."""
    for at in range(0, len(texts), ROWS):
        yield from texts.slice(at, ROWS).to_pylist()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes for no column of ``df`` to be named so, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with a new text and, where the column is there, its length in characters."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
