"""Readers: every format to (file_idx, source, part, pos, text), one row for each non-empty text."""

from __future__ import annotations

import gzip
import json
import lzma
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtok.sources import files
from loomtok.sources.inputs import InputSource, detect

SCHEMA = "file_idx int, source string, part bigint, pos bigint, text string"
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_COLON = re.compile(r"\s*:\s*")
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def unescape(body: str) -> str:
    """A JSON string's value: surrogate pairs join, a lone one becomes U+FFFD, an unknown escape keeps its character."""

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        return _ESCAPES.get(m[2], m[2])

    text = re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", one, body, flags=re.S)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _skip(text: str, at: int) -> int:
    """The place after the value at ``at``."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == '"':
            m = _STRING.match(text, at)
            if not m:
                return len(text)
            at = m.end()
        elif c in "{[":
            depth += 1
            at += 1
        elif c in "}]":
            if not depth:
                return at
            depth -= 1
            at += 1
        elif c == "," and not depth:
            return at
        else:
            at += 1
            continue
        if not depth:
            return at
    return at


def line_text(line: str, field: str) -> str | None:
    """The value of the first ``field`` met in a line of JSON, if it is a string; values of other keys are passed over.

    Brackets that fit nothing don't matter, so that lines of a larger document and broken lines can match.
    """
    try:
        obj = json.loads(line, object_pairs_hook=lambda pairs: {k: v for k, v in reversed(pairs)})
        if isinstance(obj, dict):
            value = obj.get(field)
            return unescape_lone(value) if isinstance(value, str) else None
    except (ValueError, RecursionError):  # the scan below keeps no stack
        pass
    at = 0
    while m := _STRING.search(line, at):
        after = _COLON.match(line, m.end())
        if not after:
            at = m.end()
            continue
        if unescape(m[1]) == field:
            value = _STRING.match(line, after.end())
            return unescape(value[1]) if value else None
        at = _skip(line, after.end())
    return None


def unescape_lone(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def document_texts(data: str, field: str) -> list[str]:
    """Of one JSON document, an object or an array of objects: every string under ``field``, repeated keys included."""
    try:
        pairs_of: list = json.loads(data, object_pairs_hook=lambda pairs: pairs if pairs else [("", None)])
    except RecursionError as e:
        raise ValueError("a JSON document is nested too deeply") from e
    is_object = lambda v: isinstance(v, list) and bool(v) and isinstance(v[0], tuple)
    if not isinstance(pairs_of, list):
        raise ValueError("a JSON document must be an object or an array of objects")
    items = [pairs_of] if is_object(pairs_of) else pairs_of
    return [unescape_lone(v) for item in items if is_object(item) for k, v in item if k == field and isinstance(v, str)]


def _lines(text: str, field: str) -> list[str]:
    found = (line_text(line.rstrip("\r"), field) for line in text.split("\n") if line.rstrip("\r"))
    return [t for t in found if t]


def _stream_lines(path: str, field: str) -> Iterator[str]:
    """Texts of an xz file's lines, decoded as they are read: no more than a line is held, whatever the file's size."""
    with files.opened(path) as raw, lzma.open(raw) as data:
        for line in data:
            if text := line_text(line.rstrip(b"\n").decode("utf-8", "replace").rstrip("\r"), field):
                yield text


def _open(path: str, data: bytes) -> str:
    data = gzip.decompress(data) if path.endswith(".gz") else lzma.decompress(data) if path.endswith(".xz") else data
    return data.decode("utf-8", "replace")


def _batches(rows: Iterator[tuple[int, int, int, str]], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list = []
    names = ["file_idx", "part", "pos", "text"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def leaf(schema: T.StructType, field: str) -> str:
    """The column for ``field``: the exact dotted path, else a column of that name, else the first nested one of that name."""
    flat: list[tuple[str, T.DataType]] = []

    def walk(node: T.StructType, path: str) -> None:
        for f in node.fields:
            name = f"{path}`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, name + ".")
            else:
                flat.append((name, f.dataType))

    walk(schema, "")
    plain = [(p, p.replace("`", ""), t) for p, t in flat]
    for test in (lambda d: d == field, lambda d: "." not in d and d == field, lambda d: d.rpartition(".")[2] == field):
        for quoted, dotted, kind in plain:
            if test(dotted):
                if not isinstance(kind, (T.StringType, T.BinaryType)):
                    raise ValueError(f"{dotted} isn't a string column")
                return quoted
    raise ValueError(f"no column {field}")


def arrow_schema(schema: pa.Schema) -> T.StructType:
    """As much of a file's schema as :func:`leaf` looks at."""

    def kind(t: pa.DataType) -> T.DataType:
        if pa.types.is_struct(t):
            return T.StructType([T.StructField(t.field(i).name, kind(t.field(i).type)) for i in range(t.num_fields)])
        return T.StringType() if pa.types.is_string(t) or pa.types.is_large_string(t) else T.BinaryType() if pa.types.is_binary(t) or pa.types.is_large_binary(t) else T.NullType()

    return T.StructType([T.StructField(f.name, kind(f.type)) for f in schema])


def leaves(spark: SparkSession, paths: list[str], field: str) -> dict[str, str]:
    """The column for ``field`` in each Parquet file. Footers are read by tasks, in one job, however many files there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, found, errors = b.column(0).to_pylist(), [], []
            for name in names:
                system, path = files.at(name)
                try:
                    with system.open_input_file(path) as f:
                        found.append(leaf(arrow_schema(pq.read_schema(f)), field))
                    errors.append(None)
                except ValueError as e:
                    found.append(None)
                    errors.append(f"{name}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(errors, pa.string())], ["path", "leaf", "error"])

    tasks = max(1, min(len(paths) // 16, spark.sparkContext.defaultParallelism * 4))
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInArrow(run, "path string, leaf string, error string").collect()
    if wrong := sorted(r.error for r in rows if r.error):
        raise ValueError("; ".join(wrong[:5]))
    return {r.path: r.leaf for r in rows}


def _uri(path: str) -> str:
    return "file://" + os.path.abspath(path) if "://" not in path else path


def _as_reported(spark: SparkSession, path: str) -> str:
    """A path as scans report it, without what URIs escape."""
    if "://" not in path:
        return path
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def nested(column: str) -> T.StructType:
    """A schema of one string column, which a quoted path of structs leads to."""
    names = re.findall("`([^`]*)`", column)
    kind: T.DataType = T.StringType()
    for name in reversed(names):
        kind = T.StructType([T.StructField(name, kind)])
    return kind


#: Rows of a file that are ordered, and summed over, by one task.
PART_ROWS = 65_536
#: At most this many input files are joined by broadcast; of more the list is shuffled.
BROADCAST_FILES = 200_000


def _files(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_FILES else table


def _with_index(df: DataFrame, names: dict[str, int]) -> DataFrame:
    """file_idx from the path that the scan reports."""
    key = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    known = [(_as_reported(df.sparkSession, p), i) for p, i in names.items()]
    return df.withColumn("key", key).join(_files(df.sparkSession, known, "key string, file_idx int"), "key").drop("key")


def read(spark: SparkSession, sources: list[InputSource], field: str = "text") -> DataFrame:
    """(file_idx, source, part, pos, text) of all sources; rows of a file are in order of (part, pos).

    Parquet reads only the field's column. JSON lines are split across tasks, ``part`` being the split's beginning;
    compressed files take a task each and are decoded as a stream. ``.json`` is read as lines, and if no line matches,
    as one document, so each such file is held whole by a task; large corpora belong in ``.jsonl`` or Parquet.
    """
    kinds: dict[str, dict[str, int]] = {}
    for i, s in enumerate(sources):
        kind = detect(s.local_path)
        group = "parquet" if kind == "parquet" else "whole" if kind in ("json", "json_gz", "json_xz") else "xz" if kind == "jsonl_xz" else "lines"
        kinds.setdefault(group, {})[files.absolute(s.local_path)] = i
    parts = []
    if names := kinds.get("parquet"):
        by_leaf: dict[str, dict[str, int]] = {}
        for path, column in leaves(spark, list(names), field).items():
            by_leaf.setdefault(column, {})[path] = names[path]
        for column, group in by_leaf.items():
            row = F.col("_metadata.row_index")
            scan = spark.read.schema(nested(column)).parquet(*map(_uri, group)).select(F.col("_metadata.file_path").alias("path"), F.floor(row / PART_ROWS).alias("part"), row.alias("pos"), F.col(column).cast("string").alias("text"))
            parts.append(_with_index(scan, group))
    if names := kinds.get("lines"):
        scan = spark.read.option("lineSep", "\n").text(list(map(_uri, names))).where("value != ''")
        scan = _with_index(scan.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("pos"), "value"), names)

        def scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = [line_text(v.rstrip("\r"), field) for v in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text, pa.string())], ["file_idx", "part", "pos", "text"])

        parts.append(scan.select("file_idx", "part", "pos", "value").mapInArrow(scan_lines, "file_idx int, part bigint, pos bigint, text string"))
    if names := kinds.get("whole"):
        held = _with_index(spark.read.format("binaryFile").load(list(map(_uri, names))).select("path", "content"), names).select("file_idx", "path", "content")

        def scan_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple[int, int, int, str]]:
                for b in batches:
                    for i, path, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                        text = _open(path, content)
                        found = _lines(text, field)
                        if not found and text.strip():
                            found = document_texts(text, field)
                        yield from ((i, 0, k, t) for k, t in enumerate(found))

            yield from _batches(rows())

        parts.append(held.mapInArrow(scan_files, "file_idx int, part bigint, pos bigint, text string"))
    if names := kinds.get("xz"):

        def stream_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple[int, int, int, str]]:
                for b in batches:
                    for i, path in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                        yield from ((i, k // PART_ROWS, k, t) for k, t in enumerate(_stream_lines(path, field)))

            yield from _batches(rows())

        listed = spark.createDataFrame([(i, p) for p, i in names.items()], "file_idx int, path string").repartition(min(len(names), 10_000))
        parts.append(listed.mapInArrow(stream_files, "file_idx int, part bigint, pos bigint, text string"))
    out = None
    for p in parts:
        p = p.select("file_idx", "part", "pos", "text")
        out = p if out is None else out.unionByName(p)
    labels = _files(spark, [(i, s.source) for i, s in enumerate(sources)], "file_idx int, source string")
    return out.where("text is not null and text != ''").join(labels, "file_idx").select("file_idx", "source", "part", "pos", "text")


def observed(df: DataFrame, max_chars: int = 0) -> tuple[DataFrame, Observation]:
    """``df`` and what is counted as it is read, without a scan of its own: ``records``, how many are ``truncated``, and ``chars``. There after the first action."""
    seen, chars = Observation(), F.char_length("text").cast("bigint")
    cut = F.count_if(chars > max_chars) if max_chars > 0 else F.lit(0).cast("bigint")
    return df.observe(seen, F.count("*").alias("records"), (cut if max_chars > 0 else F.max(cut)).alias("truncated"), F.sum(chars).alias("chars")), seen
