"""Dataset jobs: files to token shards of a fixed size, with a manifest by which a later run goes on."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtok.functions import text as T
from loomtok.plans.config import TokenizeArgs, data_from_env
from loomtok.plans.tokenizer import Tokenizer
from loomtok.plans.progress import progress
from loomtok.sources import files, inputs, readers


def dtype_of(vocab_size: int) -> np.dtype:
    return np.dtype("<u2") if vocab_size <= 65_535 else np.dtype("<u4")


def signature(args: TokenizeArgs, bos: int | None, eos: int | None, dtype: np.dtype) -> str:
    """What a finished file depends on, the model's bytes included."""
    digest = hashlib.sha256(files.read_bytes(args.tokenizer_path)).hexdigest()
    return json.dumps({"tokenizer": digest, "text_field": args.text_field, "min_chars": args.min_chars, "max_chars": args.max_chars, "bos": bos, "eos": eos, "bytes": dtype.itemsize, "per_shard": args.max_tokens_per_shard}, sort_keys=True)


def read_completed(path: str, sign: str) -> list[dict]:
    """The finished files of an earlier run with the same signature, in the order of their tokens; else none."""
    lines = (files.read_text(path) or "").splitlines()
    return [json.loads(x) for x in lines[1:]] if lines and lines[0] == sign else []


def pending(inputs: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """What of ``inputs`` isn't ``done``: with the same values in the columns ``by``. Null is no value, and never done."""
    return inputs.join(done.select(*by).distinct(), by, "left_anti")


def file_totals(encoded: DataFrame, by: str = "file_idx") -> DataFrame:
    """(by, docs, skipped, truncated, tokens) of encoded documents (by, cut, ids); the ids of a skipped one are null."""
    return encoded.groupBy(by).agg(
        F.count("ids").alias("docs"),
        F.count_if(F.col("ids").isNull()).alias("skipped"),
        F.count_if(F.col("ids").isNotNull() & F.col("cut")).alias("truncated"),
        F.coalesce(F.sum(F.when(F.col("ids").isNotNull(), F.size("ids"))), F.lit(0)).cast("bigint").alias("tokens"),
    )


def kept_text(rows: DataFrame, min_chars: int, max_chars: int) -> DataFrame:
    """``rows`` with text null where it is too short, and else truncated, which ``cut`` tells."""
    long = T.long_enough("text", min_chars)
    cut = F.char_length("text") > max_chars if max_chars > 0 else F.lit(False)
    return rows.withColumn("cut", cut).withColumn("text", F.when(long, T.truncate("text", max_chars)))


def placed(encoded: DataFrame, base: int) -> DataFrame:
    """``encoded`` (file_idx, part, pos, ids) with start, the place of a document's first token in the whole stream.

    Sums run over documents within a part of a file, and over parts; the latter are as many as the scan has splits.
    """
    sized = encoded.withColumn("n", F.size("ids").cast("bigint"))
    parts = sized.groupBy("file_idx", "part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("file_idx", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("file_idx", "part", (before + base).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("file_idx", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("inside", inside).join(starts, ["file_idx", "part"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def in_shards(docs: DataFrame, per_shard: int) -> DataFrame:
    """(shard, at, ids): documents cut where a shard is full; ``at`` is the place within the shard."""
    some = docs.where("n > 0")
    first, last = F.floor(F.col("start") / per_shard), F.floor((F.col("start") + F.col("n") - 1) / per_shard)
    rows = some.withColumn("shard", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    low = F.greatest(F.col("shard") * per_shard, F.col("start"))
    high = F.least((F.col("shard") + 1) * per_shard, F.col("start") + F.col("n"))
    ids = F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    return rows.select("shard", (low - F.col("shard") * per_shard).alias("at"), ids.alias("ids"))


def write_shards(rows: DataFrame, folder: str, dtype: np.dtype, base: int, per_shard: int) -> dict[int, int]:
    """Writes each shard's file, and returns the tokens of each. A file is written aside and then renamed, so that a
    repeated or lost task leaves no half of one; the shard in which an earlier run stopped keeps its first tokens."""
    code = dtype.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        kind, out, shard, count = np.dtype(code), None, None, 0
        done: list[tuple[int, int]] = []

        def close() -> None:
            if out is not None:
                out.close()
                files.renamed(aside(shard), name(shard))
                done.append((shard, count))

        def name(k: int) -> str:
            return files.join(folder, f"train_{k:06d}.bin")

        def aside(k: int) -> str:
            return f"{name(k)}.{task.taskAttemptId() if task else 0}.part"

        for batch in batches:
            ids = batch.column(2)
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k != shard:
                    close()
                    shard, count = k, 0
                    out = files.created(aside(k))
                    if k == base // per_shard and base % per_shard:
                        with files.opened(name(k)) as old:
                            left = base % per_shard * kind.itemsize
                            while left and (block := old.read(min(left, 1 << 24))):
                                out.write(block)
                                left -= len(block)
                        count = base % per_shard
                part = flat[offsets[i] : offsets[i + 1]]
                if kind.itemsize == 2 and len(part) and part.max() > 65_535:
                    raise ValueError("an id doesn't fit 16 bits")
                out.write(part.astype(kind).tobytes())
                count += len(part)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], ["shard", "tokens"])

    files.make_folder(folder)
    sorted_rows = rows.repartition("shard").sortWithinPartitions("shard", "at").select("shard", "at", "ids")
    return {r.shard: r.tokens for r in sorted_rows.mapInArrow(run, "shard bigint, tokens bigint").collect()}


def tokenize(args: TokenizeArgs, inputs_: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Encodes files into ``out_dir/shards`` and returns what it writes to ``meta.json``.

    Order is that of the sources and of the documents in them, whatever the cluster. With ``resume``, files that an
    earlier run with the same signature finished are left out if their size and time are the same; new ones follow.
    If one of them has changed, or isn't asked for now, the shards are made anew. The manifest is written last:
    what a broken run leaves behind is cut off by the next one. ``out_dir`` must be a folder that executors share, a path or
    a URI. The input is read once: what is skipped and truncated is counted from what is encoded.
    """
    if args.max_docs:
        raise ValueError("max_docs isn't supported")
    args = data_from_env(copy.copy(args))
    if inputs_:
        args.input_entries = list(inputs_)
    spark = spark or SparkSession.builder.getOrCreate()
    tokenizer = Tokenizer(args.tokenizer_path)
    bos, eos = tokenizer.special_id(args.bos_token), tokenizer.special_id(args.eos_token)
    dtype = dtype_of(tokenizer.vocab_size)
    sources = inputs.resolve(args.input_entries, args.data_glob, args.data_list, inputs.cache_for(spark))
    out = files.absolute(args.out_dir)
    shards, manifest = files.join(out, "shards"), files.join(out, "cache", "completed.list")
    sign = signature(args, bos, eos, dtype)
    now = {s.normalized_id: s for s in sources}
    done = read_completed(manifest, sign) if args.resume else []
    if any((s := now.get(d["id"])) is None or (s.file_size, s.file_mtime) != (d["size"], d["mtime"]) for d in done):
        done = []
    if not done:
        files.remove(manifest)
        files.remove(shards)
    files.make_folder(shards)
    base, per = sum(d["tokens"] for d in done), args.max_tokens_per_shard
    finished = {d["id"] for d in done}
    todo = [s for s in sources if s.normalized_id not in finished]
    fresh: list[dict] = []
    if todo:
        staged = files.join(out, "cache", "encoded")
        with progress(spark, "tokenize", 1000 if args.prescan_records else 0):
            kept = kept_text(readers.read(spark, todo, args.text_field), args.min_chars, args.max_chars)
            tokenizer.encode_frame(kept, ["file_idx", "part", "pos", "cut"], "text", args.bos_token, args.eos_token, args.cache_max_entries).write.mode("overwrite").parquet(staged)
            encoded = spark.read.parquet(staged)
            sums = {r.file_idx: r for r in file_totals(encoded).collect()}
            none = {"docs": 0, "skipped": 0, "truncated": 0, "tokens": 0}
            for i, s in enumerate(todo):
                found = {k: sums[i][k] for k in none} if i in sums else none
                fresh.append({"id": s.normalized_id, "size": s.file_size, "mtime": s.file_mtime, **found})
            expected = sum(f["tokens"] for f in fresh)
            written = write_shards(in_shards(placed(encoded.where("ids is not null"), base), per), shards, dtype, base, per)
        got = sum(written.values()) - (base % per if expected and base // per in written else 0)
        if got != expected:
            raise RuntimeError(f"{got} tokens were written, {expected} were encoded")
        files.remove(staged)
    records = [*done, *fresh]
    total = sum(r["tokens"] for r in records)
    count = max(1, -(-total // per))
    there = {f.base_name: f.size for f in files.listed(shards)}
    for old in there:
        if old.startswith("train_") and (not old.endswith(".bin") or int(old[6:-4]) >= count):
            files.remove(files.join(shards, old))
    if not total:
        files.created(files.join(shards, "train_000000.bin")).close()
        there["train_000000.bin"] = 0
    sizes = [min(per, total - k * per) for k in range(count)]
    for k, n in enumerate(sizes):
        if there.get(f"train_{k:06d}.bin") != n * dtype.itemsize:
            raise RuntimeError(f"shard {k} hasn't the size that the manifest says")
    meta = {
        "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "tokenizer_path": args.tokenizer_path,
        "text_field": args.text_field,
        "data_glob": args.data_glob,
        "data_list": args.data_list or None,
        "num_input_files": len(sources),
        "input_files": [s.source for s in sources],
        "vocab_size": tokenizer.vocab_size,
        "dtype": "uint16" if dtype.itemsize == 2 else "uint32",
        "eos_token": args.eos_token or None,
        "eos_id": eos,
        "bos_token": args.bos_token or None,
        "bos_id": bos,
        "max_tokens_per_shard": per,
        "max_memory_mb": args.max_memory_mb,
        "num_docs": sum(r["docs"] for r in records),
        "num_skipped": sum(r["skipped"] for r in records),
        "num_truncated": sum(r["truncated"] for r in records),
        "num_records": sum(r["docs"] + r["skipped"] for r in records),
        "total_tokens": total,
        "shards": [{"file": f"shards/train_{k:06d}.bin", "num_tokens": n} for k, n in enumerate(sizes)],
        "num_reused_files": len(done),
        "layout": {"shards": "shards", "completed": "cache/completed.list"},
    }
    files.write_text(manifest, "\n".join([sign, *(json.dumps(r, sort_keys=True) for r in records)]) + "\n")
    files.write_text(files.join(out, "meta.json"), json.dumps(meta, ensure_ascii=False, indent=2) + "\n")
    return meta
