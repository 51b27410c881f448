"""Files by URI, many small files, streams of xz, and what jobs say of themselves."""

import json
import lzma
import random
from collections import Counter

import loomtok as lt
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from loomtok.functions import buffers
from loomtok.functions.chars import BYTE_CHARS, PYTHON_CLASS, WHITESPACE
from loomtok.plans import dataset
from loomtok.plans.config import TokenizeArgs, TrainConfig
from loomtok.plans.progress import line, progress
from loomtok.sources import files, inputs, readers

from test_dataset import ALL, expected, job, stored  # noqa: F401


def test_names():
    assert files.absolute("file:///a/b%20c/") == "/a/b c" and files.absolute("s3a://bucket/x/") == "s3a://bucket/x"
    assert files.scheme("C:/x") == "" and files.scheme("hdfs://n:9000/x") == "hdfs" and files.scheme("a/b") == ""
    assert files.join("hdfs://n/x/", "y", "z") == "hdfs://n/x/y/z"


def test_files_are_written_aside_and_removed(tmp_path):
    name = f"file://{tmp_path}/deep/er/a b.txt".replace(" ", "%20")
    files.write_text(name, "é")
    files.write_text(name, "again")
    assert files.read_text(name) == "again" and files.read_text(name + "x") is None and files.exists(f"{tmp_path}/deep")
    assert [f.base_name for f in files.listed(f"file://{tmp_path}", deep=True)] == ["a b.txt"] and files.listed(f"{tmp_path}/none") == []
    files.remove(f"{tmp_path}/deep")
    files.remove(f"{tmp_path}/deep")
    assert not files.exists(f"{tmp_path}/deep")


def test_a_job_from_and_to_uris(spark, job):  # noqa: F811
    args, folder = job
    args.out_dir, args.tokenizer_path = f"file://{folder}/out", f"file://{args.tokenizer_path}"
    meta = lt.tokenize(args, [f"file://{folder}/*.jsonl"])
    assert stored(folder) == expected(ALL) and (meta["num_records"], meta["num_truncated"], meta["num_skipped"]) == (4, 0, 1)
    assert lt.tokenize(args, [f"file://{folder}/a.jsonl", f"file://{folder}/b.jsonl"])["num_reused_files"] == 2
    config = TrainConfig(vocab_size=300, min_freq=1, output_json=f"file://{folder}/m/t.json", output_vocab=f"file://{folder}/m/v.json", output_merges=f"file://{folder}/m/m.txt", chunk_dir=f"file://{folder}/chunks", max_chars_per_doc=10)
    out = lt.train(config, [f"file://{folder}/a.jsonl", f"file://{folder}/b.jsonl"])
    assert out.records == {"records": 4, "truncated": 1, "chars": 5 + 1 + 5 + len(ALL[2])}
    assert lt.train(config, [f"file://{folder}/a.jsonl", f"file://{folder}/b.jsonl"]).records == out.records
    assert lt.Tokenizer(f"file://{folder}/m/t.json").vocab_size == 257


def test_globs_of_uris_are_as_those_of_paths(tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("a.jsonl", "b.jsonl", "x/c.jsonl"):
        (tmp_path / n).write_text("")
    assert inputs.glob(f"file://{tmp_path}/*.jsonl") == inputs.glob(f"{tmp_path}/*.jsonl") == [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl", f"{tmp_path}/x/c.jsonl"]


def test_truncated_documents_are_counted(spark, job):  # noqa: F811
    args, folder = job
    args.max_chars = 6
    meta = lt.tokenize(args, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"])
    assert (meta["num_truncated"], meta["num_docs"]) == (1, 3) and stored(folder) == expected([x[:6] for x in ALL])


def test_many_small_files_take_one_job_for_their_schemas(spark, tmp_path):
    for k in range(2000):
        column = {"text": pa.array([f"t{k}"])} if k % 2 else {"meta": pa.array([{"n": k, "text": f"t{k}"}])}
        pq.write_table(pa.table(column), tmp_path / f"{k:04d}.parquet")
    sources = inputs.resolve([f"{tmp_path}/*.parquet"])
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    found = readers.leaves(spark, [s.local_path for s in sources], "text")
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before) <= 3
    assert Counter(found.values()) == {"`text`": 1000, "`meta`.`text`": 1000}
    rows = readers.read(spark, sources).collect()
    assert sorted((r.file_idx, r.text) for r in rows) == [(k, f"t{k}") for k in range(2000)]


def test_parts_of_a_parquet_file_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PART_ROWS", 10)
    pq.write_table(pa.table({"text": [str(k) for k in range(35)]}), tmp_path / "a.parquet")
    rows = readers.read(spark, inputs.resolve([f"{tmp_path}/a.parquet"])).collect()
    assert [(r.part, r.text) for r in sorted(rows, key=lambda r: (r.part, r.pos))] == [(k // 10, str(k)) for k in range(35)]


def test_xz_is_read_as_a_stream(tmp_path):
    path = tmp_path / "a.jsonl.xz"
    with lzma.open(path, "w") as f:
        for k in range(50_000):
            f.write(json.dumps({"text": f"line {k} " + "x" * 200}).encode() + b"\r\n")
    stream = readers._stream_lines(str(path), "text")
    assert next(stream).startswith("line 0 ") and sum(1 for _ in stream) == 49_999


def test_a_shard_of_another_size_is_an_error(spark, job, monkeypatch):  # noqa: F811
    args, folder = job
    seen = dataset.write_shards
    monkeypatch.setattr(dataset, "write_shards", lambda *a: {k: n - 1 for k, n in seen(*a).items()})
    with pytest.raises(RuntimeError, match="were written"):
        lt.tokenize(args, [f"{folder}/a.jsonl"])

    def short(*a):
        out = seen(*a)
        (folder / "out/shards/train_000000.bin").write_bytes(b"")
        return out

    monkeypatch.setattr(dataset, "write_shards", short)
    with pytest.raises(RuntimeError, match="hasn't the size"):
        lt.tokenize(args, [f"{folder}/a.jsonl"])


def test_progress(spark, capsys):
    assert line("x", 5, 20, 10.0) == "x: 5 of 20 tasks, 25 %, 10 s, 30 s left" and line("x", 0, 0, 0.0) == "x: 0 of 0 tasks, 0 %, 0 s"
    with progress(spark, "slow", 50):
        spark.sparkContext.parallelize(range(4), 4).map(lambda _: __import__("time").sleep(0.5)).collect()
    assert "slow: " in capsys.readouterr().err
    with progress(spark, "silent", 0):
        pass
    assert capsys.readouterr().err == ""


@pytest.mark.parametrize("words", [False, True])
def test_pieces_in_buffers_are_those_of_the_expression(words, monkeypatch):
    import re

    pattern = re.compile(f"[^{PYTHON_CLASS}]+" if words else f"[{PYTHON_CLASS}]*[^{PYTHON_CLASS}]+|[{PYTHON_CLASS}]+")
    monkeypatch.setattr(buffers, "BLOCK_BYTES", 40)
    r = random.Random(7)
    letters = [*WHITESPACE, *"ab é漢😀\x1c\u200b", "ab", "  "]
    for _ in range(200):
        texts = [None if r.random() < 0.1 else "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 12, 60]))) for _ in range(r.randint(0, 8))]
        array = pa.array(["left out", *texts, "left out too"], pa.string()).slice(1, len(texts))
        got = Counter()
        for pieces, numbers in buffers.counted(array, words):
            for p, n in zip(pieces.to_pylist(), numbers.to_pylist(), strict=True):
                got[p] += n
        assert got == Counter(p for t in texts if t for p in pattern.findall(t))


def test_ids_of_files_are_of_the_type_asked_for(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"model": {"type": "BPE", "vocab": {c: b for b, c in enumerate(BYTE_CHARS)}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}}))
    (tmp_path / "a.jsonl").write_text('{"text": "no"}\n')
    t = lt.Tokenizer(str(tmp_path / "t.json"))
    out = t.tokenize_inputs_to_torch([f"{tmp_path}/a.jsonl"], min_chars=3, dtype="int32")
    assert np.asarray(out["token_ids"]).tolist() == [] and np.asarray(out["doc_offsets"]).tolist() == [0] and out["num_skipped"] == 1
    out = t.tokenize_inputs_to_torch([f"{tmp_path}/a.jsonl"], dtype="int32")
    assert np.asarray(out["token_ids"]).tolist() == [110, 111] and np.asarray(out["token_ids"]).dtype == np.int32


def test_options_without_effect_are_taken(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "some text"}\n')
    config = TrainConfig(vocab_size=300, min_freq=1, pair_max_entries=5, output_json=str(tmp_path / "t.json"), output_vocab=str(tmp_path / "v.json"), output_merges=str(tmp_path / "m.txt"), chunk_dir=str(tmp_path / "c"))
    with pytest.warns(UserWarning, match="pair_max_entries"):
        lt.train(config, [f"{tmp_path}/a.jsonl"])
    assert TokenizeArgs().max_docs == 0
