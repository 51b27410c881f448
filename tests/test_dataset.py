"""Dataset jobs byte by byte, their resumption, streams and the command line."""

import json
import os

import loomtok as lt
import numpy as np
import pytest
from loomtok import cli
from loomtok.functions.chars import BYTE_CHARS
from loomtok.plans.config import TokenizeArgs
from loomtok.plans.dataset import dtype_of
from loomtok.streaming import streams


@pytest.fixture
def job(tmp_path):
    model = tmp_path / "t.json"
    model.write_text(json.dumps({"model": {"type": "BPE", "vocab": {**{c: b for b, c in enumerate(BYTE_CHARS)}, "<|endoftext|>": 256}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}}))
    for name, texts in (("a", ["hello", "", "x", "wörld"]), ("b", ["river bank " * 3])):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    args = TokenizeArgs(env_file=str(tmp_path / "no.env"), tokenizer_path=str(model), out_dir=str(tmp_path / "out"), max_tokens_per_shard=8, min_chars=2)
    return args, tmp_path


def stored(folder):
    files = sorted((folder / "out/shards").iterdir())
    return [np.fromfile(f, "<u2").tolist() for f in files]


def expected(texts, size=8):
    flat = [i for t in texts for i in [*t.encode(), 256]]
    return [flat[k : k + size] for k in range(0, len(flat), size)] or [[]]


ALL = ["hello", "wörld", "river bank " * 3]


def test_shards_and_manifest(spark, job):
    args, folder = job
    meta = lt.tokenize(args, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"])
    assert stored(folder) == expected(ALL)
    assert (meta["num_docs"], meta["num_skipped"], meta["dtype"], meta["eos_id"], meta["num_reused_files"]) == (3, 1, "uint16", 256, 0)
    assert meta == json.loads((folder / "out/meta.json").read_text()) and meta["total_tokens"] == sum(s["num_tokens"] for s in meta["shards"])


def test_resume_appends_and_reuses(spark, job):
    args, folder = job
    lt.tokenize(args, [f"{folder}/a.jsonl"])
    meta = lt.tokenize(args, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"])
    assert stored(folder) == expected(ALL) and meta["num_reused_files"] == 1
    again = lt.tokenize(args, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"])
    assert stored(folder) == expected(ALL) and again["num_reused_files"] == 2
    (folder / "out/shards/train_000099.bin").write_bytes(b"left by a broken run")
    lt.tokenize(args, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"])
    assert stored(folder) == expected(ALL)
    (folder / "a.jsonl").write_text('{"text": "changed"}\n')
    assert lt.tokenize(args, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"])["num_reused_files"] == 0
    assert stored(folder) == expected(["changed", ALL[2]])
    args.min_chars = 1
    assert lt.tokenize(args, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"])["num_reused_files"] == 0
    args.eos_token = ""
    (folder / "a.jsonl").write_text('{"text": ""}\n')
    lt.tokenize(args, [f"{folder}/a.jsonl"])
    assert stored(folder) == [[]]


def test_limits(job):
    args, folder = job
    args.max_docs = 3
    with pytest.raises(ValueError):
        lt.tokenize(args, [f"{folder}/a.jsonl"])
    assert dtype_of(65_535).itemsize == 2 and dtype_of(65_536).itemsize == 4


def test_files_as_arrays(spark, job):
    args, folder = job
    out = lt.Tokenizer(args.tokenizer_path).tokenize_inputs_to_torch([f"{folder}/a.jsonl"], min_chars=2)
    assert np.asarray(out["doc_offsets"]).tolist() == [0, 5, 11] and np.asarray(out["doc_lengths"]).tolist() == [5, 6]
    assert out["num_docs"] == 2 and out["num_skipped"] == 1 and out["sources"] == [f"{folder}/a.jsonl"]


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "s.jsonl").write_text('{"text":"hello world"}\n{"text":"river bank"}\n')
    (tmp_path / ".env").write_text("VOCAB_SIZE=64\nMIN_FREQ=9\n")
    assert cli.main(["train", "s.jsonl", "--min-freq", "1", "--min-pair-freq", "1", "--chunk-dir", "chunks"]) == 0
    assert len(json.loads((tmp_path / "vocab.json").read_text())) == 257 and (tmp_path / "merges.txt").read_text() == "#version: 0.2\n"
    assert cli.main(["tokenize", "s.jsonl", "--out-dir", "o", "--eos-token", ""]) == 0
    assert json.loads((tmp_path / "o/meta.json").read_text())["total_tokens"] == 21


def test_stream_into_shards(spark, job):
    args, folder = job
    t = lt.Tokenizer(args.tokenizer_path)
    arrivals = folder / "in"
    os.makedirs(arrivals)
    for texts in (["hello"], ["wörld", ALL[2]]):
        (arrivals / f"{len(os.listdir(arrivals))}.json").write_text("".join(json.dumps({"text": x}) + "\n" for x in texts))
        q = streams.to_shards(streams.texts(spark, str(arrivals), kind="json"), t, str(folder / "out"), str(folder / "ck"), 8, "<|endoftext|>")
        q.awaitTermination(120)
    assert stored(folder) == expected(ALL)


def test_running_counts(spark, job):
    _, folder = job
    q = streams.running_counts(streams.texts(spark, f"{folder}/*.jsonl", kind="json"), False).writeStream.format("memory").queryName("counts_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.piece: r.freq for r in spark.table("counts_now").collect()} == {"hello": 1, "x": 1, "wörld": 1, "river": 3, "bank": 3}
