"""Inputs and formats."""

import gzip
import http.server
import json
import lzma
import random
import threading

import pytest
from loomtok.plans.config import TrainConfig, TrainerKind, read_env, with_env
from loomtok.sources import inputs, readers

RECORDS = ['{"text": "one"}', '{"id": 1, "text": "two\\u0021"}', "", '{"text": ""}', '{"text": null}', '{"other": {"text": "no"}, "text": "three"}', '{"text": 5}', '{"text": "first", "text": "second"}', '{"text": "\\ud83d\\ude00 \\q"', "not json"]
EXPECTED = ["one", "two!", "three", "first", "😀 q"]


def read(spark, *paths, field="text"):
    rows = readers.read(spark, inputs.resolve(list(map(str, paths))), field).collect()
    return [r.text for r in sorted(rows, key=lambda r: (r.file_idx, r.part, r.pos))]


@pytest.mark.parametrize("name", ["a.jsonl", "a.ndjson", "a.jsonl.gz", "a.jsonl.xz", "a.json", "a.json.gz", "a.json.xz", "a.log"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines(spark, tmp_path, name, end):
    data = end.join(RECORDS).encode()
    path = tmp_path / name
    path.write_bytes(gzip.compress(data) if name.endswith("gz") else lzma.compress(data) if name.endswith("xz") else data)
    assert read(spark, path) == EXPECTED


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "x"}, {"n": 1}, {"text": "y"}, 3], indent=2))
    (tmp_path / "b.json").write_text('{\n"text":\n"z",\n"text":\n"again"\n}')
    assert read(spark, tmp_path / "a.json", tmp_path / "b.json") == ["x", "y", "z", "again"]
    (tmp_path / "c.json").write_text('[\n{"a":')
    with pytest.raises(Exception, match="(?i)json|expecting"):
        read(spark, tmp_path / "c.json")


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([("a", ("m1", 1)), (None, ("m2", 2)), ("", ("m3", 3)), ("b", None)], "text string, meta struct<body:string,n:int>")
    for codec in ("none", "snappy", "gzip"):
        df.coalesce(1).write.option("compression", codec).parquet(str(tmp_path / codec))
        path = next((tmp_path / codec).glob("*.parquet"))
        assert read(spark, path) == ["a", "b"]
        assert read(spark, path, field="meta.body") == read(spark, path, field="body") == ["m1", "m2", "m3"]
    with pytest.raises(ValueError):
        read(spark, path, field="n")
    with pytest.raises(ValueError):
        read(spark, path, field="absent")


def test_many_formats_keep_the_order_of_sources(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"text":"1"}\n{"text":"2"}')
    (tmp_path / "a.json").write_text('{"text":"3"}')
    assert read(spark, tmp_path / "b.jsonl", tmp_path / "a.json", tmp_path / "b.jsonl") == ["1", "2", "3"]


def test_glob_crosses_folders_and_falls_back_to_suffixes(tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    for name in ("x/a.jsonl", "x/y/b.jsonl", "x/c.json.gz"):
        (tmp_path / name).write_text("")
    short = lambda found: [p[len(str(tmp_path)) + 1 :] for p in found]
    assert short(inputs.expand(f"{tmp_path}/x*.jsonl")) == ["x/a.jsonl", "x/y/b.jsonl"]
    assert short(inputs.expand(f"{tmp_path}/x/?.jsonl")) == ["x/a.jsonl"]
    assert short(inputs.expand(f"{tmp_path}/x/c*.parquet")) == ["x/c.json.gz"]
    assert inputs.expand(f"{tmp_path}/none*") == []


def test_lists_urls_and_missing(tmp_path):
    (tmp_path / "a b.jsonl").write_text("")
    (tmp_path / "c.jsonl").write_text("")
    (tmp_path / "list.txt").write_text(f"# names\r\nc.jsonl\r\n\r\nfile://{tmp_path}/a%20b.jsonl\n{tmp_path}/c.jsonl\n")
    found = inputs.resolve(data_list=str(tmp_path / "list.txt"))
    assert [s.local_path for s in found] == [f"{tmp_path}/c.jsonl", f"{tmp_path}/a b.jsonl"]
    assert inputs.resolve(data_list=f"file://localhost{tmp_path}/list.txt") == found
    with pytest.raises(FileNotFoundError):
        inputs.resolve([f"{tmp_path}/nothing.jsonl"])
    with pytest.raises(FileNotFoundError):
        inputs.resolve()


def test_http(tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/d.jsonl").write_text('{"text": "w"}')
    (tmp_path / "web/list.txt").write_text("d.jsonl\n")

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *a):
            super().__init__(*a, directory=str(tmp_path / "web"))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Quiet)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        (one,) = inputs.resolve([f"{base}/d.jsonl"], cache_dir=str(tmp_path / "cache"))
        assert one.remote and one.local_path.endswith(".jsonl") and open(one.local_path).read() == '{"text": "w"}'
        (two,) = inputs.resolve(data_list=f"{base}/list.txt", cache_dir=str(tmp_path / "cache"))
        assert two.local_path == one.local_path
    finally:
        server.shutdown()


def test_formats():
    assert [inputs.detect(n) for n in ("a.ndjson", "a.json.xz", "a.parquet", "a.JSONL", "a")] == ["jsonl", "json_xz", "parquet", "unknown", "unknown"]


def test_env(tmp_path):
    path = tmp_path / ".env"
    path.write_text("﻿# c\nTRAINER=wordpiece\nVOCAB_SIZE = 77\nDATA_PATH=\"x y\"\nMIN_FREQ=abc\nSPECIAL_TOKENS=<a>, <b>\nRESUME=off\n", "utf-8")
    c = with_env(TrainConfig(), read_env(str(path)))
    assert (c.trainer, c.vocab_size, c.data_glob, c.min_freq, c.special_tokens, c.resume) == (TrainerKind.wordpiece, 77, "x y", 2, ["<a>", "<b>"], False)
    assert read_env(str(tmp_path / "none")) == {}


def test_lines_of_any_kind_end_no_job(spark, tmp_path):
    deep = '{"a":' + "[" * 100_000
    assert readers.line_text(deep, "text") is None
    assert readers.line_text('{"a":' + "[" * 50_000 + "]" * 50_000 + ', "text": "after"}', "text") == "after"
    assert readers.line_text('{"text": "kept", "n": ' + "9" * 10_000 + "}", "text") == "kept"
    with pytest.raises(ValueError):
        readers.document_texts("[" * 100_000, "text")
    r = random.Random(1)
    for _ in range(3000):
        line = "".join(r.choice(['"text"', '"', ":", "{", "}", "[", "]", ",", "\\", "\\u12", "\\ud800", "x", "1", " ", "null", "\x00", "é"]) for _ in range(r.randint(0, 30)))
        assert readers.line_text(line, "text") is None or isinstance(readers.line_text(line, "text"), str)
    (tmp_path / "a.jsonl").write_text(deep + '\n{"text": "next"}\n')
    assert read(spark, tmp_path / "a.jsonl") == ["next"]
