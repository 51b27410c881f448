"""Shards are made by rank, not by the value of doc_id."""

import random

import numpy as np
import pyarrow as pa
from loomtok.llm import packing
from loomtok.llm.token_count import DEFAULT_RANKS, Counter, load_ranks

DOCS = "doc_id bigint, text string"


def windows(spark, rows, **more):
    got = packing.packing(spark.createDataFrame(rows, DOCS).repartition(5), **more).orderBy("shard", "window_no").collect()
    return [(w.shard, w.doc_ids, w.n_tokens, w.text) for w in got]


def test_sparse_ids_are_packed_as_dense_ones(spark):
    r = random.Random(3)
    texts = [f"one two {k}." for k in range(300)]
    far = sorted({r.getrandbits(64) - 2**63 for _ in range(300)})
    dense = windows(spark, list(enumerate(texts)), size=64, shard_docs=100)
    sparse = windows(spark, list(zip(far, texts)), size=64, shard_docs=100)  # noqa: B905
    assert [(s, n, t) for s, _, n, t in sparse] == [(s, n, t) for s, _, n, t in dense]
    assert [d for _, ids, *_ in sparse for d in ids] == far
    assert {s for s, *_ in sparse} == {0, 1, 2} and len(sparse) == 3 * 7


def test_negative_ids_have_no_shard_with_null(spark):
    got = windows(spark, [(-5, "a b."), (None, "c d."), (-1, "e."), (7, "f."), (-5, "A.")])
    assert [(s, ids, n) for s, ids, n, _ in got] == [(-1, [None], 3), (0, [-5, -5, -1, 7], 9)]


def test_a_repeated_id_goes_on_in_the_next_shard(spark):
    got = windows(spark, [(1, "a."), (2, "b."), (2, "c."), (2, "d."), (2, "e."), (3, "f.")], shard_docs=2)
    assert [(s, ids) for s, ids, *_ in got] == [(0, [1, 2]), (1, [2, 2]), (2, [2, 3])]


def test_hot_ids_and_equal_rows_and_rows_without_ids_are_split(spark):
    rows = [(4, "the same row.")] * 500 + [(k, f"row {k}.") for k in range(300)] + [(None, f"no id {k}.") for k in range(400)] + [(9, f"text {k}.") for k in range(300)]
    got = packing.packing(spark.createDataFrame(rows, DOCS).repartition(5), size=64, shard_docs=100).collect()
    sizes = {}
    for w in got:
        sizes[w.shard] = sizes.get(w.shard, 0) + len(w.doc_ids)
    assert sum(sizes.values()) == len(rows) and set(sizes) == {*range(-4, 0), *range(11)}
    assert max(sizes.values()) <= 220 and sorted(t for w in got for t in w.text.split("\n\n")) == sorted(t for _, t in rows)


def test_shards_grow_where_there_would_be_too_many(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_SHARDS", 4)
    rows = [(k, f"row {k}.") for k in range(103)]
    keys, nulls = packing.first_keys(spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "xxhash64(text) as h"), 10)
    assert keys[:, 0].tolist() == [0, 26, 52, 78] and nulls == 0


def test_windows_do_not_depend_on_the_batches():
    counter = Counter(load_ranks(DEFAULT_RANKS), 16_384, 256)
    texts = ["A sentence. " * k for k in range(1, 30)]
    out = packing.pack(list(range(29)), pa.array(texts), 64, 8, counter)
    odd = pa.concat_arrays([pa.array(["left out", *texts[:7]]).slice(1), pa.array(texts[7:])])
    assert np.all([w[3] <= 64 for w in out]) and out == packing.pack(list(range(29)), odd, 64, 8, counter)
    assert packing.pack(list(range(29)), pa.array(["x", *texts, "y"]).slice(1, 29), 64, 8, counter) == out
