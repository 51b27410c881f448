"""Encoders on hand-worked models, and the batch encoder against the one for single texts."""

import random

import loomtok as lt
import numpy as np
import pyarrow as pa
import pytest
from loomtok.functions.chars import BYTE_CHARS, WHITESPACE
from loomtok.operators.encode import Encoder, Model, encode_array, encode_column
from loomtok.plans.tokenizer import offsets, padded

BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def test_bpe_merges_the_lowest_rank_everywhere_first():
    m = Model("BPE", {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}, [("b", "c"), ("a", "b"), ("a", "bc"), ("b", "c")], byte_level=False)
    assert Encoder(m).encode("abc ab aab") == [5, 3, 0, 3]


def test_bpe_unknown_character_drops_the_piece_and_unknown_symbol_is_unk():
    m = Model("BPE", {"a": 0, "?": 1}, [("a", "b")], unk_token="?", byte_level=False)
    assert Encoder(m).encode("az a ab b") == [0, 1, 1]
    assert Encoder(Model("BPE", {"a": 0}, [("a", "b")], byte_level=False)).encode("ab a") == [0]


def test_wordpiece_longest_match():
    m = Model("WordPiece", {t: i for i, t in enumerate(["[UNK]", "un", "##aff", "##able", "a"])}, unk_token="[UNK]", byte_level=False)
    assert Encoder(m).encode("unaffable unz a") == [1, 2, 3, 0, 4]
    m.unk_token = None
    assert Encoder(m).encode("unz") == [1]


def test_unigram_best_path_and_ties():
    m = Model("Unigram", {"a": 0, "b": 1, "ab": 2}, scores=[("a", -1.0), ("b", -1.0), ("ab", -2.0)], byte_level=False)
    assert Encoder(m).encode("ab") == [2]  # equal scores: the token that begins first
    assert Encoder(m).encode("az") == []
    m.scores[2] = ("ab", -2.5)
    assert Encoder(m).encode("ab") == [0, 1]


def test_empty_vocabulary_is_an_error():
    with pytest.raises(ValueError):
        Encoder(Model("BPE", {}))


@pytest.mark.parametrize("byte_level", [True, False])
def test_arrays_equal_single_texts(byte_level):
    r = random.Random(2)
    letters = [*WHITESPACE, *"ab", "é", "漢", "😀"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(200)] + [None, "", "ab" * 500]
    vocab = BYTES if byte_level else {c: i for i, c in enumerate(["a", "b", "é", "漢", "😀", "ab"])}
    m = Model("BPE", vocab, [] if byte_level else [("a", "b")], byte_level=byte_level)
    ids, ends = encode_array(Encoder(m, 10), pa.array(texts, pa.string()), 900, 901)
    one = Encoder(m)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == ([] if t is None else [900, *one.encode(t), 901])
    sliced, ends = encode_array(Encoder(m), pa.array(texts, pa.string()).slice(3, 4))
    assert sliced.tolist() == [i for t in texts[3:7] for i in one.encode(t)]


def test_column_keeps_rows_in_any_partitioning(spark):
    df = spark.createDataFrame([(i, "x" * (i % 5) + " é") for i in range(500)] + [(None, None), (501, "")], "id bigint, text string")
    m = Model("BPE", BYTES)
    a, b = ({r.id: r.ids for r in encode_column(df.repartition(n), m, ["id"], memo=0).collect()} for n in (1, 7))
    assert a == b and a[None] is None and a[501] == [] and a[3] == list(b"xxx \xc3\xa9")


def test_batches_as_arrays(tmp_path):
    import json

    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"type": "BPE", "vocab": {**BYTES, "<e>": 256}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}}))
    t = lt.Tokenizer(str(path))
    assert t.encode("ab", "<e>", "<e>") == [256, 97, 98, 256] and t.encode("", eos_token="<e>") == [256]
    out = t.encode_batch_to_torch(["ab", "", "abc"], pad_id=7, dtype="int32")
    assert np.asarray(out["input_ids"]).tolist() == [[97, 98, 7], [7, 7, 7], [97, 98, 99]] and np.asarray(out["lengths"]).tolist() == [2, 0, 3]
    assert np.asarray(t.encode_to_torch("a", dtype="uint8")).dtype == np.uint8
    with pytest.raises(ValueError):
        t.encode("a", eos_token="nope")
    with pytest.raises(ValueError):
        t.encode_to_torch("a", dtype="float32")
    assert t.model_name == "BPE" and t.vocab_size == 257 and t.tokenizer_path == str(path)
    with pytest.raises(RuntimeError):
        lt.Tokenizer().encode("a")


def test_padding_and_offsets(spark):
    df = spark.createDataFrame([(1, 1, [1]), (1, 2, [1, 2, 3]), (2, 1, [])], "g int, k int, ids array<int>")
    assert [(r.g, r.k, r.input_ids, r.length) for r in padded(df, "g").orderBy("g", "k").collect()] == [(1, 1, [1, 0, 0], 1), (1, 2, [1, 2, 3], 3), (2, 1, [], 0)]
    df = spark.createDataFrame([(i, i // 3, i % 4) for i in range(20)], "k int, block int, length int")
    total, expected = 0, {}
    for i in range(20):
        expected[i] = total
        total += i % 4
    assert {r.k: r.doc_offset for r in offsets(df, ["k"], "block").collect()} == expected
