"""Ids of awkward and long texts decode to the same texts."""

import random

import pyarrow as pa
import pytest
from loomtok import queries
from loomtok.functions.chars import byte_encode
from loomtok.operators import encode
from loomtok.operators.encode import Encoder, Model, decode_array, decode_column, encode_column, round_trip_column

SMALL = "/root/testdata/sf0.001"


def test_awkward_texts_survive_a_round_trip(spark):
    texts = ["", " ", "the other thing", "\u00e9\u6f22\U0001f600 \x00 \ufb01", "a\u3000b\n\t c ", "then " * 50_000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ids = encode_column(rows, queries.BYTE_BPE_MODEL, ["doc_id"])
    assert {r.doc_id: len(r.ids) for r in ids.where("doc_id in (0, 2)").collect()} == {0: 0, 2: 8}  # the, " ", o, th, er, " ", th, ing
    assert {r.doc_id: r.decoded for r in decode_column(ids, queries.BYTE_BPE_MODEL, ["doc_id"]).collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("name", ["bos_eos_wrap_docs", "decode_round_trip_docs"])
def test_every_document_is_there(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_decoding_words():
    wordpiece = Encoder(Model("WordPiece", {t: i for i, t in enumerate(["[UNK]", "un", "##aff", "##able", "a"])}, unk_token="[UNK]", byte_level=False))
    assert wordpiece.encode("unaffable a zz") == [1, 2, 3, 4, 0]
    assert wordpiece.decode([1, 2, 3, 4, 0]) == "unaffable a [UNK]" and wordpiece.decode([2, 1]) == "##aff un" and wordpiece.decode([]) == ""
    unigram = Encoder(Model("Unigram", {"ab": 0, "c": 1}, scores=[("ab", -1.0), ("c", -2.0)], byte_level=False))
    assert unigram.encode("abc cab") == [0, 1, 1, 0] and unigram.decode([0, 1, 9, 1, 0]) == "abccab"


def test_a_unigram_vocabulary_without_scores_counts_tokens(tmp_path):
    """Each token scores -1 then, so that the fewest win, and of as many those whose first is found first."""
    import json

    from loomtok.plans import model_file

    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"type": "Unigram", "vocab": {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}}, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
    encoder = Encoder(model_file.load(str(path)))
    assert encoder.encode("aba abab ababa b") == [4, 2, 2, 2, 4, 1]
    assert len(encoder.encode("ababa")) == 2 and encoder.encode("abc") == []


def test_arrays_of_ids_decode_as_lists_do():
    """Cut characters, unknown, negative and added ids, null and empty lists, slices of arrays; a row that isn't UTF-8 doesn't touch its neighbours."""
    r = random.Random(4)
    plain = queries.BYTE_BPE_MODEL
    for model in (plain, Model("BPE", plain.vocab, plain.merges, added={"<x>": 900, "then": 901})):
        encoder = Encoder(model)
        for _ in range(200):
            rows = [None if r.random() < 0.1 else [r.choice([-2, 900, 901, 902, 10**6, r.randrange(len(plain.vocab))]) for _ in range(r.randrange(6))] for _ in range(r.randrange(3, 9))]
            expected = [None if x is None else encoder.decode(x) for x in rows]
            array = pa.array(rows, pa.list_(pa.int32()))
            assert decode_array(encoder, array).to_pylist() == expected and decode_array(encoder, array.slice(1, len(rows) - 2)).to_pylist() == expected[1:-1]


def test_a_round_trip_is_one_pass(spark):
    """Ids aren't rows between two passes."""
    plan = queries.decode_round_trip_docs(spark, SMALL)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInArrow") == 1
    texts = ["", "é漢\U0001f600 \x00", "a　b\n", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {x.doc_id: x.decoded for x in round_trip_column(rows, queries.BYTE_BPE_MODEL, ["doc_id"]).collect()} == dict(enumerate(texts))


def test_pieces_merged_together_are_those_merged_one_by_one():
    """Merges in any order, also of what later ones make, runs of one symbol, pieces with unknown characters, tokens that the vocabulary lacks."""
    r = random.Random(2)
    for k in range(60):
        letters = "abcé"[: 1 + k % 4]
        symbols = sorted({c for x in letters for c in byte_encode(x)})
        merges = []
        for _ in range(r.randrange(40)):
            merges.append((r.choice(symbols), r.choice(symbols)))
            symbols.append("".join(merges[-1]))
        vocab = {s: i for i, s in enumerate(dict.fromkeys(s for s in symbols if len(s) == 1 or r.random() < 0.9))} | ({"<u>": 999} if k % 2 else {})
        encoder = Encoder(Model("BPE", vocab, merges, unk_token="<u>"))
        pieces = ["".join(r.choice(letters + "x" * (r.random() < 0.05)) for _ in range(r.choice([1, 2, 5, 80]))) for _ in range(60)]
        assert encoder._bpe_many(pieces) == [encoder._bpe(byte_encode(p)) for p in pieces] == encoder.many(pieces)


@pytest.mark.parametrize("at_once", [1, 7, 16_000_000])
def test_joined_ids_are_those_of_lists(spark, monkeypatch, at_once):
    """In one pass, whatever is joined at once: null, empty and long texts, bytes of all lengths in digits."""
    monkeypatch.setattr(encode, "JOINED_BYTES", at_once)
    texts = ["", "a\t\n", None, "é漢\U0001f600 \x00", "then " * 3000, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    expected = {i: None if t is None else " ".join(map(str, [256, *t.encode(), 257])) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in encode.joined_column(rows, queries.BYTE_MODEL, ["doc_id"], bos=256, eos=257).collect()} == expected
    lists = encode_column(rows, queries.BYTE_MODEL, ["doc_id"]).where("doc_id = 4")
    assert encode.joined_column(lists.select("doc_id").join(rows, "doc_id"), queries.BYTE_MODEL, ["doc_id"]).first().ids == " ".join(map(str, lists.first().ids))
    assert "array_join" not in queries.bos_eos_wrap_docs(spark, SMALL)._jdf.queryExecution().toString()
