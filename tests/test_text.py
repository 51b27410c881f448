"""Text functions on hand-written cases, and against small models on any text."""

import random
import re

import pytest
from loomtok.functions import text as T
from loomtok.functions.chars import PYTHON_CLASS, WHITESPACE, byte_decode, byte_encode
from pyspark.sql import functions as F

CASES = [
    ("", [], []),
    (" ", [" "], []),
    ("a", ["a"], ["a"]),
    (" a", [" a"], ["a"]),
    ("a  b ", ["a", "  b", " "], ["a", "b"]),
    ("hello, world", ["hello,", " world"], ["hello,", "world"]),
    ("a\u001cb", ["a\u001cb"], ["a\u001cb"]),
    ("a​b", ["a​b"], ["a​b"]),
    ("a᠎b", ["a", "᠎b"], ["a", "b"]),
    ("a　b", ["a", "　b"], ["a", "b"]),
    ("a\x00b c", ["a\x00b", " c"], ["a\x00b", "c"]),
    ("😀 b", ["😀", " b"], ["😀", "b"]),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(c[0],) for c in CASES], "text string")


def test_pieces_and_words(rows):
    got = rows.select("text", T.byte_pieces("text").alias("p"), T.words("text").alias("w")).collect()
    assert [(r.text, r.p, r.w) for r in got] == CASES


def test_pieces_agree_with_a_model_on_any_white_space(spark):
    r = random.Random(5)
    texts = ["".join(r.choice([*WHITESPACE, "a", "é", "漢", "\x1c", "😀", "-"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    pattern, words = re.compile(f"[{PYTHON_CLASS}]*[^{PYTHON_CLASS}]+|[{PYTHON_CLASS}]+"), re.compile(f"[^{PYTHON_CLASS}]+")
    assert len(WHITESPACE) == 26
    for row in spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.byte_pieces("text").alias("p"), T.words("text").alias("w")).collect():
        assert row.p == pattern.findall(row.text) and row.w == words.findall(row.text) and "".join(row.p) == row.text


def test_byte_alphabet(spark):
    assert byte_encode(" é漢") == "ĠÃ©æ¼¢"
    texts = [" é漢", "", "\x00\x7f\xad", "😀"]
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.byte_encode("t").alias("e"), T.byte_decode(T.byte_encode("t")).alias("d")).collect():
        assert row.e == byte_encode(row.t) and row.d == row.t == byte_decode(row.e)


def test_truncation_is_by_code_point(spark):
    df = spark.createDataFrame([("😀ab",), ("x" * 20_001,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.truncate("t", 2)).collect()] == ["😀a", "xx", None, ""]
    assert [r[0] for r in df.select(F.char_length(T.truncate("t", 20_000))).collect()] == [3, 20_000, None, 0]
    assert [r[0] for r in df.select(T.long_enough("t", 3)).collect()] == [True, True, None, False]
    assert df.where(T.has_text("t")).count() == 2


def test_symbols_pairs_substrings(spark):
    df = spark.createDataFrame([("abab",), ("a",), ("",)], "t string")
    pairs = [[tuple(p) for p in r[0]] for r in df.select(T.adjacent(T.code_points("t"))).collect()]
    assert pairs == [[("a", "b"), ("b", "a"), ("a", "b")], [], []]
    assert [sorted(r[0]) for r in df.select(T.substrings("t", 3)).collect()] == [["ab", "ab", "aba", "ba", "bab"], [], []]
    assert [r[0] for r in df.select(T.continued(T.code_points("t"), "##")).collect()] == [["a", "##b", "##a", "##b"], ["a"], []]


def test_wrap_and_pad(spark):
    df = spark.createDataFrame([([1, 2],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(T.wrap("ids", 8, 9)).collect()] == [[8, 1, 2, 9], [8, 9]]
    assert [r[0] for r in df.select(T.pad("ids", 3, 7)).collect()] == [[1, 2, 7], [7, 7, 7]]
