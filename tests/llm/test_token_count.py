import random

import pytest
from loomtok.llm import queries
from loomtok.llm.token_count import DEFAULT_RANKS, Counter, load_ranks, stable, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(DEFAULT_RANKS)


@pytest.fixture(scope="module")
def whole(ranks):
    encoding = Counter(ranks, 100, 10).encoding
    return lambda text: len(encoding.encode_ordinary(text))


def test_query_equals_encoding_whole_texts(spark, documents, whole):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op7_token_counts(spark, SF).collect()
    assert len(rows) == len(texts) and max(r.n_chunks for r in rows) > 1
    assert all(r.n_tokens == whole(texts[r.doc_id]) for r in rows)


@pytest.mark.parametrize("chunk,overlap", [(2, 1), (7, 3), (40, 8), (200, 20)])
def test_splices_change_no_count(ranks, whole, chunk, overlap):
    r = random.Random(chunk)
    letters = ["the ", "a", " ", "  ", "\n", "é", "漢字", "😀", "1", "'s", "'", ".", " word", "x" * 30, " ", "　"]
    counter = Counter(ranks, chunk, overlap)
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert counter.count(text)[0] == whole(text), repr(text)


def test_overlaps_widen_where_nothing_is_stable(ranks, whole):
    text = "words of a text " * 10 + "x" * 900 + " and more words " * 10
    n, chunks, widened = Counter(ranks, 128, 16).count(text)
    assert n == whole(text) and widened > 0 and chunks > 2
    assert Counter(ranks, 64, 8).count("漢" * 1000)[0] == whole("漢" * 1000)


def test_stable_places(ranks):
    import regex
    from loomtok.llm.token_count import PATTERN

    r = random.Random(6)
    for _ in range(2000):
        text = "".join(r.choice(["a", " ", "b'", "s", "\n", "1", ".", "é", " "]) for _ in range(12))
        cuts = {m.start() for m in regex.finditer(PATTERN, text)}
        assert all(k in cuts for k in range(len(text)) if stable(text, k))


def test_bounds(ranks):
    for chunk, overlap in ((10, 10), (10, 0)):
        with pytest.raises(ValueError):
            Counter(ranks, chunk, overlap)


def test_awkward_rows(clashing, awkward_rows, whole, empty):
    rows = token_counts(clashing).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(x[0], whole(x[1] or "")) for x in awkward_rows]
    assert all((r.n_chunks == 0) == (not x[1]) for r, x in zip(rows, awkward_rows, strict=True))
    assert token_counts(empty).count() == 0


def test_long_runs_of_white_space(spark):
    texts = ["a" + " " * 3_000_000 + "b.", " " * 1_200_000, "x\n" + "\t" * 1_500_000]
    rows = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    counter = Counter(load_ranks(DEFAULT_RANKS), 16_384, 256)
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(counter.ids(t)) for k, t in enumerate(texts)}
