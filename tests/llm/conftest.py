import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns with the names that operators use for their results and between steps.
CLASHING = "keep string, group_id string, lines_dropped string, posterior string, votes string, n_masked string, shard string, count string, line string, pos string, key string, rep string, v string, label string, ids string, __line_dedup_k1 string, __quality_votes string, __simhash_row string"


def words(r, n):
    return " ".join("".join(r.choice(["ta", "re", "in", "so", "the", "an", "er", "lo", "mi"]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Rows of documents with nulls in each column, empty, blank and very long texts, repeated ids and repeated rows."""
    r = random.Random(4)
    long = "\n".join(words(r, 12).capitalize() + "." for _ in range(3000))
    rows = [
        (1, "The same line of text.\nand one that isn't", "en", "a", 10),
        (None, "The same line of text.", "en", "a", 10),
        (None, None, None, None, None),
        (2, None, "en", "a", None),
        (3, "", "de", None, 0),
        (4, " \n\t ", None, "b", 5),
        (5, long, "en", "b", len(long)),
        (6, "x" * 50_000, "en", "b", None),
        (7, "twice", "en", "b", 5),
        (7, "twice", "en", "b", 5),
        (8, "one id", "en", "b", 6),
        (8, "and two texts", "en", "b", 13),
        (9, "é漢😀 \x00 ﬁ", "zh", "c", 8),
        (-3, "a negative id", "en", "c", 13),
    ]
    return rows + [(100 + k, f"The same line of text.\n{words(r, 30)}.", "en", "d", 1) for k in range(14)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, DOCS)


@pytest.fixture(scope="session")
def clashing(spark, awkward_rows):
    n = len(CLASHING.split(","))
    return spark.createDataFrame([(*row, *[f"mine {k}"] * n) for k, row in enumerate(awkward_rows)], f"{DOCS}, {CLASHING}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def field():
    from loomtok.llm import pii

    return pii.train(pii.labelled_rows())


@pytest.fixture
def trained_once(field, monkeypatch):
    """Tests that call the stage again and again needn't train the same field each time."""
    from loomtok.llm import pii

    monkeypatch.setattr(pii, "fit", lambda labelled: field)
