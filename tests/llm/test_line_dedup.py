from collections import defaultdict

import pytest
from loomtok.llm import line_dedup, queries

SF = "/root/testdata/sf0.01"


def norm(line):
    import re

    return re.sub("[ \\t\\r\\f\\x0b\\xa0]+", " ", line).strip(" ").lower()


def brute(rows, max_docs, keep_first=True):
    """(doc_id, text, dropped) of each row."""
    docs, first = defaultdict(set), {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                docs[norm(line)].add(doc)
    first = {k: min((d for d in v if d is not None), default=None) for k, v in docs.items()}
    out = []
    for doc, text in rows:
        if not text:
            out.append((doc, text, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not norm(x) or len(docs[norm(x)]) <= max_docs or (keep_first and first[norm(x)] == doc)]
        out.append((doc, "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r.lines_dropped) for r in df.collect()), key=repr)


def test_query_equals_sql(spark, against_sql):
    against_sql(queries.op1_line_dedup(spark, SF), SF, queries.ORACLES["op1_line_dedup"])


@pytest.mark.parametrize("keep_first", [True, False])
def test_awkward_rows(awkward, awkward_rows, keep_first):
    out = line_dedup.line_dedup(awkward, 10, keep_first)
    assert got(out) == brute([r[:2] for r in awkward_rows], 10, keep_first)
    assert out.where("lines_dropped > 0").count() == (15 if keep_first else 16)
    assert out.where("n_chars != char_length(text)").isEmpty()


@pytest.mark.parametrize("documents,expected", [(10, 0), (11, 10)])
def test_the_threshold_is_more_than(spark, documents, expected):
    df = spark.createDataFrame([(k, f"Shared  line\nown {k}") for k in range(documents)], "doc_id bigint, text string")
    assert line_dedup.line_dedup(df, 10).where("lines_dropped > 0").count() == expected


def test_a_join_that_shuffles_gives_the_same(awkward, monkeypatch):
    expected = got(line_dedup.line_dedup(awkward, 3))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert got(line_dedup.line_dedup(awkward, 3)) == expected


def test_clashing_columns_and_stage(clashing, awkward_rows):
    out = line_dedup.stage(clashing, 10)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert {r.lines_dropped for r in rows} == {f"mine {k}" for k in range(len(awkward_rows)) if k != 1}  # its only line stands in document 1
    assert all(r["__line_dedup_k1"] == r.lines_dropped for r in rows)
    assert line_dedup.line_dedup(clashing, 10).schema["lines_dropped"].dataType.simpleString() == "bigint"


def test_empty_table(empty):
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.stage(empty).columns == empty.columns
