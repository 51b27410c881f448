"""Each query against its SQL in DuckDB; those without SQL against a small model."""

import itertools
import subprocess
import sys
from pathlib import Path

import pytest
from loomtok import queries as own

import __spark_entry__ as registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_equals_sql(spark, against_sql, name):
    against_sql(own.QUERIES[name](spark, SMALL), SMALL, own.ORACLES[name])


def test_every_query_has_sql_but_the_trainers():
    assert set(own.QUERIES) - set(own.ORACLES) == {"bpe_train", "wordpiece_train", "unigram_train"}


def test_unigram_words_have_the_best_of_all_segmentations(spark):
    scores = dict(own.UNIGRAM_MODEL.scores)
    vocab = own.UNIGRAM_MODEL.vocab
    seen = 0
    for row in own.unigram_encode_words(spark, SMALL).collect():
        word = row.piece
        if len(word) > 10:
            continue
        best = None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
            if all(p in scores for p in parts) and (best is None or sum(scores[p] for p in parts) > best[0]):
                best = (sum(scores[p] for p in parts), parts)
        assert row.ids == (" ".join(str(vocab[p]) for p in best[1]) if best else "")
        seen += 1
    assert seen > 50


def test_entry_has_rows(spark):
    out = registry.entry(spark)
    assert out.columns == ["piece", "freq"] and out.count() == 200


def test_library_stands_without_the_subpackage(tmp_path):
    """A copy without corpus_pipeline.py and the llm folders imports, and registers its own queries only."""
    import shutil

    root = Path(registry.__file__).parent
    shutil.copytree(root / "loomtok", tmp_path / "loomtok", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split("\n")[:2] == [" ".join(sorted(own.QUERIES)), " ".join(sorted(own.ORACLES))]


def test_scans_read_one_column(spark):
    plan = own.piece_counts(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "IsNotNull(text)" in plan
