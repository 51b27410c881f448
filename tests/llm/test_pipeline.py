"""The whole pipeline against the stages done by plain models over a small table."""

import numpy as np
import pyarrow as pa
import pytest
from loomtok.llm import packing, quality, simhash
from loomtok.llm.token_count import DEFAULT_RANKS, Counter, load_ranks

import corpus_pipeline

from . import test_line_dedup, test_pii, test_simhash

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "pii", "packing"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returns, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("steps")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_all_but_the_last_keep_the_columns(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in steps[:-1])


def test_run_equals_its_stages(spark, steps):
    names = packing.SCHEMA.replace(",", "").split()[::2]
    rows = lambda df: sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(steps[-1])


def test_stages_against_plain_models(spark, steps, field):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    posterior = {r.doc_id: r.posterior for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    docs = [d for d in docs if posterior[d[0]] >= 0.5]
    ids = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert ids(steps[0]) == sorted(docs) and docs

    docs = [(d, t) for d, t, n in test_line_dedup.brute(docs, 10) if not n or t.strip(" ")]
    assert ids(steps[1]) == sorted(docs)

    sigs, there = simhash.signatures([t for _, t in docs])
    groups, _ = test_simhash.brute_groups([d for (d, _), ok in zip(docs, there, strict=True) if ok], sigs[there], 20)
    exact = [d for d in docs if groups.get(d[0], d[0]) == d[0]]
    got = ids(steps[2])
    assert set(exact) <= set(got) and len(got) <= len(exact) + 0.1 * (len(docs) - len(exact))

    docs = [(d, test_pii.masked(field, t)[0]) for d, t in got]
    assert ids(steps[3]) == sorted(docs)

    windows = steps[4].collect()
    counter = Counter(load_ranks(DEFAULT_RANKS), 16_384, 256)
    assert sum(w.n_tokens for w in windows) == sum(len(counter.encoding.encode_ordinary(t)) for _, t in docs)
    assert {d for w in windows for d in w.doc_ids} == {d for d, _ in docs}
    for shard in {w.shard for w in windows}:
        own = sorted(docs)[shard * 1024 : (shard + 1) * 1024]
        assert sorted(w.text for w in windows if w.shard == shard) == sorted(x[4].decode() for x in packing.pack([d for d, _ in own], pa.array([t for _, t in own]), 2048, 64, counter))


def test_awkward_rows_go_through(clashing, spark, tmp_path, trained_once):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0 and np.all([w.n_tokens <= 2048 for w in docs.collect()])


def test_an_empty_table_goes_through(empty, spark, tmp_path, trained_once):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def files(spark):
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return {p.relative_to(folder).parts[0] for p in folder.rglob("*.parquet")}


def test_only_the_result_stays_in_the_shared_folder(spark, trained_once, monkeypatch):
    before = files(spark)
    corpus_pipeline.run(spark, SF)
    left = files(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith("corpus-")

    def broken(*_):
        raise RuntimeError("stage")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:3], ("broken", broken)])
    now = files(spark)
    with pytest.raises(RuntimeError, match="stage"):
        corpus_pipeline.run(spark, SF)
    assert files(spark) == now


def test_the_stage_leaves_no_pair_at_the_budget(spark, monkeypatch):
    docs = test_simhash.with_signatures(spark, monkeypatch, test_simhash.planted(400, 3, 20))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == list(range(0, 800, 2))


def test_the_stage_leaves_no_copy_without_an_id(spark):
    """Copies go among rows without a doc_id and between them and others, of which one stays."""
    a, b, c = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten", "quite another text that is alone"
    docs = spark.createDataFrame([(None, a), (9, a), (5, a + "!"), (None, b), (None, b), (None, b + "!"), (None, c), (6, "nothing of these words is in any other row here"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=repr)
    first = min([b, b + "!"], key=lambda t: docs.where(docs.text == t).select(simhash.text_hash()[0]).first()[0])
    assert got == sorted([(5, a + "!"), (None, first), (None, c), (6, "nothing of these words is in any other row here"), (None, None)], key=repr)


def test_a_row_without_an_id_connects_others(spark):
    """A chain whose ends are over the budget apart, and the row between them has no doc_id."""
    words = [f"word{k:03}" for k in range(120)]
    texts = [" ".join(words[k : k + 100]) for k in range(20)]
    sigs, _ = simhash.signatures(texts)
    far = np.bitwise_count(sigs[:, None] ^ sigs[None]).astype(int).sum(2)
    x, y, z = next((x, y, z) for x in range(20) for y in range(20) for z in range(20) if far[x, y] <= 20 and far[y, z] <= 20 and far[x, z] > 20)
    docs = spark.createDataFrame([(1, texts[x]), (None, texts[y]), (2, texts[z])], "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [1]
