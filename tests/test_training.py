"""Trainers against a plain recount after each merge, and their files against another library."""

import json
import random
from collections import Counter

import loomtok as lt
import pyarrow as pa
import pytest
from loomtok.operators import bpe, wordpiece
from loomtok.plans import model_file
from loomtok.plans.config import TrainConfig, TrainerKind
from loomtok.plans.training import learn


def naive_bpe(words, base, target, least):
    words, known, out = [(list(s), f) for s, f in words], set(base), []
    while len(known) < target:
        pairs = Counter()
        for s, f in words:
            for p in zip(s, s[1:]):  # noqa: B905
                pairs[p] += f
        if not pairs:
            break
        (left, right), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        out.append((left, right))
        known.add(left + right)
        words = [(bpe.merge_word(s, left, right), f) for s, f in words]
    return out


def naive_wordpiece(words, base, target, least, prefix):
    words, known, out = [(list(s), f) for s, f in words], set(base), []
    while len(known) < target:
        one, two = Counter(), Counter()
        for s, f in words:
            for x in s:
                one[x] += f
            for p in zip(s, s[1:]):  # noqa: B905
                two[p] += f
        ranked = [(-(n / (float(one[p[0]]) * float(one[p[1]]))), -n, p) for p, n in two.items() if n >= least]
        if not ranked:
            break
        left, right = min(ranked)[2]
        new = wordpiece.joined(left, right, prefix)
        if new not in known:
            known.add(new)
            out.append(new)
        words = [(wordpiece.apply(s, left, right, new), f) for s, f in words]
    return out


def random_words(seed, letters="abc", n=12):
    r = random.Random(seed)
    return [(["".join(r.choice(letters)) for _ in range(r.randint(1, 7))], r.randint(1, 6)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_driver_bpe_equals_recounting(seed):
    words = random_words(seed)
    base = {c for s, _ in words for c in s}
    assert bpe.learn_on_driver(words, base, len(base) + 15, 1 + seed % 3) == naive_bpe(words, base, len(base) + 15, 1 + seed % 3)


@pytest.mark.parametrize("seed", range(30))
def test_driver_wordpiece_equals_recounting(seed):
    words = [([c if i == 0 else "##" + c for i, c in enumerate(s)], f) for s, f in random_words(seed)]
    base = sorted({c for s, _ in words for c in s})
    assert wordpiece.learn_on_driver(words, base, len(base) + 10, 1, "##") == naive_wordpiece(words, base, len(base) + 10, 1, "##")


def test_distributed_learners_equal_the_driver(spark):
    words = [*random_words(3, "abcd", 30), (list("aaa"), 4), (list("aaaa"), 3), (list("abab"), 5)]
    df = spark.createDataFrame(words, "syms array<string>, freq bigint")
    base = {c for s, _ in words for c in s}
    assert bpe.learn_distributed(df, base, len(base) + 8, 1) == bpe.learn_on_driver(words, base, len(base) + 8, 1)
    pieces = [([c if i == 0 else "##" + c for i, c in enumerate(s)], f) for s, f in words]
    base = sorted({c for s, _ in pieces for c in s})
    df = spark.createDataFrame(pieces, "syms array<string>, freq bigint")
    assert wordpiece.learn_distributed(df, base, len(base) + 4, 1, "##") == wordpiece.learn_on_driver(pieces, base, len(base) + 4, 1, "##")


@pytest.mark.parametrize("seed", [0, 2, 5])
def test_distributed_wordpiece_equals_the_driver(spark, seed):
    words = [([c if i == 0 else "##" + c for i, c in enumerate(s)], f) for s, f in random_words(seed, "abcdefghijklmnopqrst"[: 4 + 3 * seed], 60)]
    base = sorted({c for s, _ in words for c in s})
    df = spark.createDataFrame(words, "syms array<string>, freq bigint")
    assert wordpiece.learn_distributed(df, base, len(base) + 18, 1 + seed % 2, "##") == wordpiece.learn_on_driver(words, base, len(base) + 18, 1 + seed % 2, "##")


def test_wordpiece_takes_several_merges_a_round():
    rows = [("a", "##b", 3, 0.5), ("c", "##d", 3, 0.4), ("e", "##b", 3, 0.3)]
    assert [r[:2] for r in wordpiece.independent(rows, {}, "##")] == [("a", "##b"), ("c", "##d")]
    assert len(wordpiece.independent(rows, {"ab": None}, "##")) == 1 and len(wordpiece.independent(rows, {"cd": None}, "##")) == 1
    assert len(wordpiece.independent([("##a", "##a", 3, 0.5), *rows], {}, "##")) == 1
    assert wordpiece.accept(rows[:2], {0: 0.39}) == 2 and wordpiece.accept(rows[:2], {0: 0.4}) == 1 and wordpiece.accept(rows[:1], {}) == 1


def test_accept_takes_only_what_one_by_one_would_merge():
    assert bpe.accept([("a", "b", 9), ("c", "d", 8), ("b", "c", 7)], True) == [("a", "b"), ("c", "d")]
    assert bpe.accept([("a", "a", 9), ("c", "d", 8)], True) == [("a", "a")]
    assert bpe.accept([("a", "b", 9), ("c", "d", 8), ("d", "a", 8)], True) == [("a", "b")]
    assert bpe.accept([("a", "b", 9), ("c", "d", 8)], False) == [("a", "b")]


def counted(spark, text):
    return spark.createDataFrame(list(Counter(text.split()).items()), "piece string, freq bigint")


def test_unigram_keeps_characters_and_sums_to_one(spark):
    import math

    pieces = counted(spark, "low low lower lowest newer newest wide widest " * 5 + "new")
    config = TrainConfig(trainer=TrainerKind.unigram, vocab_size=20, min_freq=1, unk_token="<unk>", special_tokens=["<unk>"])
    out = learn(pieces, config)
    assert out.tokens[0] == "<unk>" and out.scores[0] == -100.0 and len(out.tokens) == 20
    assert set("lowernstid") <= set(out.tokens)
    assert math.isclose(sum(math.exp(s) for s in out.scores[1:]), 1, rel_tol=1e-9)


def test_learning_from_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        learn(counted(spark, ""), TrainConfig())


def test_target_size_never_cuts_the_alphabet():
    assert TrainConfig(vocab_size=64).target(256) == 256
    assert TrainConfig(vocab_size=300).target(256) == 299
    assert TrainConfig(special_tokens=["<a>", "<a>"], unk_token="<u>").specials() == ["<a>", "<u>"]


@pytest.mark.parametrize("kind", list(TrainerKind))
def test_files_load_here_and_in_another_library(spark, tmp_path, kind):
    tokenizers = pytest.importorskip("tokenizers")
    data = tmp_path / "sample.jsonl"
    r = random.Random(1)
    lines = [" ".join(r.choice("low lower lowest newer newest wide widest hello token".split()) for _ in range(20)) for _ in range(30)]
    data.write_text("".join(json.dumps({"text": x}) + "\n" for x in lines))
    config = lt.TrainConfig(trainer=kind, vocab_size=300 if kind is TrainerKind.byte_bpe else 40, min_freq=1, min_pair_freq=1, output_json=str(tmp_path / "tokenizer.json"), output_vocab=str(tmp_path / "vocab.json"), output_merges=str(tmp_path / "merges.txt"), chunk_dir=str(tmp_path / "chunks"))
    out = lt.train(config, [str(data)])
    mine, other = lt.Tokenizer(config.output_json), tokenizers.Tokenizer.from_file(config.output_json)
    assert mine.vocab_size == other.get_vocab_size() == len(out.tokens)
    for line in lines[:10]:
        assert mine.encode(line) == other.encode(line, add_special_tokens=False).ids
    assert json.loads((tmp_path / "vocab.json").read_text()) == {t: i for i, t in enumerate(out.tokens)}
    assert (tmp_path / "merges.txt").exists() == (kind in (TrainerKind.byte_bpe, TrainerKind.bpe))
    if kind is TrainerKind.byte_bpe:
        assert mine.decode(mine.encode(lines[0])) == lines[0]
        assert lt.train(config, [str(data)]).merges == out.merges  # from the counts that are kept


def test_null_unk_and_prefix_load(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"type": "BPE", "unk_token": None, "continuing_subword_prefix": None, "vocab": {"a": 0, "b": 1, "ab": 5}, "merges": [["a", "b"], "a b"]}, "added_tokens": [{"id": 9, "content": "a"}], "pre_tokenizer": None}))
    model = model_file.load(str(path))
    assert model.unk_token is None and model.byte_level
    t = lt.Tokenizer(str(path))
    assert t.encode("aba") == [5, 9] and t.token_to_id("a") == 9 and t.token_to_id("zz") is None


@pytest.mark.parametrize("seed", range(6))
def test_merges_of_a_table_are_those_of_lists(seed):
    """Long words, wide counts and few letters: counts are taken anew several times, runs of a letter overlap, symbols come about twice."""
    r = random.Random(seed)
    words = [("".join(r.choice("abcd"[: 1 + seed % 4]) for _ in range(r.choice([1, 5, 400]))), r.choice([1, 3, 1000, 10**7])) for _ in range(40)]
    words = list(dict(words).items())
    base = set("abcd")
    expected = naive_bpe([(list(w), f) for w, f in words], base, 60, 2)
    table = pa.table({"piece": [w for w, _ in words], "freq": [f for _, f in words]})
    assert bpe.learn_on_driver(table, base, 60, 2) == expected == bpe.learn_on_driver([(list(w), f) for w, f in words], base, 60, 2)


def test_pieces_are_learned_from_in_little_memory():
    """The driver takes many pieces: of lists of symbols and sets of words each takes a kilobyte, in arrays a fraction."""
    import tracemalloc

    n = 100_000
    table = pa.table({"piece": [f"{k * 7919 % 1_000_003:06d}{k % 89:02d}" for k in range(n)], "freq": [2 + k % 5 for k in range(n)]})
    tracemalloc.start()
    assert len(bpe.learn_on_driver(table, set("0123456789"), 500, 2)) == 490
    assert tracemalloc.get_traced_memory()[1] < n * 600
    tracemalloc.stop()
    assert TrainConfig().driver_pieces > 4_000_000


@pytest.mark.parametrize("seed", range(3))
def test_wordpiece_of_a_table_with_many_pairs(seed):
    """Symbols with hundreds of pairs, of which many go: none of those is merged, and the scores of the rest are up to date."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz#012345"
    words = list({"".join(r.choice(letters) for _ in range(r.randint(1, 8))): r.choice([2, 2, 3, 40]) for _ in range(700)}.items())
    lists = [([c if k == 0 else "##" + c for k, c in enumerate(w)], f) for w, f in words]
    table = pa.table({"piece": [w for w, _ in words], "freq": [f for _, f in words]})
    base = wordpiece.base(table, "##")
    assert base == sorted({s for syms, _ in lists for s in syms})
    made = wordpiece.learn_on_driver(table, base, len(base) + 300, 2, "##")
    assert made == naive_wordpiece(lists, base, len(base) + 300, 2, "##")
    assert wordpiece.learn_on_driver(table, base, 10**5, 2, "##")[:300] == made
