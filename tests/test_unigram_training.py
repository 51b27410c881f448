"""The Unigram trainer against a plain one, step by step."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from loomtok.operators import unigram
from loomtok.operators.unigram import Token
from loomtok.plans.config import TrainConfig, TrainerKind
from loomtok.plans.training import learn


def segmentations(word, scores):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
        if all(p in scores for p in parts):
            yield parts


@pytest.mark.parametrize("seed", range(25))
def test_segments_are_the_best_of_all(seed):
    r = random.Random(seed)
    scores = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): -r.random() * 9 for _ in range(12)}
    longest = max(map(len, scores))
    for _ in range(40):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        best = max((sum(scores[p] for p in parts) for parts in segmentations(word, scores)), default=None)
        got = unigram.segment(word, scores, longest)
        if best is None:
            assert got == [c for c in word if c in scores]
        else:
            assert "".join(got) == word and math.isclose(sum(scores[p] for p in got), best)


def test_ties_go_to_what_is_found_first():
    assert unigram.segment("ab", {"ab": -2.0, "a": -1.0, "b": -1.0}, 2) == ["ab"]
    assert unigram.segment("abc", {"ab": -1.0, "c": -1.0, "a": -1.0, "bc": -1.0}, 2) == ["a", "bc"]


def plain_learn(words, target, min_freq, longest, rounds, multiplier, ratio):
    """Seed, hard EM and pruning with lists and dictionaries only."""
    words = [(w, f) for w, f in words if f >= min_freq]
    one, more = {}, {}
    for w, f in words:
        for i in range(len(w)):
            one[w[i]] = one.get(w[i], 0) + f
            for j in range(i + 2, min(len(w), i + longest) + 1):
                more[w[i:j]] = more.get(w[i:j], 0) + f
    room = max(max(target, len(one)) * multiplier, len(one) + 32) - len(one)
    kept = sorted(more, key=lambda t: (-more[t], t))[:room]
    weight = {t: n + 1e-6 for t, n in one.items()} | {t: more[t] + 1e-6 for t in kept}
    target = max(target, len(one))
    order = lambda t: (t not in one, -weight[t], t)
    tokens = sorted(weight, key=order)

    def logs():
        total = math.fsum(weight[t] for t in tokens)
        return {t: math.log(weight[t] / total) for t in tokens}

    def cut(n):
        ranked = sorted(tokens, key=order)
        return tokens if len(tokens) <= n else [t for k, t in enumerate(ranked) if k < n or t in one]

    scores = logs()
    for k in range(rounds):
        found = dict.fromkeys(tokens, 0)
        for w, f in words:
            best = max((sum(scores[p] for p in parts), -len(parts), parts) for parts in segmentations(w, scores))
            for p in best[2]:
                found[p] += f
        weight = {t: found[t] + (1e-3 if t in one else 0) + 1e-12 for t in tokens}
        scores = logs()
        tokens = cut(target if k + 1 == rounds else max(target, math.ceil(len(tokens) * ratio)))
        scores = {t: scores[t] for t in tokens}
    tokens = cut(target)
    scores = logs()
    return {t: scores[t] for t in tokens}


@pytest.mark.parametrize("seed", range(5))
def test_training_equals_a_plain_trainer(spark, seed):
    r = random.Random(seed)
    words = {"".join(r.choice("abcd") for _ in range(r.randint(1, 7))): r.randint(1, 97) for _ in range(40)}
    got = unigram.learn(spark.createDataFrame(list(words.items()), "piece string, freq bigint"), 18, 2, 5, 3, 2, 0.75)
    want = plain_learn(list(words.items()), 18, 2, 5, 3, 2, 0.75)
    assert set(dict(got)) == set(want)
    assert all(math.isclose(s, want[t], rel_tol=1e-9) for t, s in got)
    single = [len(t) == 1 for t, _ in got]
    assert single == sorted(single, reverse=True)


def test_one_step_of_em_counts_what_the_best_segments_have(spark):
    words = {"abab": 3, "ab": 5, "ba": 2, "c": 1}
    scores = {"a": -2.0, "b": -2.0, "ab": -1.0, "c": -3.0}
    assert unigram.token_counts(spark.createDataFrame(list(words.items()), "piece string, freq bigint"), scores) == {"ab": 11, "b": 2, "a": 2, "c": 1}


def test_prune_keeps_characters_and_orders_ties():
    tokens = [Token("z", 1.0, True), Token("ab", 5.0, False), Token("aa", 5.0, False), Token("y", 0.5, True), Token("abc", 9.0, False)]
    assert [t.token for t in unigram.prune(tokens, 3)] == ["z", "y", "abc"]
    assert [t.token for t in unigram.prune(tokens, 1)] == ["z", "y"]
    assert [t.token for t in unigram.prune(tokens, 4)] == ["z", "y", "abc", "aa"]
    assert unigram.prune(tokens, 5) == tokens


@pytest.mark.parametrize("kind", [k for k in TrainerKind if k is not TrainerKind.unigram])
def test_backends_give_the_same(spark, kind):
    r = random.Random(2)
    words = {"".join(r.choice("abcdef") for _ in range(r.randint(1, 6))): r.randint(1, 30) for _ in range(80)}
    pieces = spark.createDataFrame(list(words.items()), "piece string, freq bigint")
    size = 256 + 12 if kind is TrainerKind.byte_bpe else 30
    out = [learn(pieces, TrainConfig(trainer=kind, vocab_size=size, backend=b, driver_pieces=n)) for b, n in (("driver", 0), ("distributed", 10**6), ("auto", 10**6), ("auto", 5))]
    assert all((o.tokens, o.merges, o.scores) == (out[0].tokens, out[0].merges, out[0].scores) for o in out)
    assert len(out[0].tokens) == size and set(out[0].scores) == {-1.0}


@pytest.mark.parametrize("seed", range(40))
def test_words_segmented_together_are_those_segmented_one_by_one(seed):
    """Also with equal sums, words without a segmentation, NUL and wide characters, no tokens at all; and nothing is left to the plain way but those without."""
    r = random.Random(seed)
    letters = "ab\0é\U0001f600"[: 1 + seed % 5]
    scores = {"".join(r.choice(letters) for _ in range(r.randint(1, 6))): r.choice([-1.0, -2.0, -0.1, -0.2, -0.3, r.uniform(-9, 0)]) for _ in range(r.randrange(30))}
    words = ["".join(r.choice(letters + "z" * (r.random() < 0.1)) for _ in range(r.choice([0, 1, 3, 12, 90]))) for _ in range(60)]
    freqs = np.array([r.randint(1, 10**12) for _ in words])
    trie = unigram.Trie(scores)
    into = np.zeros(len(trie.tokens), np.int64)
    failed = trie.count(words, freqs, into)
    expected, none = Counter(), []
    for k, word in enumerate(words):
        found = unigram.segment(word, scores, max(map(len, scores), default=1))
        if "".join(found) == word and (len(found) > 0 or not word):
            for token in found:
                expected[token] += int(freqs[k])
        else:
            none.append(k)
    assert {t: n for t, n in zip(trie.tokens, into.tolist()) if n} == expected and failed == none  # noqa: B905
