"""Unigram: a seed of substrings, hard EM with Viterbi over distributed words, pruning between rounds."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtok.operators import counts


#: What a seed weighs besides its count.
SPARE = 1e-6


@dataclass
class Token:
    token: str
    weight: float
    required: bool
    logp: float = 0.0


def normalise(tokens: list[Token]) -> None:
    total = math.fsum(t.weight if t.weight > 0 else 1e-12 for t in tokens) or float(len(tokens))
    for t in tokens:
        t.weight = t.weight if t.weight > 0 else 1e-12
        t.logp = math.log(t.weight / total) if t.weight / total > 0 else math.log(1e-12)


def normalised(seeds: DataFrame) -> DataFrame:
    """``seeds`` (token, freq, ...) with weight and logp: the log of each one's share, each weighing a little more than its count.

    The table has the size of a vocabulary, whatever the data. The sum is one of integers, and so in any order the same.
    """
    every = Window.partitionBy()
    total = F.sum("freq").over(every) + F.count("*").over(every) * F.lit(SPARE)
    return seeds.withColumn("weight", F.col("freq") + F.lit(SPARE)).withColumn("logp", F.log(F.col("weight") / total))


def order(t: Token) -> tuple:
    return (not t.required, -t.weight, t.token)


def prune(tokens: list[Token], keep: int) -> list[Token]:
    """The ``keep`` best, required ones first and all of them."""
    if len(tokens) <= keep:
        return tokens
    ranked = sorted(tokens, key=order)
    return [t for k, t in enumerate(ranked) if k < keep or t.required]


def segment(word: str, scores: dict[str, float], longest: int) -> list[str]:
    """The best segmentation. Of equal ones that whose last token begins first; without any, the characters that are tokens."""
    n = len(word)
    best = [0.0, *[-math.inf] * n]
    source = [0] * (n + 1)
    for i in range(n):
        if best[i] == -math.inf:
            continue
        for j in range(min(n, i + longest), i, -1):
            score = scores.get(word[i:j])
            if score is not None and best[i] + score > best[j]:
                best[j], source[j] = best[i] + score, i
    if best[n] == -math.inf:
        return [c for c in word if c in scores]
    out = []
    while n:
        out.append(word[source[n] : n])
        n = source[n]
    return out[::-1]


#: Tokens up to so many characters go into a :class:`Trie`; words that are segmented together.
TRIE_LONGEST, TOGETHER = 64, 20_000


class Trie:
    """Tokens by their characters, as arrays: edges in order of their keys, a key being a node and in the low 21 bits a character; node 0 is the root."""

    def __init__(self, scores: dict[str, float]) -> None:
        tokens = [t for t in scores if t]
        self.scores = np.array([scores[t] for t in tokens])
        self.tokens = tokens
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.longest = int(size.max(initial=1))
        points = np.array(tokens, f"U{self.longest}").view(np.uint32).reshape(len(tokens), self.longest)
        node, nodes, keys = np.zeros(len(tokens), np.int64), 1, []
        for depth in range(self.longest):
            on = np.flatnonzero(size > depth)
            found, k = np.unique(node[on] << 21 | points[on, depth], return_inverse=True)
            keys.append(found)
            node[on] = nodes + k
            nodes += len(found)
        keys = np.concatenate(keys) if len(tokens) else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], order + 1
        self.token = np.full(nodes, -1, np.int64)
        self.token[node] = np.arange(len(tokens))

    def count(self, words: list[str], freqs: np.ndarray, into: np.ndarray) -> list[int]:
        """Adds to ``into`` how often each token stands in the best segmentations, those of :func:`segment`; which words have none."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size)
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        left, right, via = [], [], []
        for depth in range(self.longest):
            there = at + depth < ends[word[at]]
            at, node = at[there], node[there]
            if not len(at) or not len(self.keys):
                break
            key = node << 21 | points[at + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[k] == key
            at, node = at[there], self.child[k[there]]
            token = self.token[node]
            left.append(at[token >= 0])
            right.append(at[token >= 0] + depth + 1)
            via.append(token[token >= 0])
        left, right, via = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, via))
        # a word of n characters has n + 1 places
        left, right = left + word[left], right + word[left]
        first = ends - size + np.arange(len(words))
        best, source, by = np.full(len(points) + len(words), -math.inf), np.zeros(len(points) + len(words), np.int64), np.zeros(len(points) + len(words), np.int64)
        best[first] = 0.0
        offset = left - np.repeat(first, size + 1)[left]
        order = np.argsort(offset, kind="stable")
        for rows in np.split(order, np.cumsum(np.bincount(offset))[:-1]) if len(order) else []:
            i, j = left[rows], right[rows]
            score = best[i] + self.scores[via[rows]]
            better = score > best[j]
            j = j[better]
            best[j], source[j], by[j] = score[better], i[better], via[rows][better]
        cur = first + size
        none = np.isneginf(best[cur])
        on = np.flatnonzero(~none & (size > 0))
        while len(on):
            np.add.at(into, by[cur[on]], freqs[on])
            cur[on] = source[cur[on]]
            on = on[cur[on] > first[on]]
        return np.flatnonzero(none).tolist()


def token_counts(words: DataFrame, scores: dict[str, float]) -> dict[str, int]:
    """How often each token stands in the best segmentations; no more rows than tokens come to the driver."""
    longest = max(map(len, scores), default=1)
    held = words.sparkSession.sparkContext.broadcast((scores, Trie(scores) if longest <= TRIE_LONGEST else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, trie = held.value
        found: dict[str, int] = defaultdict(int)
        into = np.zeros(len(trie.tokens) if trie else 0, np.int64)
        for b in batches:
            for low in range(0, b.num_rows, TOGETHER):
                part = b.slice(low, TOGETHER)
                pieces, freqs = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
                for k in trie.count(pieces, freqs, into) if trie else range(len(pieces)):
                    for token in segment(pieces[k], table, longest):
                        found[token] += int(freqs[k])
        for k in np.flatnonzero(into).tolist():
            found[trie.tokens[k]] += int(into[k])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    rows = words.select("piece", "freq").mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    held.unpersist()
    return {r.token: r.n for r in rows}


def seed(pieces: DataFrame, target: int, min_freq: int, longest: int, seed_multiplier: int) -> DataFrame:
    """(token, freq, required): every character, however rare, and the most frequent longer substrings, ties in binary order.

    There are ``seed_multiplier`` times ``target`` in all, or 32 besides the characters if that is more.
    """
    required = counts.seed_counts(pieces, 1, min_freq)
    rows = required.collect()  # as many as there are characters
    n, required = len(rows), pieces.sparkSession.createDataFrame(rows, required.schema)
    more = max(max(target, n) * seed_multiplier, n + 32) - n
    others = counts.seed_counts(pieces, longest, min_freq, characters=False).orderBy(F.desc("freq"), "token").limit(max(0, more))
    return required.unionByName(others)


def learn(pieces: DataFrame, target: int, min_freq: int, longest: int, rounds: int, seed_multiplier: int, prune_ratio: float) -> list[tuple[str, float]]:
    """(token, score) of the model, required characters first. ``pieces`` (piece, freq) is read once per round: cache or checkpoint it."""
    seeds = normalised(seed(pieces, target, min_freq, longest, seed_multiplier))
    tokens = [Token(r.token, r.weight, r.required, r.logp) for r in seeds.collect()]
    if not tokens:
        raise ValueError("no words survived min_freq")
    target = max(target, sum(t.required for t in tokens))
    tokens.sort(key=order)
    words = counts.frequent(pieces, min_freq)
    for k in range(rounds):
        found = token_counts(words, {t.token: t.logp for t in tokens})
        for t in tokens:
            t.weight = found.get(t.token, 0) + (1e-3 if t.required else 0.0) + 1e-12
        normalise(tokens)
        tokens = prune(tokens, target if k + 1 == rounds else max(target, math.ceil(len(tokens) * prune_ratio)))
    tokens = prune(tokens, target)
    normalise(tokens)
    return [(t.token, t.logp) for t in sorted(tokens, key=order)]
