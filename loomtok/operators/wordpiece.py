"""WordPiece: pairs by score, the pair's frequency over the product of its symbols' frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.operators import bpe, counts, places
from loomtok.sources.shared import drop, settled


def joined(left: str, right: str, prefix: str) -> str:
    return left + (right[len(prefix) :] if prefix and right.startswith(prefix) else right)


def apply(symbols: list, left, right, new) -> list:
    out, i, n = [], 0, len(symbols)
    while i < n:
        if i + 1 < n and symbols[i] == left and symbols[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


#: Pairs whose greatest score is kept together.
_BLOCK = 1024


class _Pairs:
    """Pairs of symbols by number, with their frequencies, places and scores; one that isn't frequent enough scores -1."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.n = 0
        self.numbers: dict[int, int] = {}
        self.where: list[np.ndarray] = []
        self.left, self.right, self.two = (np.zeros(_BLOCK, np.int64) for _ in range(3))
        self.score, self.most = np.full(_BLOCK, -1.0), np.full(1, -1.0)
        self.one = np.zeros(_BLOCK, np.int64)
        self.of: list[tuple[np.ndarray, int]] = []  # by symbol, its pairs' numbers

    def add(self, keys: list[int], two: np.ndarray, where: list[np.ndarray]) -> list[int]:
        n = self.n + len(keys)
        if n > len(self.two):
            size = -(-max(n, 2 * len(self.two)) // _BLOCK) * _BLOCK
            self.left, self.right, self.two = (np.concatenate([x, np.zeros(size - len(x), x.dtype)]) for x in (self.left, self.right, self.two))
            self.score = np.concatenate([self.score, np.full(size - len(self.score), -1.0)])
            self.most = np.concatenate([self.most, np.full(size // _BLOCK - len(self.most), -1.0)])
        self.two[self.n : n] = two
        for i, key in enumerate(keys, self.n):
            self.numbers[key] = i
            left, right = key >> 32, key & bpe._RIGHT
            self.left[i], self.right[i] = left, right
            self._note(left, i)
            if right != left:
                self._note(right, i)
        self.where += where
        made = list(range(self.n, n))
        self.n = n
        return made

    def _note(self, symbol: int, i: int) -> None:
        while symbol >= len(self.of):
            self.of.append((np.empty(0, np.int32), 0))
        held, n = self.of[symbol]
        if n == len(held):
            held = held[:n][self.two[held[:n]] > 0] if n > 64 else held  # one that comes back is noted again
            n = len(held)
            held = np.concatenate([held, np.empty(max(4, n), np.int32)])
        held[n] = i
        self.of[symbol] = held, n + 1

    def rescore(self, i: np.ndarray) -> None:
        if len(i):
            two = self.two[i]
            with np.errstate(invalid="ignore"):  # of symbols that are gone
                score = two / (self.one[self.left[i]].astype(float) * self.one[self.right[i]].astype(float))
            self.score[i] = np.where(two >= self.least, score, -1.0)
            blocks = np.unique(i // _BLOCK)
            self.most[blocks] = self.score.reshape(-1, _BLOCK)[blocks].max(axis=1)

    def best(self) -> np.ndarray:
        """The numbers of the pairs of the greatest score, and of these of the greatest frequency."""
        most = self.most.max()
        if most < 0:
            return np.empty(0, np.int64)
        blocks = np.flatnonzero(self.most == most)
        k, j = np.nonzero(self.score.reshape(-1, _BLOCK)[blocks] == most)
        best = blocks[k] * _BLOCK + j
        return best[self.two[best] == self.two[best].max()]


def learn_on_driver(words: list[tuple[list[str], int]] | pa.Table, symbols: list[str], target: int, min_pair_freq: int, prefix: str) -> list[str]:
    """New symbols in the order in which they are made. Ties go to the more frequent pair, then to binary order.

    ``words``: lists of symbols, or a table (piece, freq). Scores change only of pairs with a symbol of what is merged; the
    greatest is found by blocks.
    """
    known = dict.fromkeys(symbols)
    names = [""] * places.FIRST
    ids: dict[str, int] = {}

    def symbol(name: str) -> int:
        if (i := ids.get(name)) is None:
            i = ids[name] = len(names)
            names.append(name)
        return i

    tables = np.zeros((2, 0x110000), np.int32)

    def of_points(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        for table, head, there in zip(tables, ("", prefix), (begins, ~begins), strict=True):
            new = np.unique(points[there])
            new = new[table[new] == 0]
            table[new] = [symbol(head + chr(c)) for c in new.tolist()]
        return np.where(begins, tables[0][points], tables[1][points])

    rows = list(places.from_table(words, of_points) if isinstance(words, pa.Table) else places.from_lists(words, symbol))
    most = len(names) + len(known) + max(0, target - len(known))
    text = places.Places(rows, most)
    pairs = _Pairs(max(1, min_pair_freq))
    pairs.one = np.zeros(most + 1, np.int64)
    for syms, sizes, freq in rows:
        pairs.one += _sums(syms, np.repeat(freq, sizes), len(pairs.one))
    del rows, words
    keys, freqs = text.counts()
    pairs.add(keys.tolist(), freqs, text.where(keys))
    pairs.rescore(np.arange(pairs.n))
    made: list[str] = []
    while len(known) < target:
        best = pairs.best()
        if not len(best):
            break
        i = int(best[0]) if len(best) == 1 else min(best.tolist(), key=lambda i: (names[pairs.left[i]], names[pairs.right[i]]))
        a, b = int(pairs.left[i]), int(pairs.right[i])
        name = joined(names[a], names[b], prefix)
        if name not in known:
            known[name] = None
            made.append(name)
        again = name in ids
        new = symbol(name)
        done = text.merge(pairs.where[i], a, b, new)
        pairs.where[i] = _NONE
        pairs.two[i] = 0
        for s, n in ((a, -done.freq), (b, -done.freq), (new, done.freq)):
            pairs.one[s] += n
        x, y, y_new = (v.astype(np.int64) for v in (done.x, done.y, done.y_new))
        gone, n = places.summed(np.concatenate([x << 32 | a, b << 32 | y]), np.concatenate([done.x_freq, done.y_freq]))
        fewer = [pairs.numbers[key] for key in gone.tolist()]
        for j, k in zip(fewer, n.tolist(), strict=True):
            if j != i:
                pairs.two[j] -= k
                if not pairs.two[j]:
                    pairs.where[j] = _NONE
        left, right = np.concatenate([x, np.full(len(y), new)]), np.concatenate([np.full(len(x), new), y_new])
        at, n = np.concatenate([done.x_at, done.y_at]), np.concatenate([done.x_freq, done.y_freq])
        order, found, begins = places.grouped(left << 32 | right)
        total = np.add.reduceat(n[order], begins) if len(found) else n
        where = np.split(at[order].astype(text.index), begins[1:]) if len(found) else []
        fresh = [k for k, key in enumerate(found.tolist()) if key not in pairs.numbers]
        for k, key in enumerate(found.tolist()):
            if (j := pairs.numbers.get(key)) is not None:
                if not pairs.two[j]:
                    for s in {key >> 32, key & bpe._RIGHT}:
                        pairs._note(s, j)
                pairs.two[j] += total[k]
                pairs.where[j] = np.concatenate([pairs.where[j], where[k]])
        pairs.add([int(found[k]) for k in fresh], total[fresh], [where[k].copy() for k in fresh])
        touched = [held[:n] for s in {a, b, new} if s < len(pairs.of) for held, n in [pairs.of[s]]]
        pairs.rescore(np.concatenate([np.array([i, *fewer]), *touched]))
    return made


def base(words: pa.Table, prefix: str) -> list[str]:
    """The characters of words (piece, freq) as symbols."""
    found: set[str] = set()

    def note(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        found.update(head + chr(c) for head, there in (("", begins), (prefix, ~begins)) for c in np.unique(points[there]).tolist())
        return points

    for _ in places.from_table(words, note):
        pass
    return sorted(found)


_NONE = np.empty(0, np.int32)


def _sums(syms: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    k, total = places.summed(syms, numbers)
    out[k] += total
    return out


def independent(top: list[tuple], known: dict[str, None], prefix: str) -> list[tuple]:
    """The longest run of leading pairs (l, r, ...) that have no symbol in common and make new symbols, each another one; the first is always there."""
    used: set[str] = set()
    out = []
    for row in top:
        left, right = row[0], row[1]
        new = joined(left, right, prefix)
        alone = left == right or new in known or new in used
        if out and (alone or left in used or right in used):
            break
        out.append(row)
        if alone:
            break
        used |= {left, right, new}
    return out


def accept(rows: list[tuple], bounds: dict[int, float]) -> int:
    """How many of the leading :func:`independent` pairs (l, r, freq, score) can be merged in one round as if one by one.

    A merge leaves pairs of other symbols as they are. ``bounds`` has for each pair the most that any pair with one of its
    symbols can score after it is merged; a later pair is next as long as it scores more than all of these.
    """
    limit = bounds.get(0, 0.0)
    for k in range(1, len(rows)):
        if rows[k][3] <= limit:
            return k
        limit = max(limit, bounds.get(k, 0.0))
    return len(rows)


def _bounds(scored: DataFrame, rows: list[tuple]) -> dict[int, float]:
    """What :func:`accept` asks for: of all pairs with a symbol of these, by the first of them that it has one of.

    Of a symbol that occurs n times and takes part in m merges, n - m stay and m become part of the new one. A pair's
    own frequency never grows, so it scores at most that over the least number that each side can have.
    """
    spark = scored.sparkSession
    touched = spark.createDataFrame([(s, k, row[2]) for k, row in enumerate(rows) for s in row[:2]], "symbol string, k int, m bigint")
    themselves = spark.createDataFrame([row[:2] for row in rows], "l string, r string")
    sides = [F.broadcast(touched.select(F.col("symbol").alias(c), F.col("k").alias(f"{c}_k"), F.col("m").alias(f"{c}_m"))) for c in ("l", "r")]  # two rows a merge
    near = scored.join(sides[0], "l", "left").join(sides[1], "r", "left").where("l_k is not null or r_k is not null").join(F.broadcast(themselves), ["l", "r"], "left_anti")

    def least(c: str):
        n, m = F.col(f"{c}_freq"), F.col(f"{c}_m")
        return F.when(m.isNull(), n).when(n > m, F.least(n - m, m)).otherwise(m).cast("double")

    found = near.groupBy(F.least("l_k", "r_k").alias("k")).agg(F.max(F.col("freq").cast("double") / (least("l") * least("r"))).alias("most"))
    return {r.k: r.most for r in found.collect()}


def learn_distributed(words: DataFrame, symbols: list[str], target: int, min_pair_freq: int, prefix: str, batch: int = 256) -> list[str]:
    """As :func:`learn_on_driver`, over words (syms, freq) that stay distributed.

    Each round scores all pairs, brings the ``batch`` best to the driver, and merges as many of these in one pass of string
    replacements as :func:`accept` proves to be next.
    """
    known = dict.fromkeys(symbols)
    made: list[str] = []
    now, held = bpe.wrapped(words), None
    while len(known) < target:
        scored = settled(counts.pair_scores(now.select(bpe.unwrapped().alias("syms"), "freq"), frequencies=True).where(F.col("freq") >= max(1, min_pair_freq)))
        top = [tuple(r) for r in scored.orderBy(F.desc("score"), F.desc("freq"), "l", "r").limit(batch).select("l", "r", "freq", "score").collect()]
        taken = independent(top, known, prefix)
        if len(taken) > 1:
            taken = taken[: accept(taken, _bounds(scored, taken))]
        drop(scored)
        if not taken:
            break
        word = F.col("word")
        for left, right, *_ in taken:
            if len(known) == target:
                break
            new = joined(left, right, prefix)
            word = F.replace(word, F.lit(f"{bpe.OPEN}{left}{bpe.CLOSE}{bpe.OPEN}{right}{bpe.CLOSE}"), F.lit(f"{bpe.OPEN}{new}{bpe.CLOSE}"))
            if new not in known:
                known[new] = None
                made.append(new)
        now = held = settled(now.select(word.alias("word"), "freq"), instead_of=held)
    drop(held)
    return made
