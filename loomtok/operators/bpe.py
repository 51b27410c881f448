"""Byte-pair merges: learned on the driver from the reduced counts, or as DataFrame rounds when these are too many.

Both give the same merges. Of pairs the most frequent comes first; ties go to the left symbol, then the right one, in
binary order. A merge replaces from left to right without overlap.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.operators import counts, places
from loomtok.sources.shared import drop, settled

OPEN, CLOSE = "\ue000", "\ue001"


def merge_word(symbols: list[str], left: str, right: str) -> list[str]:
    out, i, n = [], 0, len(symbols)
    while i < n:
        if i + 1 < n and symbols[i] == left and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def learn_on_driver(words: list[tuple[list[str], int]] | pa.Table, symbols: set[str], target: int, min_pair_freq: int) -> list[tuple[str, str]]:
    """Merges in order until ``target`` symbols exist or no pair is frequent enough. ``words``: lists of symbols, or a table (piece, freq).

    Only pairs down to some frequency are followed, so that few are held; with none left of these, all are counted anew
    down to a lower one. A pair's count can grow only when a merge makes a symbol that was there; that symbol's pairs
    are counted again then. The heap has each followed pair with its count or a greater one of before.
    """
    known = set(symbols)
    names = [""] * places.FIRST
    ids: dict[str, int] = {}

    def symbol(name: str) -> int:
        if (i := ids.get(name)) is None:
            i = ids[name] = len(names)
            names.append(name)
        return i

    table = np.zeros(0x110000, np.int32)

    def of_points(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        new = np.unique(points)
        new = new[table[new] == 0]
        table[new] = [symbol(chr(c)) for c in new.tolist()]
        return table[points]

    if isinstance(words, pa.Table):
        words = words.filter(pc.greater(pc.utf8_length(words.column("piece")), 1))
        rows = places.from_table(words, of_points)
    else:
        rows = places.from_lists([(s, f) for s, f in words if len(s) > 1], symbol)
    rows = list(rows)
    text = places.Places(rows, len(names) + len(symbols) + max(0, target - len(known)))
    del rows, words
    least = max(1, min_pair_freq)
    merges: list[tuple[str, str]] = []
    low = None
    while len(known) < target and low != least:
        keys, freqs = text.counts()
        if not len(keys) or freqs.max() < least:
            break
        rest = target - len(known)
        low = max(least, int(freqs.max()) // 16, int(np.partition(freqs, -rest)[-rest]) if rest < len(freqs) else 0)
        keys, freqs = keys[freqs >= low], freqs[freqs >= low]
        freq = dict(zip(keys.tolist(), freqs.tolist(), strict=True))
        where = dict(zip(freq, text.where(keys), strict=True))
        heap = [(-f, names[k >> 32], names[k & _RIGHT], k) for k, f in freq.items()]
        heapq.heapify(heap)

        def follow(left: np.ndarray, right: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
            """Pairs that a merge has made."""
            order, made, begins = places.grouped(left << 32 | right)
            if not len(made):
                return
            total = np.add.reduceat(n[order], begins)
            ends = np.append(begins[1:], len(order))
            for i in np.flatnonzero(total >= low).tolist():
                key = int(made[i])
                freq[key] = int(total[i])
                where[key] = at[order[begins[i] : ends[i]]].astype(text.index)
                heapq.heappush(heap, (-freq[key], names[key >> 32], names[key & _RIGHT], key))

        def forget(keys: np.ndarray, n: np.ndarray) -> None:
            """Occurrences that a merge has taken away."""
            for key, gone in zip(*(x.tolist() for x in places.summed(keys, n)), strict=True):
                if (there := freq.get(key)) is not None:
                    if there - gone >= low:
                        freq[key] = there - gone
                    else:
                        del freq[key], where[key]

        while heap and len(known) < target:
            count, left, right, key = heapq.heappop(heap)
            there = freq.get(key, 0)
            if there != -count:
                if 0 < there < -count:
                    heapq.heappush(heap, (-there, left, right, key))
                continue
            merges.append((left, right))
            a, b = key >> 32, key & _RIGHT
            again = left + right in ids
            new = symbol(left + right)
            known.add(left + right)
            del freq[key]
            done = text.merge(where.pop(key), a, b, new)
            x, y, y_new = (v.astype(np.int64) for v in (done.x, done.y, done.y_new))
            forget(np.concatenate([x << 32 | a, b << 32 | y]), np.concatenate([done.x_freq, done.y_freq]))
            if again:
                at, found = _with(text, new)
                follow(found >> 32, found & _RIGHT, at, text.freq(at))
            else:
                follow(np.concatenate([x, np.full(len(y), new)]), np.concatenate([np.full(len(x), new), y_new]), np.concatenate([done.x_at, done.y_at]), np.concatenate([done.x_freq, done.y_freq]))
    return merges


_RIGHT = 2**32 - 1


def _with(text: places.Places, symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of all pairs that have a symbol."""
    one = np.flatnonzero(text.syms == symbol)
    at = np.union1d(one, one - text.width[one - 1])
    at = at[text.syms[at] >= places.FIRST]
    right = text.syms[at + text.width[at]]
    at, right = at[right >= places.FIRST], right[right >= places.FIRST]
    return at, text.syms[at].astype(np.int64) << 32 | right


def wrapped(words: DataFrame) -> DataFrame:
    """(word, freq): symbols of ``syms`` between two signs that the private-use area has; such signs in a symbol are refused."""
    marks = F.exists("syms", lambda s: s.contains(OPEN) | s.contains(CLOSE))
    checked = F.when(marks, F.raise_error(F.lit("U+E000 and U+E001 can't be in words"))).otherwise(F.array_join(F.transform("syms", lambda s: F.concat(F.lit(OPEN), s, F.lit(CLOSE))), ""))
    return words.select(checked.cast("string").alias("word"), "freq")


def unwrapped(word: str = "word"):
    return F.split(F.substring(F.col(word), F.lit(2), F.char_length(word) - 2), CLOSE + OPEN)


def accept(pairs: list[tuple[str, str, int]], complete: bool) -> list[tuple[str, str]]:
    """How many of the leading pairs, in order, can be merged in one round with the result of merging them one by one.

    A pair is taken while every pair that shares a symbol with those taken before is strictly rarer: what merging
    makes is no more frequent than one of those. A symbol with itself only goes alone. If the list isn't ``complete``,
    pairs as frequent as its last may be missing.
    """
    taken: list[tuple[str, str]] = []
    used: set[str] = set()
    for left, right, freq in pairs:
        if taken:
            ties = [p for p in pairs if p[2] == freq]
            if left == right or (not complete and freq == pairs[-1][2]) or any(a in used or b in used for a, b, _ in ties):
                break
        taken.append((left, right))
        used |= {left, right}
        if left == right:
            break
    return taken


def learn_distributed(words: DataFrame, symbols: set[str], target: int, min_pair_freq: int, batch: int = 256) -> list[tuple[str, str]]:
    """As :func:`learn_on_driver`, over words (syms, freq) that stay distributed.

    Each round counts pairs, brings the ``batch`` most frequent to the driver, merges as many as :func:`accept` allows
    in one pass of string replacements, and writes the words to the shared folder in place of the last round's.
    """
    known = set(symbols)
    now, held = wrapped(words.where(F.size("syms") > 1)), None
    merges: list[tuple[str, str]] = []
    while len(known) < target:
        top = counts.pair_counts(now.select(unwrapped().alias("syms"), "freq")).where(F.col("freq") >= max(1, min_pair_freq)).orderBy(F.desc("freq"), "l", "r").limit(batch).collect()
        taken = accept([tuple(r) for r in top], len(top) < batch)[: target - len(known)]
        if not taken:
            break
        word = F.col("word")
        for left, right in taken:
            word = F.replace(word, F.lit(f"{OPEN}{left}{CLOSE}{OPEN}{right}{CLOSE}"), F.lit(f"{OPEN}{left}{right}{CLOSE}"))
            merges.append((left, right))
            known.add(left + right)
        now = now.select(word.alias("word"), "freq").where(F.contains("word", F.lit(CLOSE + OPEN)))
        now = held = settled(now, instead_of=held)
    drop(held)
    return merges
