"""Words of symbols laid out in flat arrays: what the learners on the driver merge, a vector of places at a time.

A symbol is known by the place where it begins. Between words, before the first and after the last stands a mark.
Merging moves nothing: the left place takes the new symbol, the right one is dead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEAD, MARK, FIRST = 0, 1, 2
#: Places that are counted or laid out at once.
BLOCK = 4_000_000


class Places:
    """``syms`` has the symbol that begins at a place, ``width`` its number of places, at its first and at its last one.

    Words are in order of their frequency, so that a place's is found among the few different ones.
    """

    def __init__(self, words: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], symbols: int) -> None:
        """``words``: (symbols, numbers of symbols, frequencies) of runs of words by frequency. ``symbols``: at most so many ids there will be."""
        kind = np.uint16 if symbols + FIRST < 2**16 else np.int32
        parts, starts, freqs, at, longest = [np.full(1, MARK, kind)], [], [], 1, 1
        for syms, sizes, freq in words:
            if not len(sizes):
                continue
            ends = np.cumsum(sizes + 1)
            part = np.full(int(ends[-1]), MARK, kind)
            inner = np.ones(len(part), bool)
            inner[ends - 1] = False
            part[inner] = syms
            begins = at + ends - sizes - 1
            new = np.flatnonzero(np.diff(freq, prepend=freq[:1] - 1))
            starts.append(begins[new])
            freqs.append(freq[new])
            parts.append(part)
            at += len(part)
            longest = max(longest, int(sizes.max()))
        self.syms = np.concatenate(parts)
        self.width = np.ones(len(self.syms), np.uint8 if longest < 2**8 else np.int32)
        self._starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self._freqs = np.concatenate(freqs) if freqs else np.zeros(0, np.int64)
        self.index = np.int32 if len(self.syms) < 2**31 else np.int64

    def freq(self, at: np.ndarray) -> np.ndarray:
        return self._freqs[np.searchsorted(self._starts, at, "right") - 1]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left places, keys) block by block of all neighbours; a key is the left symbol and, in the low 32 bits, the right one."""
        for low in range(0, len(self.syms), BLOCK):
            at = np.flatnonzero(self.syms[low : low + BLOCK] >= FIRST) + low
            right = self.syms[at + self.width[at]]
            at, right = at[right >= FIRST], right[right >= FIRST]
            yield at, self.syms[at].astype(np.int64) << 32 | right

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, frequencies) of all pairs, by key."""
        keys, freqs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, found in self.pairs():
            k, n = summed(found, self.freq(at))
            keys, freqs = summed(np.concatenate([keys, k]), np.concatenate([freqs, n]))
        return keys, freqs

    def where(self, keys: np.ndarray) -> list[np.ndarray]:
        """The places of each of the pairs ``keys``, which are in order."""
        total = np.zeros(len(keys), np.int64)
        for at, found in self.pairs():
            total += np.bincount(_known(keys, found)[0], minlength=len(keys))
        ends = np.cumsum(total)
        free = ends - total
        out = np.empty(int(total.sum()), self.index)
        for at, found in self.pairs():
            k, there = _known(keys, found)
            order = np.argsort(k, kind="stable")
            k, at = k[order], at[there][order]
            n = np.bincount(k, minlength=len(keys))
            out[free[k] + np.arange(len(k)) - (np.cumsum(n) - n)[k]] = at
            free += n
        return np.split(out, ends[:-1]) if len(keys) else []

    def merge(self, at: np.ndarray, left: int, right: int, new: int) -> Merged | None:
        """Merges the pair wherever it still stands of the places ``at``, from left to right without overlap."""
        at = at[self.syms[at] == left]
        at = at[self.syms[at + self.width[at]] == right]
        if not len(at):
            return None
        if left == right:
            at = np.sort(at)
            follows = np.zeros(len(at), bool)
            follows[1:] = at[1:] == at[:-1] + self.width[at[:-1]]
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
        syms, width = self.syms, self.width
        second = at + width[at]
        after = second + width[second]
        before = at - width[at - 1]
        freq = self.freq(at)
        y = syms[after]
        syms[second] = DEAD
        alone = syms[before] >= FIRST  # else a word begins here, or what is before is merged too and has this as its right neighbour
        syms[at] = new
        size = width[at] + width[second]
        width[at] = size
        width[after - 1] = size
        more = y >= FIRST
        before = before[alone]
        return Merged(int(freq.sum()), syms[before], before, freq[alone], y[more], syms[after[more]], at[more], freq[more])


class Merged:
    """What :meth:`Places.merge` did: the left neighbours ``x`` at ``x_at``, and the right ones, ``y`` before and ``y_new`` after it, of the places ``y_at``."""

    __slots__ = ("freq", "x", "x_at", "x_freq", "y", "y_new", "y_at", "y_freq")

    def __init__(self, *values) -> None:
        for name, value in zip(self.__slots__, values, strict=True):
            setattr(self, name, value)


def _known(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``keys`` for those that are, whether they are)."""
    k = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
    there = keys[k] == found
    return k[there], there


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, distinct keys, where each begins in this order)."""
    order = np.argsort(keys, kind="stable")
    there = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, there[begins], begins


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, distinct, begins = grouped(keys)
    return distinct, np.add.reduceat(numbers[order], begins) if len(keys) else numbers


def from_table(table: pa.Table, ids) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of :class:`Places` from a table (piece, freq). ``ids`` gives the symbols of code points and of whether they begin a word."""
    order = pc.sort_indices(table.column("freq"))
    step = max(1, BLOCK // 16)
    for low in range(0, len(order), step):
        part = table.take(order.slice(low, step))
        pieces = part.column("piece").combine_chunks()
        if isinstance(pieces, pa.ChunkedArray):
            pieces = pa.concat_arrays(pieces.chunks)
        sizes = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(pieces.to_pylist()).encode("utf-32-le"), np.uint32)
        begins = np.zeros(len(points) + 1, bool)
        begins[np.cumsum(sizes) - sizes] = True
        yield ids(points, begins[:-1]), sizes, part.column("freq").to_numpy().astype(np.int64)


def from_lists(words: list[tuple[list[str], int]], symbol) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    words = sorted(words, key=lambda w: w[1])
    yield np.array([symbol(s) for syms, _ in words for s in syms], np.int64), np.array([len(s) for s, _ in words], np.int64), np.array([f for _, f in words], np.int64)
