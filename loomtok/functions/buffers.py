"""Texts cut into pieces in the buffers of Arrow arrays: a piece is a view of the text's own bytes, and no string is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomtok.functions.chars import WHITESPACE

#: Bytes of text that are cut at once.
BLOCK_BYTES = 4_000_000
#: White space of two and of three bytes, by its first byte.
_WIDE = [c.encode() for c in WHITESPACE if ord(c) > 127]


def spaces(data: np.ndarray, wide: list[bytes] = _WIDE) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space, ``wide`` being what is beyond ASCII."""
    out = (data - np.uint8(9) < 5) | (data == 32)  # 9 to 13, and the space
    if data.max(initial=0) < 128:
        return out
    for lead in {w[0] for w in wide}:
        at = np.flatnonzero(data == lead)
        for w in wide:
            if w[0] == lead and len(at):
                here = at[at + len(w) <= len(data)]
                for k in range(1, len(w)):
                    here = here[data[here + k] == w[k]]
                for k in range(len(w)):
                    out[here + k] = True
    return out


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, pa.Buffer, np.ndarray]]:
    """(first row, row after the last, bytes, where rows begin in them and where the last ends) of runs of rows of ``BLOCK_BYTES``, or of one longer row."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + BLOCK_BYTES, "right")) - 1)
        low, high = int(bounds[row]), int(bounds[last])
        if high > low:
            yield row, last, raw.slice(low, high - low), bounds[row : last + 1] - low
        row = last


def cuts(block: pa.Buffer, bounds: np.ndarray, words: bool = False) -> np.ndarray:
    """Where pieces begin, and the end: where white space follows something else, and with ``words`` also where it ends."""
    data = np.frombuffer(block, np.uint8)
    space = spaces(data)
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = space[1:] != space[:-1] if words else space[1:] & ~space[:-1]
    begins[bounds] = True
    begins[-1] = True
    return np.flatnonzero(begins)


def pieces(block: pa.Buffer, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), block)


def counted(texts: pa.Array, words: bool) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(pieces, numbers) of distinct pieces, block by block: byte-level ones, or words. Null and empty texts have none."""
    for _, _, block, bounds in blocks(texts):
        found = pieces(block, cuts(block, bounds, words)).value_counts()
        values, numbers = found.field(0), found.field(1)
        if words:
            keep = pa.array(_words(values))
            values, numbers = values.filter(keep), numbers.filter(keep)
        yield values.cast(pa.string()), numbers


def _words(values: pa.Array) -> np.ndarray:
    """Which of some pieces are words and not white space, by their first byte."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values)]
    data = np.frombuffer(values.buffers()[2], np.uint8)
    return ~spaces(data)[at]
