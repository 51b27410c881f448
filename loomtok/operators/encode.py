"""Encoding texts with a model: whole documents in Arrow batches, with a bounded memo of pieces in each task."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from loomtok.functions import buffers
from loomtok.functions.chars import BYTE_CHARS, CHAR_BYTES, PYTHON_CLASS, WHITESPACE, byte_decode, byte_encode

_BYTE_PIECES = re.compile(f"[{PYTHON_CLASS}]*[^{PYTHON_CLASS}]+|[{PYTHON_CLASS}]+")
_WORDS = re.compile(f"[^{PYTHON_CLASS}]+")

#: From so many new pieces on, they are merged together.
MANY = 32


@dataclass
class Model:
    """A tokenizer: its kind (BPE, WordPiece, Unigram), vocabulary, merges and how texts are split first."""

    kind: str
    vocab: dict[str, int]
    merges: list[tuple[str, str]] = field(default_factory=list)
    scores: list[tuple[str, float]] = field(default_factory=list)
    added: dict[str, int] = field(default_factory=dict)
    unk_token: str | None = None
    prefix: str = "##"
    byte_level: bool = True


class Encoder:
    """Ids of texts. Added tokens are entries of the vocabulary only; texts aren't searched for them."""

    def __init__(self, model: Model, memo: int | None = None) -> None:
        self.model, self.limit = model, memo
        self.vocab = {**model.vocab, **model.added}
        if not self.vocab:
            raise ValueError("the vocabulary is empty")
        self.unk = self.vocab.get(model.unk_token) if model.unk_token else None
        self.memo: dict[str, list[int]] = {}
        self.ranks: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(model.merges):
            self.ranks.setdefault(pair, k)
        self.symbols = {*self.vocab, *(s for pair in model.merges for s in (*pair, "".join(pair)))}
        scored = model.scores or [(t, -1.0) for t, _ in sorted(self.vocab.items(), key=lambda x: x[1])]
        self.scores = {}
        for token, score in scored:
            if token and token in self.vocab:
                self.scores.setdefault(token, score)
        self.longest = max(map(len, self.scores), default=1)
        self._piece = {"BPE": self._bpe, "WordPiece": self._wordpiece, "Unigram": self._unigram}[model.kind]

    def pieces(self, text: str) -> list[str]:
        return _BYTE_PIECES.findall(text) if self.model.byte_level else _WORDS.findall(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo, limit = self.memo, self.limit
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self._piece(byte_encode(piece) if self.model.byte_level else piece)
                if limit != 0:
                    if limit is not None and len(memo) >= limit:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def many(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces, which may have blanks before a word."""
        memo, limit, byte_level = self.memo, self.limit, self.model.byte_level
        out = []
        found: dict[str, list[int]] = {}
        if byte_level and self.model.kind == "BPE":
            new = list(dict.fromkeys(p for p in pieces if p and p not in memo))
            if len(new) >= MANY:
                found = dict(zip(new, self._bpe_many(new), strict=True))
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                if (ids := found.get(piece)) is not None:
                    pass
                elif byte_level:
                    ids = self._piece(byte_encode(piece))
                else:
                    word = piece.strip(WHITESPACE)
                    ids = self._piece(word) if word else []
                if limit != 0:
                    if limit is not None and len(memo) >= limit:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return out

    def _bpe(self, piece: str) -> list[int]:
        """All places of the pair of lowest rank merge at once, again and again. An unknown character drops the piece."""
        parts = list(piece)
        if any(c not in self.symbols for c in parts):
            return []
        ranks = self.ranks
        while len(parts) > 1:
            best, pair = math.inf, None
            for p in zip(parts, parts[1:]):  # noqa: B905
                rank = ranks.get(p, math.inf)
                if rank < best:
                    best, pair = rank, p
            if pair is None:
                break
            left, right = pair
            new, i, n = [], 0, len(parts)
            while i < n:
                if i + 1 < n and parts[i] == left and parts[i + 1] == right:
                    new.append(left + right)
                    i += 2
                else:
                    new.append(parts[i])
                    i += 1
            parts = new
        ids = (self.vocab.get(p, self.unk) for p in parts)
        return [i for i in ids if i is not None]

    def _bpe_many(self, pieces: list[str]) -> list[list[int]]:
        """:meth:`_bpe` of the bytes of pieces that aren't empty, a merge of each at a time in arrays of the symbols of all.

        ``rank`` has the rank of each symbol with the next one in its piece. Pieces that have no more merges are put aside.
        """
        if "_arrays" not in self.__dict__:
            number = {s: k for k, s in enumerate(self.symbols)}
            keys = np.array([number[a] * len(number) + number[b] for a, b in self.ranks], np.int64)
            order = np.argsort(keys)
            rank = np.array(list(self.ranks.values()), np.int64)
            made = np.empty(len(self.model.merges) + 1, np.int64)
            for (a, b), k in self.ranks.items():
                made[k] = number[a + b]
            ids = np.full(len(number), -1, np.int64)
            for symbol, k in number.items():
                if (i := self.vocab.get(symbol, self.unk)) is not None:
                    ids[k] = i
            self._arrays = np.array([number.get(c, -1) for c in BYTE_CHARS], np.int64), keys[order], rank[order], made, ids, len(number)
        bytes_, keys, ranks, made, ids, symbols = self._arrays
        none = len(made)

        def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(left), none)
            key = left * symbols + right
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[k] == key, ranks[k], none)

        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        syms = bytes_[np.frombuffer(b"".join(raw), np.uint8)]
        piece = np.repeat(np.arange(len(raw)), size)
        bad = np.zeros(len(raw), bool)
        bad[piece[syms < 0]] = True
        syms, piece = syms[~bad[piece]], piece[~bad[piece]]
        last = np.append(piece[1:] != piece[:-1], True) if len(piece) else np.zeros(0, bool)
        rank = np.full(len(syms), none)
        at = np.flatnonzero(~last)
        rank[at] = ranked(syms[at], syms[at + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(syms):
            ends = np.flatnonzero(last)
            begins = np.concatenate([[0], ends[:-1] + 1])
            best = np.minimum.reduceat(rank, begins)
            best = np.repeat(best, ends - begins + 1)
            live = best < none
            if not live.all():
                done.append((piece[~live], syms[~live]))
                syms, piece, last, rank, best = (x[live] for x in (syms, piece, last, rank, best))
                if not len(syms):
                    break
            at = np.flatnonzero(rank == best)
            follows = np.zeros(len(at), bool)
            follows[1:] = at[1:] == at[:-1] + 1  # of a symbol with itself
            if follows.any():
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            syms[at] = made[rank[at]]
            last[at] = last[at + 1]
            stay = np.ones(len(syms), bool)
            stay[at + 1] = False
            syms, piece, last, rank = (x[stay] for x in (syms, piece, last, rank))
            at -= np.arange(len(at))
            before = at[at > 0] - 1
            at = np.concatenate([at, before])
            rank[at] = none
            at = at[~last[at]]
            rank[at] = ranked(syms[at], syms[at + 1])
        if done:
            piece, syms = (np.concatenate(x) for x in zip(*done, strict=True))
            order = np.argsort(piece, kind="stable")
            piece, flat = piece[order], ids[syms[order]]
            piece, flat = piece[flat >= 0], flat[flat >= 0]
        else:
            flat = syms
        bounds = np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=len(raw)))]).tolist()
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _wordpiece(self, word: str) -> list[int]:
        """Longest match first. A word that fails is the unknown token, or what matched before if there is none."""
        out, start, n = [], 0, len(word)
        while start < n:
            head = self.model.prefix if start else ""
            for end in range(n, start, -1):
                if (i := self.vocab.get(head + word[start:end])) is not None:
                    out.append(i)
                    start = end
                    break
            else:
                return [self.unk] if self.unk is not None else out
        return out

    def _unigram(self, word: str) -> list[int]:
        """The greatest sum of scores; of equal ones the first found, starting earlier. Without any path the unknown token, or nothing."""
        n, scores = len(word), self.scores
        best, source = [0.0, *[-math.inf] * n], [0] * (n + 1)
        for i in range(n):
            if best[i] == -math.inf:
                continue
            for j in range(min(n, i + self.longest), i, -1):
                score = scores.get(word[i:j])
                if score is not None and best[i] + score > best[j]:
                    best[j], source[j] = best[i] + score, i
        if best[n] == -math.inf:
            return [self.unk] if self.unk is not None else []
        out = []
        while n:
            out.append(self.vocab[word[source[n] : n]])
            n = source[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """Tokens put together again: exact for byte-level models; words stand apart by a space otherwise."""
        by_id = self.__dict__.setdefault("_by_id", {i: t for t, i in self.vocab.items()})
        tokens = [by_id[i] for i in ids if i in by_id]
        if self.model.byte_level:
            return byte_decode("".join(t for t in tokens if t not in self.model.added))
        if self.model.kind == "WordPiece":
            out = ""
            for t in tokens:
                out += t[len(self.model.prefix) :] if out and t.startswith(self.model.prefix) else (" " if out else "") + t
            return out
        return "".join(tokens)


def encode_array(encoder: Encoder, texts: pa.Array, bos: int | None = None, eos: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of an array of strings, null as empty and without ``bos`` and ``eos``.

    Pieces are cut where white space follows something else, as views of the array's own bytes, and numbered by Arrow;
    only distinct ones reach the encoder. Pieces of words keep the blanks before them here, which changes no id.
    """
    there = texts.is_valid().to_numpy(zero_copy_only=False)
    chunks: list[np.ndarray] = []
    sizes = np.zeros(len(texts), np.int64)
    for row, last, block, bounds in buffers.blocks(texts):
        at = buffers.cuts(block, bounds)
        pieces = buffers.pieces(block, at).dictionary_encode()
        index, ids = pieces.indices.to_numpy(), encoder.many(pieces.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        ends = np.concatenate([[0], np.cumsum(lengths[index])])
        begin = (np.cumsum(lengths) - lengths)[index]
        chunks.append(flat[np.repeat(begin - ends[:-1], lengths[index]) + np.arange(ends[-1])])
        sizes[row:last] = np.diff(ends[np.searchsorted(at, bounds)])
    ids = np.concatenate(chunks) if chunks else np.empty(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for extra, where in ((bos, offsets[:-1]), (eos, None)):
        if extra is not None:
            at = (offsets[:-1] if where is not None else offsets[1:])[there]
            ids = np.insert(ids, at, extra)
            offsets = offsets + np.concatenate([[0], np.cumsum(there)])
    return ids, offsets


def _encoded(packed, memo: int, keep: list[str], bos: int | None = None, eos: int | None = None):
    """Batches of the columns ``keep`` and a text to batches of these and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(cloudpickle.loads(packed.value), memo)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(len(keep))
                ids, offsets = encode_array(encoder, texts, bos, eos)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], [*keep, "ids"])

    return run


def _decoded(packed, keep: list[str]):
    """Batches of the columns ``keep`` and ids to batches of these and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(cloudpickle.loads(packed.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], decode_array(encoder, part.column(len(keep)))], [*keep, "decoded"])

    return run


def _fields(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)


def encode_column(df: DataFrame, model: Model, keep: list[str], text: str = "text", memo: int = 50_000, bos: int | None = None, eos: int | None = None) -> DataFrame:
    """The columns ``keep`` and ids (array<int>) of each text; ``bos`` and ``eos`` stand around it, also around none. Null text gives null.

    The model is broadcast once, the size of a vocabulary whatever the data, and unpacked once per task.
    """
    packed = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    return df.select(*keep, text).mapInArrow(_encoded(packed, memo, keep, bos, eos), f"{_fields(df, keep)}, ids array<int>")


def decode_column(df: DataFrame, model: Model, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and decoded (string), the text of each row's ids. Null ids give null."""
    packed = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    return df.select(*keep, ids).mapInArrow(_decoded(packed, keep), f"{_fields(df, keep)}, decoded string")


def round_trip_column(df: DataFrame, model: Model, keep: list[str], text: str = "text", memo: int = 50_000) -> DataFrame:
    """:func:`decode_column` of :func:`encode_column`, batch by batch: ids are arrays that never leave a worker."""
    packed = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    encode, decode = _encoded(packed, memo, keep), _decoded(packed, keep)
    return df.select(*keep, text).mapInArrow(lambda batches: decode(encode(batches)), f"{_fields(df, keep)}, decoded string")


def decode_array(encoder: Encoder, lists: pa.Array) -> pa.Array:
    """The texts of an array of lists of ids.

    Tokens' bytes are copied one after the other as views of a table of all; a row that these make no UTF-8 of is decoded by itself.
    """
    if not encoder.model.byte_level:
        return pa.array([None if x is None else encoder.decode(x) for x in lists.to_pylist()], pa.string())
    if "_table" not in encoder.__dict__:
        by_id = {i: t for t, i in encoder.vocab.items() if i >= 0}
        parts = [bytes(CHAR_BYTES[c] for c in by_id.get(i, "") if c in CHAR_BYTES) if by_id.get(i) not in encoder.model.added else b"" for i in range(max(by_id, default=-1) + 2)]
        encoder._table = pa.array(parts, pa.large_binary())  # the last one is of unknown ids
        encoder._sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ids = lists.flatten()
    flat = ids.to_numpy(zero_copy_only=False)
    flat = np.where((flat >= 0) & (flat < len(encoder._sizes)), flat, len(encoder._sizes) - 1).astype(np.int64)
    sizes = np.zeros(len(lists), np.int64)
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    sizes[there] = pc.list_value_length(lists).drop_null().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(encoder._sizes[flat])])
    offsets = at[np.concatenate([[0], np.cumsum(sizes)])]
    raw = encoder._table.take(pa.array(flat)).buffers()[2] if len(flat) else None
    data = raw.to_pybytes()[: int(at[-1])] if raw is not None else b""
    try:
        data.decode()
        # a text that begins within a character isn't one, though all of them together are
        begins = offsets[:-1][offsets[:-1] < len(data)]
        whole = not len(begins) or bool((np.frombuffer(data, np.uint8)[begins] & 0xC0 != 0x80).all())
    except UnicodeDecodeError:
        whole = False
    if not whole:
        bounds = offsets.tolist()
        return pa.array([data[a:b].decode("utf-8", "replace") if t else None for a, b, t in zip(bounds, bounds[1:], there.tolist(), strict=False)], pa.string())
    mask = pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(offsets), pa.py_buffer(data), mask).cast(pa.string())


#: Bytes of text whose ids are joined at once; a longer text is alone.
JOINED_BYTES = 16_000_000


def joined_column(df: DataFrame, model: Model, keep: list[str], text: str = "text", memo: int = 50_000, bos: int | None = None, eos: int | None = None) -> DataFrame:
    """The columns ``keep`` and ids (string), those of :func:`encode_column` with spaces between them. Null text gives null."""
    packed = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(cloudpickle.loads(packed.value), memo)
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(len(keep))).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            row = 0
            while row < batch.num_rows:
                last = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + JOINED_BYTES, "right")))
                part = batch.slice(row, last - row)
                texts = part.column(len(keep))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], joined(*encode_array(encoder, texts, bos, eos), texts.is_null())], [*keep, "ids"])
                row = last

    return df.select(*keep, text).mapInArrow(run, f"{_fields(df, keep)}, ids string")


def joined(ids: np.ndarray, offsets: np.ndarray, null: pa.Array) -> pa.Array:
    """Lists of ids as texts with spaces between them; each different id is written once."""
    different = pa.array(ids).dictionary_encode()
    words = different.dictionary.cast(pa.large_string()).take(different.indices)
    lists = pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), words, mask=null)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
