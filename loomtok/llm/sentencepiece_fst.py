"""SentencePiece encoding and decoding as the shortest path through a composed transducer."""

from __future__ import annotations

import pickle
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import on_worker

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks whose paths a Python worker remembers; when there are more it starts anew.
MEMO = 600_000
#: Pairs of pieces whose weight a worker remembers.
PAIRS = 500_000


# ---- the model file -------------------------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    """What a .model file says: pieces (text, score, type), the kind of model and the normaliser's switches."""

    pieces: list[tuple[str, float, int]]
    kind: int = BPE
    byte_fallback: bool = False
    prefix: bool = True
    squeeze: bool = False
    escape: bool = True
    charsmap: bytes = b""


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        return parse_model(f.read())


def parse_model(data: bytes) -> Model:
    pieces, kind, fallback, switches, charsmap = [], UNIGRAM, False, {3: 1, 4: 1, 5: 1}, b""
    for field, value in _fields(data):
        if field == 1:
            text, score, sort = "", 0.0, NORMAL
            for k, v in _fields(value):
                text, score, sort = (v.decode(), score, sort) if k == 1 else (text, struct.unpack("<f", v)[0], sort) if k == 2 else (text, score, v) if k == 3 else (text, score, sort)
            pieces.append((text, score, sort))
        elif field == 2:
            trainer = dict(_fields(value))
            kind, fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            if trainer.get(24, 0):
                raise ValueError("models with blanks at the ends of pieces aren't supported")
        elif field == 3:
            spec = dict(_fields(value))
            charsmap = spec.get(2, b"")
            switches |= {k: spec[k] for k in (3, 4, 5) if k in spec}
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Model(pieces, kind, fallback, bool(switches[3]), bool(switches[4]), bool(switches[5]), charsmap)


def character_map(data: bytes) -> dict[str, str]:
    """What a compiled character map rewrites: the keys of its double array of units, followed from the root, and their strings."""
    if not data:
        return {}
    (size,) = struct.unpack_from("<I", data)
    units = np.frombuffer(data, "<u4", size // 4, 4).astype(np.int64)
    strings = data[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    nodes, keys, out = np.array([offset(units[0])]), [b""], {}
    labels = np.arange(1, 256)
    while len(nodes):
        places = nodes[:, None] ^ labels
        inside = places < len(units)
        found = inside & ((units[np.where(inside, places, 0)] & 0x800000FF) == labels)
        rows, cols = np.nonzero(found)
        units_here = units[places[rows, cols]]
        nodes = places[rows, cols] ^ offset(units_here)
        keys = [keys[r] + bytes((int(labels[c]),)) for r, c in zip(rows, cols, strict=True)]
        for k in np.flatnonzero(units_here & 0x100):
            at = int(units[nodes[k]] & 0x7FFFFFFF)
            out[keys[k].decode()] = strings[at : strings.index(b"\0", at)].decode()
    return out


# ---- the normaliser -------------------------------------------------------------------------------------------------


class Normaliser:
    """The first transducer: it reads characters and writes the text that pieces cover.

    An arc reads the longest key of the character map, a symbol of the user or else one character, and writes what stands
    for it. The state is whether a space was written last: there, with ``squeeze``, arcs write no further space. The first
    arc writes the prefix, and with ``squeeze`` spaces at the ends are not written at all.
    """

    def __init__(self, model: Model, user: list[str]) -> None:
        self.model = model
        self.rewrites = character_map(model.charsmap)
        first: dict[str, int] = {}
        for key in self.rewrites:
            first[key[0]] = max(first.get(key[0], 0), len(key))
        #: Arcs of more than one character, or that write something else, begin with one of these.
        self.longest = first
        self.begins = re.compile("[" + "".join(map(re.escape, first)) + "]") if first else None
        self.user = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user else None

    def arcs(self, text: str) -> Iterator[tuple[str, bool]]:
        """(what is written, whether as one arc) from left to right; runs of characters that stand for themselves come together."""
        at = plain = 0
        while at < len(text):
            next_user = self.user.search(text, at) if self.user else None
            limit = next_user.start() if next_user else len(text)
            while self.begins and (m := self.begins.search(text, at, limit)):
                for n in range(self.longest[m.group()], 0, -1):
                    if (written := self.rewrites.get(text[m.start() : m.start() + n])) is not None:
                        if m.start() > plain:
                            yield text[plain : m.start()], False
                        yield written, True
                        at = plain = m.start() + n
                        break
                else:
                    at = m.start() + 1
                if at > limit:  # the key went on into the symbol
                    break
            if next_user is None:
                break
            if at <= limit:
                if limit > plain:
                    yield text[plain:limit], False
                yield next_user.group(), True
                at = plain = next_user.end()
        if plain < len(text):
            yield text[plain:], False

    def __call__(self, text: str) -> str:
        model = self.model
        if self.begins or self.user:
            out, spaced = [], model.squeeze
            for written, single in self.arcs(text):
                if model.squeeze and not single:
                    written = re.sub(" {2,}", " ", written)
                if spaced:
                    written = written.lstrip(" ")
                if written:
                    out.append(written)
                    spaced = model.squeeze and written.endswith(" ")
            text = "".join(out)
        elif model.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if model.prefix:
            text = " " + text
        if model.escape:
            text = text.replace(" ", BLANK)
        return text.rstrip(BLANK if model.escape else " ") if model.squeeze else text


# ---- the transducer -------------------------------------------------------------------------------------------------


class Transducer:
    """Pieces, symbols of the user and byte fallback as one transducer; :meth:`arcs` composes it with a text that :class:`Normaliser` wrote.

    A state is a place in the normalised text together with the piece that leads there. Arcs read a piece and write
    its id, or read a character that no piece covers and write its bytes, or the unknown id. Weights add up along a
    path and the least sum wins: the tropical semiring. :meth:`path` relaxes arcs as it composes them; composing first and
    then taking :func:`shortest` gives the same.

    Of a unigram model a piece weighs its negative score. Of a BPE model weights stand on pairs of pieces: 0 if
    merging the two pieces' text gives just these two, else infinity. Merges are local, so a sequence is what merging
    gives exactly if all its pairs are (Berglund and van der Merwe 2023), and the one path of weight 0 is the encoding.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL}
        self.user = {p: i for i, (p, _, t) in enumerate(model.pieces) if t == USER}
        #: Symbols of the user are read first, the longest at each place, and join nothing.
        self.normaliser = Normaliser(model, list(self.user))
        self.symbols = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        self.scores = [s for _, s, _ in model.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(model.pieces) if t == UNKNOWN), 0)
        self.covered = set("".join(self.ids))
        low = min((s for _, s, t in model.pieces if t == NORMAL), default=0.0)
        self.unknown_cost = 10.0 - low
        self.pairs: dict[int, bool] = {}
        if model.kind == BPE:  # pieces that merging can't make are on no path
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
            merged = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-self.scores[self.ids[p]], self.ids[p]))
            #: Characters that are in pieces but are none stand in paths under ids of their own, and are written as bytes.
            self.texts = [p for p, _, _ in model.pieces]
            for char in sorted(self.covered - self.ids.keys()):
                self.ids[char] = len(self.texts)
                self.texts.append(char)
            #: When each piece is made: characters first, then as merging goes.
            self.rank = {p: k for k, p in enumerate([*sorted(self.covered), *merged])}
            times = Counter(self.scores[self.ids[p]] for p in merged)
            #: Pieces that share a score; merging takes them from left to right.
            self.tied = {p for p in merged if times[self.scores[self.ids[p]]] > 1}
            self.halves: dict[str, tuple[str, str]] = {}
        else:  # symbols of the user are arcs among others, that weigh less than any way around them
            high = max((s for _, s, t in model.pieces if t == NORMAL and s > 0), default=0.0)
            self.weights = {i: -self.scores[i] for i in self.ids.values()} | {i: 0.1 - len(p.encode()) * high for p, i in self.user.items()}
        #: The pieces as a trie: a node has a piece, or -1, and the nodes after it.
        self.trie: list = [-1, {}]
        for text, i in (self.ids if model.kind == BPE else self.ids | self.user).items():
            node = self.trie
            for char in text:
                node = node[1].setdefault(char, [-1, {}])
            node[0] = i
        #: Whether a blank only begins pieces, and a new line is in none: then paths can be found chunk by chunk.
        self.chunked = not any(BLANK in p.lstrip(BLANK) for p in [*self.ids, *self.user])
        self.lines = "\n" not in self.covered and not any("\n" in p for p in self.user)

    def normalise(self, text: str) -> str:
        return self.normaliser(text)

    def arcs(self, text: str) -> Iterator[tuple[tuple[int, int], tuple[int, int], list[int], float]]:
        """The composition with normalised ``text``: (state, next state, ids, weight), the states before those after them.

        A state is (place, piece that leads there), of a unigram model (place, -1). Arcs of infinite weight are left out.
        """
        reached: list[set[int]] = [{-1}, *(set() for _ in text)]
        bpe = self.model.kind == BPE
        symbols = {m.start(): m.end() for m in self.symbols.finditer(text)} if bpe and self.symbols else {}
        borders = sorted(symbols, reverse=True)
        for i in range(len(text)):
            if not reached[i]:
                continue
            while borders and borders[-1] <= i:
                borders.pop()
            found, single, node = [], False, self.trie
            if i in symbols:
                found.append((symbols[i], -1, [self.user[text[i : symbols[i]]]], 0.0))
            else:
                for j in range(i, borders[-1] if borders else len(text)):
                    if (node := node[1].get(text[j])) is None:
                        break
                    if (piece := node[0]) >= 0:
                        single = single or j == i
                        ids = [piece] if piece < len(self.scores) else self.fallback(text[i])
                        found.append((j + 1, piece, ids, 0.0 if bpe else self.weights[piece]))
                if not single:
                    found.append((i + 1, -1, self.fallback(text[i]), 0.0 if bpe else self.unknown_cost))
            for j, piece, ids, weight in found:
                last = piece if bpe else -1
                for before in sorted(reached[i]):
                    if bpe and before >= 0 and piece >= 0 and not self.fits(before, piece):
                        continue
                    reached[j].add(last)
                    yield (i, before), (j, last), ids, weight

    def merge(self, text: str) -> list[str]:
        """The reference process for short texts: the adjacent two whose merged piece scores best become one, the leftmost of equals first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _last_merge(self, text: str) -> tuple[str, str]:
        """The two parts that merging puts together last to make a piece; of a single character, it and itself."""
        if (known := self.halves.get(text)) is None:
            parts = list(text) if len(text) > 1 else [text, text]
            while len(parts) > 2:
                k = max((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.ids), key=lambda k: (self.scores[self.ids[parts[k] + parts[k + 1]]], -k))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            known = self.halves[text] = (parts[0], parts[1])
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives just these two.

        It does unless a merge across their border comes before the merges that made the parts it needs. Walking
        down the last merges on both sides of the border, always on the side that was made later, meets each pair of
        parts that ever stand at the border together, with the rank by which one of them is used up.
        """
        a, b, rank, split, limit = self.texts[left], self.texts[right], self.rank, self._last_merge, float("inf")
        if a in self.tied or b in self.tied:
            return self.merge(a + b) == [a, b]
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a, old = rank[a], split(a)[1], a
                if a == old:
                    return True
            else:
                limit, b, old = rank[b] + 0.5, split(b)[0], b
                if b == old:
                    limit, a, old = rank[a], split(a)[1], a
                    if a == old:
                        return True

    def fallback(self, char: str) -> list[int]:
        if self.model.byte_fallback and self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def path(self, text: str) -> list[int]:
        """Ids on the shortest path over normalised ``text``, from left to right in time linear in its length.

        Ties, of unigram models only, go to the arc that begins first, and of those to the shorter piece.
        """
        if self.model.kind != BPE:
            return self._unigram_path(text)
        if self.symbols is None:
            return self._bpe_path(text)
        if text in self.user:
            return [self.user[text]]
        parts = self.symbols.split(text)
        return self._bpe_path(text) if len(parts) == 1 else [x for k, part in enumerate(parts) for x in ([self.user[part]] if k % 2 else self._bpe_path(part))]

    def _unigram_path(self, text: str) -> list[int]:
        n = len(text)
        cost = [0.0, *[float("inf")] * n]
        last, source = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            base, single, node = cost[i], False, self.trie
            for j in range(i, n):
                if (node := node[1].get(text[j])) is None:
                    break
                if (piece := node[0]) < 0:
                    continue
                single = single or j == i
                if (new := base + self.weights[piece]) < cost[j + 1]:
                    cost[j + 1], last[j + 1], source[j + 1] = new, piece, i
            if not single and (new := base + self.unknown_cost) < cost[i + 1]:
                cost[i + 1], last[i + 1], source[i + 1] = new, -1, i
        return self._read_back(text, last, source)

    def _bpe_path(self, text: str) -> list[int]:
        """As :meth:`path`, with weights of 0 and infinity only: each place has one path of weight 0, so the first to reach it is it."""
        n, trie, pairs = len(text), self.trie[1], self.pairs
        last, source = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        for i in range(n):
            before, kids = last[i], trie
            if text[i] not in trie:
                last[i + 1], source[i + 1] = -1, i
                continue
            for j in range(i, n):
                node = kids.get(text[j])
                if node is None:
                    break
                piece, kids = node
                if piece >= 0 and last[j + 1] == -2:
                    if before >= 0:
                        key = before * 1_000_003 + piece
                        fits = pairs.get(key)
                        if fits is None:
                            if len(pairs) >= PAIRS:
                                pairs.clear()
                            fits = pairs[key] = self.fits(before, piece)
                        if not fits:
                            continue
                    last[j + 1], source[j + 1] = piece, i
        return self._read_back(text, last, source)

    def _read_back(self, text: str, last: list[int], source: list[int]) -> list[int]:
        found: list[int] = []
        n = len(text)
        while n:
            begin = source[n]
            if 0 <= last[n] < len(self.scores):
                found.append(last[n])
            else:
                found += reversed(self.fallback(text[begin:n]))
            n = begin
        found.reverse()
        if self.unknown in found:  # neighbouring unknowns are one
            found = [x for k, x in enumerate(found) if x != self.unknown or k == 0 or found[k - 1] != x]
        return found

    def encode(self, text: str, memo: dict[str, tuple[int, ...]] | None = None) -> list[int]:
        """Ids of ``text``. Chunks that no piece goes across are composed one by one, and remembered in ``memo``."""
        full = self.normalise(text)
        if not self.chunked or not self.model.byte_fallback:
            return self.path(full)
        memo = {} if memo is None else memo
        out: list[int] = []
        newline = self.fallback("\n") if self.lines else []
        for k, line in enumerate(full.split("\n") if self.lines else [full]):
            if k:
                out += newline
            head, *words = line.split(BLANK)
            if head:
                if (got := memo.get(head)) is None:
                    got = self._kept(memo, head)
                out += got
            blanks = 1
            for word in words:
                if not word:
                    blanks += 1
                    continue
                key = BLANK * blanks + word
                if (got := memo.get(key)) is None:
                    got = self._kept(memo, key)
                out += got
                blanks = 1
            if blanks > 1:
                out += self.path(BLANK * (blanks - 1))
        return out

    def _kept(self, memo: dict[str, tuple[int, ...]], chunk: str) -> tuple[int, ...]:
        if len(memo) >= MEMO:
            memo.clear()
        memo[chunk] = got = tuple(self.path(chunk))
        return got

    def decode(self, ids: list[int]) -> str:
        """The inverse: pieces' text, bytes as UTF-8 with U+FFFD for each that fits nowhere, blanks as spaces, without the prefix."""
        out, raw, pieces = [], bytearray(), self.model.pieces
        for i in ids:
            text, _, sort = pieces[i]
            if sort == BYTE:
                raw.append(int(text[3:5], 16))
                continue
            if raw:
                out.append(_utf8(raw))
                raw.clear()
            if sort != CONTROL:
                out.append(" ⁇ " if sort == UNKNOWN else text)
        if raw:
            out.append(_utf8(raw))
        text = "".join(out)
        if self.model.escape:
            text = text.replace(BLANK, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def shortest(arcs: Iterable[tuple], end: int) -> list[int]:
    """Ids on the path of least weight from the place 0 to ``end`` over arcs in the order of their states; of equals the one found first."""
    best: dict[tuple[int, int], tuple[float, tuple | None, list[int]]] = {(0, -1): (0.0, None, [])}
    for state, after, ids, weight in arcs:
        new = best[state][0] + weight
        if after not in best or new < best[after][0]:
            best[after] = (new, state, ids)
    state = min((s for s in best if s[0] == end), key=lambda s: best[s][0])
    out: list[int] = []
    while state is not None:
        _, state, ids = best[state]
        out[:0] = ids
    return out


def _utf8(raw: bytearray) -> str:
    text = raw.decode("utf-8", "surrogateescape")
    return text if text.isascii() else re.sub("[\udc80-\udcff]", "\ufffd", text)


def sentencepiece(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces, decoded): piece ids of each text, and the text that they give back.

    ``model_path`` names a SentencePiece model, unigram or BPE, with any character map; the driver compiles and
    broadcasts it: the size of a vocabulary, whatever the data. The default one has byte fallback, so ``decoded``
    is the text itself, but that U+2581 comes back as a space.

    Null text gives null ids and null decoded; empty text gives none and an empty string. A null doc_id stays null.
    Repeated rows give the same. Texts are encoded whole, of any length. Other columns are left out. An empty table
    gives an empty table.
    """
    machine = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Transducer(read_model(model_path))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = machine.value
        fst, memo = on_worker(f"fst {zlib.crc32(packed)} {len(packed)}", lambda: (pickle.loads(packed), {}))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, max(1, len(texts)), 1000):
                flat: list[int] = []
                ends, back, sizes = [0], [], []
                for text in texts[at : at + 1000]:
                    if text is not None:
                        ids = fst.encode(text, memo)
                        flat += ids
                        back.append(fst.decode(ids))
                    else:
                        back.append(None)
                    sizes.append(len(flat) - ends[-1])
                    ends.append(len(flat))
                part = texts[at : at + 1000]
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)), mask=pa.array([t is None for t in part], pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), lists, pa.array(sizes, pa.int32()), pa.array(back, pa.string())], ["doc_id", "ids", "n_pieces", "decoded"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, n_pieces int, decoded string")
