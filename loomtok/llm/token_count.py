"""Token counts of huge documents: overlapping chunks, spliced where both sides provably agree."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.functions.chars import WHITESPACE
from loomtok.llm.common import on_worker, strings

#: The split of the public byte-level vocabularies that the default parameters name.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern has it.
SPACES = WHITESPACE.replace("\u180e", "")
#: Runs of white space that the pattern's engine would go back over step by step, until its stack ends.
LONG_RUN = re.compile(f"[{re.escape(SPACES)}]{{100000,}}")
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a chunk, and of what two neighbours share.
CHUNK, OVERLAP = 16_384, 256


class Counter:
    """A byte-level BPE encoder with the byte lengths of its tokens, for counting with offsets."""

    def __init__(self, ranks: dict[bytes, int], chunk: int, overlap: int) -> None:
        import tiktoken

        if chunk <= overlap or overlap < 1:
            raise ValueError("a chunk must be longer than the overlap, and the overlap at least 1")
        self.encoding = tiktoken.Encoding("loomtok", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.chunk, self.overlap = chunk, overlap

    def ids(self, text: str) -> list[int]:
        """The ids of ``text``. Of a very long run of white space the pattern takes all, or all but one sign if something follows, as one piece."""
        if len(text) < 100_000 or not LONG_RUN.search(text):
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for m in LONG_RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def offsets(self, text: str) -> np.ndarray:
        """The bytes at which tokens of ``text`` begin, and its end."""
        ids = np.array(self.ids(text), np.int64)
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def count(self, text: str | None) -> tuple[int, int, int]:
        """(tokens, chunks, times an overlap was widened).

        A chunk begins at a place that is a boundary in itself, so its tokens up to any stable place are those of
        the whole text. The next one begins ``overlap`` characters before its end; the two are spliced at the last
        place in the overlap that is stable and a token boundary of both. If there is none, the overlap doubles, and
        when it has reached the chunk's beginning, the chunk grows instead: the text is never cut at an unproven place.
        """
        if not text:
            return 0, 0, 0
        total, chunks, widened, begin, span = 0, 0, 0, 0, self.chunk
        while True:
            end = min(begin + span, len(text))
            chunk = text[begin:end]
            left = self.offsets(chunk)
            chunks += 1
            if end == len(text):
                return total + len(left) - 1, chunks, widened
            overlap = self.overlap
            while True:
                start = max(1, len(chunk) - overlap)
                if (cut := self._splice(text, begin, end, begin + start, left)) is not None:
                    break
                widened += 1
                if start == 1:
                    break
                overlap *= 2
            if cut is None:
                span *= 2
                continue
            total += cut[1]
            begin, span = cut[0], self.chunk

    def _splice(self, text: str, begin: int, end: int, start: int, left: np.ndarray) -> tuple[int, int] | None:
        """(place, tokens of the left chunk before it) of the last common stable boundary between start and end."""
        right = self.offsets(text[start:end])
        ahead = len(text[begin:start].encode("utf-8", "surrogatepass"))
        common = np.intersect1d(left[left > ahead], right + ahead, assume_unique=True)
        if not len(common):
            return None
        rows = text[start:end]
        at = ahead + np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in rows])])
        for byte in common[::-1]:
            place = int(np.searchsorted(at, byte))
            if place < len(rows) and at[place] == byte and stable(text, start + place):
                return start + place, int(np.searchsorted(left, byte))
        return None


def stable(text: str, at: int) -> bool:
    """Whether the split of any text is cut before ``at``, whatever stands elsewhere.

    Proof for PATTERN: no alternative matches something that isn't white space followed by a space, so none goes
    across a place between the two. The alternative with a lookahead ends in white space, and the one before ``at``
    doesn't, so nothing before depends on what follows; nothing looks behind. The character after the space is asked
    to be a letter as well, which keeps the place away from ends of chunks and runs of blanks.
    """
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and unicodedata.category(text[at + 1])[0] == "L" and unicodedata.category(text[at - 1])[0] in "LNPS"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_counts(docs: DataFrame, ranks_path: str = DEFAULT_RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, n_widened): exact numbers of tokens under a byte-level vocabulary.

    ``ranks_path`` names a file of base64 tokens with their ranks, which the driver reads and broadcasts once: the
    size of a vocabulary, whatever the data. Texts of over ``chunk`` characters are encoded in chunks of that many,
    overlapping by ``overlap``; see :meth:`Counter.count`. The number is that of the whole text encoded at once.

    Null and empty text has 0 tokens and 0 chunks; a null doc_id stays null. Repeated rows are counted alike. Other
    columns are left out. An empty table gives an empty table.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = on_worker(f"counter {ranks_path} {chunk} {overlap}", lambda: Counter(ranks.value, chunk, overlap))
        for batch in batches:
            rows = [counter.count(t) for t in strings(batch.column(1))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["doc_id", "n_tokens", "n_chunks", "n_widened"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_chunks int, n_widened int")
