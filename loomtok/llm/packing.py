"""Packing: windows of a fixed size over documents in order, cut where padding and broken documents cost least."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.functions import buffers
from loomtok.llm.common import on_worker, settled
from loomtok.llm.token_count import CHUNK, DEFAULT_RANKS, OVERLAP, SPACES, Counter, load_ranks

#: White space of the vocabulary's pattern beyond ASCII, as bytes.
_WIDE = [c.encode() for c in SPACES if ord(c) > 127]
SCHEMA = "shard bigint, window_no int, doc_ids array<bigint>, starts array<bigint>, ends array<bigint>, n_tokens int, padding int, text string"
#: At most this many places at which shards begin, of 16 bytes each, are brought to the driver and broadcast; of more documents each shard has more.
MOST_SHARDS = 1_000_000
#: Shards of a task, where there are more of them than the session's shuffle partitions.
SHARDS_A_TASK = 64


@dataclass
class Units:
    """What windows are made of, in order: sentences or their parts."""

    doc: np.ndarray  # the document's place
    start: np.ndarray  # bytes of the texts one after the other
    end: np.ndarray
    first: np.ndarray  # characters of the document
    last: np.ndarray
    tokens: np.ndarray
    whole: np.ndarray  # whether the document ends there


def units(texts: pa.LargeStringArray, size: int, counter: Counter) -> Units:
    """Sentences of all texts, a whole text each time, cut and counted in the array's own buffer; blank texts have none.

    A sentence ends where white space follows, after ``.``, ``!`` or ``?`` or if there is a new line in that white space, which
    is the next sentence's, but at the end of a text. There no token goes across: the vocabulary's pattern never goes from
    something else on to white space. So texts are encoded whole, and tokens told apart by the bytes at which they end.
    A sentence of over ``size`` tokens is cut into parts.
    """
    found: list[tuple[np.ndarray, ...]] = []
    low = 0
    for row, last, block, bounds in buffers.blocks(texts):
        data = np.frombuffer(block, np.uint8)
        space = buffers.spaces(data, _WIDE)
        ids = [counter.ids(t) for t in texts.slice(row, last - row).to_pylist() if t]
        tokens = np.cumsum(counter.sizes[np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))])  # the bytes at which they end
        # runs of white space, of which one at a text's beginning may go on from the text before
        runs = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        stops = np.append(np.flatnonzero(space[:-1] & ~space[1:]) + 1, len(data))
        lines = np.flatnonzero(data == 10)
        after = stops[np.searchsorted(stops, runs, "right")]
        sign = data[runs - 1]
        runs = runs[((sign == 46) | (sign == 33) | (sign == 63) | (np.searchsorted(lines, after) > np.searchsorted(lines, runs)))]
        begins = np.unique(bounds[:-1][np.diff(bounds) > 0])
        start = np.union1d(runs, begins)
        doc = np.searchsorted(bounds, start, "right") - 1
        after = np.where(space[start], stops[np.searchsorted(stops, start, "right")], start)
        kept = after < bounds[doc + 1]  # else there is white space only up to the end: of a whole text, or of one after its last sentence
        start, doc = start[kept], doc[kept]
        if len(start):
            whole = np.append(doc[1:] != doc[:-1], True)
            stop = np.where(whole, bounds[doc + 1], np.append(start[1:], 0))
            counts = np.searchsorted(tokens, stop, "right") - np.searchsorted(tokens, start, "right")
            chars = np.zeros(len(data) + 1, np.int32)
            np.cumsum(data & 0xC0 != 0x80, out=chars[1:])
            base = chars[bounds[doc]]
            found.append((doc + row, start + low, stop + low, chars[start] - base, chars[stop] - base, counts, whole))
        low += len(data)
    if not found:
        return Units(*(np.empty(0, np.int64) for _ in range(6)), np.empty(0, bool))
    out = Units(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return _divided(out, texts, size, counter) if (out.tokens > size).any() else out


def _divided(u: Units, texts: pa.LargeStringArray, size: int, counter: Counter) -> Units:
    """``u`` with sentences of over ``size`` tokens cut into parts, each at the last of ``size`` tokens that ends with a character."""
    raw, shift = texts.buffers()[2], int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
    fields = [u.doc, u.start, u.end, u.first, u.last, u.tokens, u.whole]
    out, begin = [], 0
    for k in np.flatnonzero(u.tokens > size).tolist():
        out.append([x[begin:k] for x in fields])
        begin = k + 1
        a, n = int(u.start[k]), int(u.tokens[k])
        data = np.frombuffer(raw, np.uint8, int(u.end[k]) - a, shift + a)
        ends = np.cumsum(counter.sizes[counter.ids(data.tobytes().decode())])
        chars = np.cumsum(data & 0xC0 != 0x80)
        fits = np.flatnonzero((ends == len(data)) | (data[np.minimum(ends, len(data) - 1)] & 0xC0 != 0x80))  # tokens that end with a character
        lasts = [-1]
        while lasts[-1] + 1 < n:
            lasts.append(int(fits[np.searchsorted(fits, min(lasts[-1] + 1 + size, n)) - 1]))
        marks = np.array(lasts)
        places, places_c = np.append(0, ends[marks[1:]]), np.append(0, chars[ends[marks[1:]] - 1])
        m = len(marks) - 1
        out.append([np.full(m, u.doc[k]), a + places[:-1], a + places[1:], u.first[k] + places_c[:-1], u.first[k] + places_c[1:], np.diff(marks), np.append(np.zeros(m - 1, bool), u.whole[k])])
    out.append([x[begin:] for x in fields])
    return Units(*(np.concatenate(x) for x in zip(*out, strict=True)))


def best_cuts(lengths: np.ndarray, whole: np.ndarray, size: int, penalty: int) -> tuple[int, list[int]]:
    """Least cost, and the ends of the windows: each holds units in order, ``size`` tokens at most.

    A window costs its padding, ``size`` less its tokens, and ``penalty`` if it ends within a document. With S the
    running sum, best[j] = min over i of best[i] + S[i], plus size - S[j] and the penalty of j; the i that fit are a
    range that only moves forward, so a queue with values that never fall has the least one in front: O(n). Of
    several best starts the earliest is taken, the longest window.
    """
    n = len(lengths)
    sums = [0, *np.cumsum(lengths).tolist()]
    ends_doc = whole.tolist()
    best, source = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best[i] + S[i], i)
    for j in range(1, n + 1):
        floor = sums[j] - size
        while sums[queue[0][1]] < floor:
            queue.popleft()
        value, source[j] = queue[0]
        best[j] = value + size - sums[j] + (0 if ends_doc[j - 1] else penalty)
        value = best[j] + sums[j]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], n
    while j:
        cuts.append(j)
        j = source[j]
    return best[n], cuts[::-1]


def pack(ids: list[int | None], texts: pa.Array, size: int, penalty: int, counter: Counter) -> list[tuple[list, list[int], list[int], int, bytes]]:
    """(doc_ids, starts, ends, tokens, text) of each window over documents, which are in order."""
    texts = texts.cast(pa.large_string())
    u = units(texts, size, counter)
    if not len(u.doc):
        return []
    _, cuts = best_cuts(u.tokens, u.whole, size, penalty)
    raw, shift = memoryview(texts.buffers()[2]), int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
    # a window's parts: units of one document one after the other
    edges = np.zeros(len(u.doc) + 1, bool)
    edges[0] = edges[-1] = True
    edges[1:-1] = u.doc[1:] != u.doc[:-1]
    edges[cuts] = True
    parts = np.flatnonzero(edges)
    doc, first, start = (x[parts[:-1]].tolist() for x in (u.doc, u.first, u.start))
    last, end = (x[parts[1:] - 1].tolist() for x in (u.last, u.end))
    sums = np.concatenate([[0], np.cumsum(u.tokens)])[[0, *cuts]]
    out, k = [], 0
    for n, stop in zip(np.diff(sums).tolist(), np.searchsorted(parts, cuts).tolist(), strict=True):
        text = b"\n\n".join([raw[shift + start[i] : shift + end[i]] for i in range(k, stop)])
        out.append(([ids[d] for d in doc[k:stop]], first[k:stop], last[k:stop], n, text))
        k = stop
    return out


def first_keys(rows: DataFrame, shard_docs: int) -> tuple[np.ndarray, int]:
    """Where shards begin: the (doc_id, hash) of every ``shard_docs``-th row in that order, and the number of rows without a doc_id.

    Rows are counted within ranges of a sort, and over ranges. At most ``MOST_SHARDS`` keys come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(seen, seen + n)), *b.columns], ["part", "k", "doc_id", "h"])
            seen += n

    ids = rows.select("doc_id", "h").repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    placed = settled(ids.mapInArrow(run, "part bigint, k bigint, doc_id bigint, h bigint"))
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min(F.struct("doc_id", "h")).alias("first")).orderBy("first").collect()
    nulls, total = sum(r.nulls for r in parts), sum(r.n for r in parts)  # null sorts first, so the rows without an id are the first ranks
    if total == nulls:
        return np.empty((0, 2), np.int64), nulls
    size = max(shard_docs, -(-(total - nulls) // MOST_SHARDS))
    before = list(zip((r.part for r in parts), accumulate((r.n for r in parts), initial=0)))  # noqa: B905
    known = placed.sparkSession.createDataFrame(before, "part bigint, before bigint")  # a row for each partition of the sort
    rank = F.col("before") + F.col("k") - nulls
    starts = placed.join(F.broadcast(known), "part").where((rank >= 0) & (rank % size == 0)).select("doc_id", "h").toArrow()
    keys = np.stack([starts.column(i).to_numpy() for i in (0, 1)], 1)
    return keys[np.lexsort((keys[:, 1], keys[:, 0]))], nulls


def in_shards(rows: DataFrame, shard_docs: int) -> tuple[DataFrame, int]:
    """(shard, doc_id, h, text) and the number of shards: each row in the shard that its rank by (doc_id, h) falls in.

    Equal rows of which there are more than a shard holds go to their shards in turn. Rows without a doc_id are spread by
    their hash over shards from -1 downwards.
    """
    keys, nulls = first_keys(rows, shard_docs)
    held = rows.sparkSession.sparkContext.broadcast(keys)
    spare = max(1, -(-nulls // shard_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.dtype([("d", np.int64), ("h", np.int64)])
        starts = np.ascontiguousarray(held.value).view(order).ravel()
        turn = TaskContext.get().partitionId()
        for b in batches:
            doc, h = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            key = np.empty(len(h), order)
            key["d"], key["h"] = doc.fill_null(0).to_numpy(zero_copy_only=False), h
            last = np.searchsorted(starts, key, "right") - 1
            first = np.minimum(np.searchsorted(starts, key, "left"), last)  # the same, but where equal rows begin several shards
            shard = first + (np.arange(len(h)) + turn) % np.maximum(last - first + 1, 1)
            turn += len(h)
            missing = doc.is_null().to_numpy(zero_copy_only=False)
            shard[missing] = -1 - h[missing] % spare
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), doc, b.column(1), b.column(2)], ["shard", "doc_id", "h", "text"])

    return rows.mapInArrow(run, "shard bigint, doc_id bigint, h bigint, text string"), len(keys) + spare * (nulls > 0)


def packing(docs: DataFrame, size: int = 2048, penalty: int = 64, shard_docs: int = 1024, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(shard, window_no, doc_ids, starts, ends, n_tokens, padding, text): windows of ``size`` tokens over the documents in order of doc_id.

    Tokens are ids of the byte-level vocabulary in ``ranks_path``, which the driver reads and broadcasts; ``n_tokens`` is
    the number of ids of the window's parts. A window may end after a document or, for ``penalty``, after a sentence;
    cuts are the best over a whole shard (:func:`best_cuts`). ``starts`` and ``ends`` are the characters of each document
    in the window; ``text`` joins these parts by empty lines, which aren't counted. A sentence of over ``size`` tokens
    is the only thing that is cut elsewhere, at the last of ``size`` tokens that ends with a character.

    A shard is ``shard_docs`` successive documents in order of doc_id, however far apart the doc_ids are and whatever the
    cluster, so that shards are packed alone and in parallel; only a shard's last windows pay for that. Beyond
    ``MOST_SHARDS`` times that many documents shards grow instead of their number. Shards are numbered from 0. Rows that
    repeat a doc_id follow one another in order of their text's hash, and go on in the next shard like others.

    Null, empty and blank text gives nothing. Rows without a doc_id make shards of their own, -1 and below, in order of
    their text's hash. Every other text is in the windows whole, in order. Other columns are left out. An empty table gives
    an empty table.
    """
    if size < 16:
        raise ValueError("a window has at least 16 tokens")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where(F.rlike("text", F.lit(f"[^{re.escape(SPACES)}]")))
    rows, count = in_shards(rows, shard_docs)
    tasks = count // SHARDS_A_TASK
    few = tasks <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # then their number is left to the engine, which joins small ones
    rows = (rows.repartition("shard") if few else rows.repartition(tasks, "shard")).sortWithinPartitions("shard", "doc_id", "h", "text")
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def emit(shard: int, ids: list, texts: list[pa.Array]) -> pa.RecordBatch:
        counter = on_worker(f"counter {ranks_path}", lambda: Counter(ranks.value, CHUNK, OVERLAP))
        windows = pack(ids, pa.concat_arrays(texts), size, penalty, counter)
        n = len(windows)
        cols = list(zip(*windows, strict=True)) if n else [[]] * 5
        big, small = pa.list_(pa.int64()), pa.int32()
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * n, pa.int64()), pa.array(range(n), small), *(pa.array(c, big) for c in cols[:3]), pa.array(cols[3], small), pa.array([size - t for t in cols[3]], small), pa.array(cols[4], pa.binary()).cast(pa.string())],
            ["shard", "window_no", "doc_ids", "starts", "ends", "n_tokens", "padding", "text"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts = None, [], []
        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):  # noqa: B905
                if a == b:
                    continue
                if shard[a] != now and ids:
                    yield emit(now, ids, texts)
                    ids, texts = [], []
                now = int(shard[a])
                ids += batch.column(1).slice(a, b - a).to_pylist()
                texts.append(batch.column(3).slice(a, b - a).cast(pa.large_string()))
        if ids:
            yield emit(now, ids, texts)

    return rows.mapInArrow(run, SCHEMA)


def stage(docs: DataFrame) -> DataFrame:
    return packing(docs)
