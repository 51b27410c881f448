"""SimHash near-dedup: signatures of documents joined with themselves through binary tries."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import fresh, parts, settled
from loomtok.sources.shared import drop

BITS = 128
WORD = re.compile(r"\w+")
#: Characters of text whose word vectors are held at once; pairs of leaves up to which two nodes are compared leaf by leaf; pairs of leaves and of nodes held at once.
BLOCK_CHARS, LEAF_PAIRS, PAIRS_AT_ONCE, NODES_AT_ONCE = 1_000_000, 256, 500_000, 100_000


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def signatures(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(n, 16) bytes of signature, and which rows have one.

    A text is its set of lower-case words; each adds its 128-bit hash as +-1 per bit, times its length in
    characters, 8 at most, so that the commonest words don't make all texts of a language alike. A bit is set where
    the sum is over 0. A text without a word counts as one word; null and blank texts have no signature.
    """
    out, there = np.zeros((len(texts), BITS // 8), np.uint8), np.zeros(len(texts), bool)
    at = 0
    while at < len(texts):
        ids, rows, flat, ends, chars = _Ids(), [], [], [], 0
        while at < len(texts) and chars < BLOCK_CHARS:
            text = texts[at] or ""
            words = set(WORD.findall(text.lower())) or ({text} if text.strip() else ())
            if words:
                rows.append(at)
                flat.extend(map(ids.__getitem__, words))
                ends.append(len(flat))
            chars += len(text)
            at += 1
        if not rows:
            continue
        raw = b"".join([xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in ids])
        signs = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) * 2 - 1
        signs *= np.fromiter((min(len(w), 8) for w in ids), np.float32, len(ids))[:, None]
        index, begin = np.array(flat), 0
        sums = np.empty((len(rows), BITS), np.float32)
        for k, end in enumerate(ends):
            sums[k] = signs[index[begin:end]].sum(0)
            begin = end
        out[rows], there[rows] = np.packbits(sums > 0, axis=1), True
    return out, there


def signature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h0, h1, s0, s1): each row that has words, by its doc_id, which may be null, and the hash of its text, with its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sigs, there = signatures(batch.column(3).to_pylist())
            words = np.ascontiguousarray(sigs[there]).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(there)) for k in range(3)), pa.array(words[:, 0]), pa.array(words[:, 1])], ["doc_id", "h0", "h1", "s0", "s1"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(h.alias(n) for h, n in zip(text_hash(), ("h0", "h1"), strict=True)), "text")
    return rows.where("text is not null").mapInArrow(run, "doc_id bigint, h0 bigint, h1 bigint, s0 bigint, s1 bigint")


def text_hash() -> tuple[Column, Column]:
    """128 bits that name a row's text without moving it."""
    return F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))


#: Signatures that a sub-trie of a cover is expected to have at most, pairs that cost as much as a row of a trie, and tries at most.
HELD, ROW_COST, TRIES = 1 << 18, 50, 256


def cover(n: int, budget: int) -> tuple[int, int, int]:
    """(blocks, errors, cells) of tries in which all pairs of n distinct signatures within the budget meet.

    The bits are cut into blocks and each block into cells. So many blocks, that a pair within the budget differs in at
    most ``errors`` bits of one of them; then all its cells but ``errors`` are equal. There is a trie for each
    choice of that many cells of a block, which come first in it; the other cells of the block follow, with a budget of
    ``errors`` for the block. Of all cuts it is the one with the least rows and pairs to look at, if bits are
    even, among those whose sub-tries can be held.
    """
    if budget >= BITS:
        return 1, budget, budget  # all meet in one trie without leading bits
    best = []
    for blocks in range(1, budget + 2):
        errors, width = -(-(budget + 1) // blocks) - 1, BITS // blocks
        for cells in range(errors + 1, width + 1):
            tries, prefix = blocks * math.comb(cells, errors), min((cells - errors) * (width // cells), 40)
            if tries > TRIES:
                continue
            left = max(0, min(width, n.bit_length()) - prefix)  # bits of the block below the leading ones, and above single leaves
            near = sum(math.comb(left, k) for k in range(min(errors, left) + 1)) / 2**left
            best.append((max(0, n // HELD >> prefix), tries * (ROW_COST + near * n / 2 ** (prefix + 1)), blocks, errors, cells))
    return min(best)[2:]


def cover_orders(blocks: int, errors: int, cells: int) -> tuple[list[np.ndarray], int, int]:
    """The bit orders of the tries of :func:`cover`, how many bits lead, and how many are the block's."""
    bits, width = orders(1)[0], BITS // blocks
    out = []
    for k in range(blocks):
        own = bits[k * width : (k + 1) * width]
        rest = np.concatenate([bits[: k * width], bits[(k + 1) * width :]])
        cell = own[: cells * (width // cells)].reshape(cells, -1)
        for last in itertools.combinations(range(cells), errors):
            lead = np.delete(cell, last, 0).ravel()
            out.append(np.concatenate([lead, own[~np.isin(own, lead)], rest]))
    return out, min((cells - errors) * (width // cells), 40), width


#: Of tries whose number is given, or their leading bits: signatures that a sub-trie is expected to have at most, and the chance of meeting a pair at the budget at least.
SUB_TRIE, RECALL = 1024, 0.93


def layout(n: int, budget: int, recall: float = RECALL) -> tuple[int, int]:
    """(leading bits, tries) for n distinct signatures.

    Sub-tries by 16 bits, and by more where they would hold over ``SUB_TRIE`` signatures each, so that the pairs looked at
    grow in proportion to n; and as many tries as it takes for a pair at the budget to be met with this chance.
    """
    prefix = min(max(16, (n // SUB_TRIE - 1).bit_length()), 40)
    once = math.comb(BITS - budget, prefix) / math.comb(BITS, prefix)
    return prefix, max(1, math.ceil(math.log(1 - recall) / math.log1p(-once)))


def orders(tables: int) -> list[np.ndarray]:
    """The bit orders of the tries, the same on every machine."""
    rng = np.random.default_rng(20_117)
    return [rng.permutation(BITS) for _ in range(tables)]


def _trie_keys(reps: DataFrame, perms: list[np.ndarray], prefix: int) -> DataFrame:
    """(key, p0, p1, rep): each signature with its bits in the order of each trie; the key names the trie and its first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], 1).astype(">i8")
            bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(-1, BITS // 8), axis=1)
            for t, perm in enumerate(perms):
                p = np.ascontiguousarray(np.packbits(bits[:, perm], axis=1)).view(">u8").astype(np.uint64)
                key = (p[:, 0] >> np.uint64(64 - prefix)).astype(np.int64) | (t << prefix)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(p[:, 0].view(np.int64)), pa.array(p[:, 1].view(np.int64)), batch.column(2)], ["key", "p0", "p1", "rep"])

    return reps.select("s0", "s1", "rep").mapInArrow(run, "key bigint, p0 bigint, p1 bigint, rep bigint")


def spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each node and the least one it is connected with, for all nodes but those."""
    used = np.unique(np.concatenate([i, j]))
    least = _components(len(used), np.searchsorted(used, i), np.searchsorted(used, j), used)
    return least[least != used], used[least != used]


def trie_pairs(
    p0: np.ndarray, p1: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int, merge: bool = False, block: tuple[int, int] = (0, 0)
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of signatures in one sub-trie that differ in at most ``budget`` bits.

    ``p0``, ``p1`` are sorted within each range ``starts`` to ``ends``, and a range agrees in its first ``depth``
    bits. A node is a range of leaves. All pairs of nodes of a level go down together, as long as they can be held, else in
    parts: each gives the pairs of its children, those on different sides with one more differing bit, and goes as soon as
    that exceeds the budget. With a ``block`` (bits, errors) pairs that differ in more than ``errors`` of the first ``bits``
    may be left out; these nodes go sooner.

    With ``merge`` only as many pairs are given as connect the same signatures. Runs of leaves, each within the budget of
    the one before, are connected first, and pairs of nodes within one run aren't looked into: a group of n near
    copies, which mostly is one run, takes n comparisons and not n * n. Pairs found together are replaced by at most
    one per signature.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    run = None
    if merge and len(starts):
        near = np.zeros(len(p0), bool)  # whether a leaf is within the budget of the one before
        near[1:] = np.bitwise_count(p0[1:] ^ p0[:-1]).astype(np.int64) + np.bitwise_count(p1[1:] ^ p1[:-1]) <= budget
        near[starts] = False
        run = np.cumsum(~near)
        ok = np.flatnonzero(near & (np.cumsum(np.bincount(starts, minlength=len(p0) + 1) - np.bincount(ends, minlength=len(p0) + 1))[: len(p0)] > 0))
        found.append((ok - 1, ok))
    ones: dict[int, np.ndarray] = {}  # how many leaves before each have a bit set, by level
    todo = [(depth, starts, ends, starts, ends, np.zeros(len(starts), np.int64))]
    while todo:
        depth, a0, a1, b0, b1, diff = todo.pop()
        if len(a0) > NODES_AT_ONCE:  # a part is done before the next one's children are made
            todo += [(depth, *(x[k : k + NODES_AT_ONCE] for x in (a0, a1, b0, b1, diff))) for k in range(0, len(a0), NODES_AT_ONCE)]
            continue
        if not todo:
            ones.clear()
        if run is not None:
            ok = run[a0] != run[b1 - 1]  # else all leaves of both, and what is between them, are connected
            a0, a1, b0, b1, diff = a0[ok], a1[ok], b0[ok], b1[ok], diff[ok]
        few = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth == BITS)
        if few.any():
            fa, fb, nb = a0[few], b0[few], (b1 - b0)[few]
            size = (a1 - a0)[few] * nb
            total = np.cumsum(size)
            for part in np.split(np.arange(len(size)), np.searchsorted(total, np.arange(PAIRS_AT_ONCE, total[-1], PAIRS_AT_ONCE))):
                which = np.repeat(part, size[part])
                k = np.arange(len(which)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                i, j = fa[which] + k // nb[which], fb[which] + k % nb[which]
                first = np.bitwise_count(p0[i] ^ p0[j])
                ok = np.flatnonzero(first <= budget)  # of unlike ones few, so that the rest is looked up for few
                i, j, first = i[ok], j[ok], first[ok]
                ok = first.astype(np.int64) + np.bitwise_count(p1[i] ^ p1[j]) <= budget
                ok &= i < j if run is None else (i < j) & (run[i] != run[j])
                found.append(spanning(i[ok], j[ok]) if merge else (i[ok], j[ok]))
                held += len(found[-1][0])
                if merge and held > max(PAIRS_AT_ONCE, 4 * len(p0)):
                    found = [spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                    held = 0
            a0, a1, b0, b1, diff = a0[~few], a1[~few], b0[~few], b1[~few], diff[~few]
        if not len(a0):
            continue
        if depth not in ones:
            word, shift = (p0, 63 - depth) if depth < 64 else (p1, 127 - depth)
            ones[depth] = np.concatenate([[0], np.cumsum((word >> np.uint64(shift)) & np.uint64(1))]).astype(np.int32 if len(p0) < 2**31 else np.int64)
        set_ = ones[depth]
        am, bm = a1 - (set_[a1] - set_[a0]), b1 - (set_[b1] - set_[b0])
        cross = a0 != b0  # of a node with itself, one of the two mixed pairs is enough
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am[cross], a1[cross], b0[cross], bm[cross], diff[cross] + 1)]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        ok = (a1 > a0) & (b1 > b0) & (diff <= (min(block[1], budget) if depth < block[0] else budget))
        todo.append((depth + 1, a0[ok], a1[ok], b0[ok], b1[ok], diff[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def _components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least label that each of n nodes is connected with."""
    order = np.argsort(label, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    low = rank.copy()
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[order][new])
        if (new == low).all():
            return label[order][low]
        low = new


def _links(budget: int, prefix: int, chunk: int, block: tuple[int, int] = (0, 0)):
    """Maps batches sorted by key to (a, b): each signature's document with the least one of its group within a sub-trie."""

    def solve(key: np.ndarray, p0: np.ndarray, p1: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((p1, p0, key))
        key, p0, p1, rep = key[order], p0[order], p1[order], rep[order]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        starts, ends = edges[:-1], edges[1:]
        more = ends - starts > 1
        i, j = trie_pairs(p0, p1, starts[more], ends[more], prefix, budget, True, block)
        used = np.unique(np.concatenate([i, j]))
        least = _components(len(used), np.searchsorted(used, i), np.searchsorted(used, j), rep[used])
        linked = rep[used] != least
        return pa.RecordBatch.from_arrays([pa.array(least[linked]), pa.array(rep[used][linked])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        rows = 0
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            if not len(cols[0]):
                continue
            rows += len(cols[0])
            for h, c in zip(held, cols, strict=True):
                h.append(c)
            if rows >= chunk and held[0][0][0] != cols[0][-1]:
                whole = [np.concatenate(h) for h in held]
                key = whole[0]
                cut = np.searchsorted(key, key[-1])  # the last sub-trie may go on in the next batch
                yield solve(whole[0][:cut], whole[1][:cut].view(np.uint64), whole[2][:cut].view(np.uint64), whole[3][:cut])
                held, rows = [[c[cut:]] for c in whole], len(key) - cut
        if rows:
            whole = [np.concatenate(h) for h in held]
            yield solve(whole[0], whole[1].view(np.uint64), whole[2].view(np.uint64), whole[3])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(b, a): each node of ``edges`` (a, b) that isn't the least of its component, with that least one.

    Large-star and small-star steps in turn (Kiveris et al. 2014), each round written to the shared folder in place
    of the one before, until a round changes nothing. A node's least neighbour is an aggregate, combined before the
    shuffle, that is joined back to its edges: a node with a third of all edges is split like any skewed key of a join.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())

    now = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    before = mark(now)
    while before[0]:
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        least = now.select(ends.alias("e")).select("e.*").groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settled(large)
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        both = F.explode(F.array(F.struct(F.col("v").alias("b"), F.col("m").alias("a")), F.struct(F.col("u").alias("b"), F.col("m").alias("a"))))
        now = settled(large.join(first, "u").select(both.alias("e")).select("e.a", "e.b").where("a != b").distinct(), instead_of=now)
        drop(large)
        after = mark(now)
        if after == before:
            break
        before = after
    return now


def _groups(docs: DataFrame, budget: int, tables: int | None, prefix: int | None) -> DataFrame:
    """(doc_id, h0, h1, group_id, first) for each row with a signature; ``first`` are the hashes of the row of its group that stays.

    Rows of a group are in order of doc_id, those without one last, then of their text's hash. Equal signatures are one
    node, named by the least of their rows.
    """
    sigs = settled(signature_table(docs))
    nodes = settled(sigs.groupBy("s0", "s1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h0", "h1")).alias("row")).withColumn("rep", F.monotonically_increasing_id()))
    if tables is None and prefix is None:
        blocks, errors, cells = cover(nodes.count(), budget)
        perms, prefix, width = cover_orders(blocks, errors, cells)
        block = (width, errors)
    else:
        found = layout(nodes.count(), budget) if tables is None or prefix is None else (prefix, tables)
        prefix, perms, block = found[0] if prefix is None else prefix, orders(found[1] if tables is None else tables), (0, 0)
    # by the sub-trie, not by key alone: a partition's rows then lie together for the merge of runs below
    keys = _trie_keys(nodes, perms, prefix).repartition("key").sortWithinPartitions("key")
    links = connected(keys.mapInArrow(_links(budget, prefix, 200_000, block), "a bigint, b bigint"))
    placed = nodes.join(links.select(F.col("b").alias("rep"), "a"), "rep", "left").withColumn("a", F.coalesce("a", "rep"))
    first = placed.groupBy("a").agg(F.min("row").alias("first"))
    named = placed.join(first, "a").select("s0", "s1", "first")
    return sigs.join(named, ["s0", "s1"]).select("doc_id", "h0", "h1", F.col("first.doc_id").alias("group_id"), F.struct("first.h0", "first.h1").alias("first"))


def near_dups(docs: DataFrame, budget: int = 20, tables: int | None = None, prefix: int | None = None) -> DataFrame:
    """(doc_id, group_id, keep): the group of each document, named by its least doc_id, the one that is kept.

    Documents whose signatures differ in at most ``budget`` of 128 bits belong together, and so do those that a
    chain of such pairs connects. Every document is a query and no pair is missed. Equal signatures meet first; the distinct
    ones go into binary tries with the bits in another order each, laid out by :func:`cover` from the number of
    signatures and the budget: for 20 bits 21 tries that lead with 6 equal bits, up to 16 million of them.

    Only with ``tables`` or ``prefix`` is the search approximate: so many tries in random orders, matched equal in so many
    first bits; what isn't given comes from :func:`layout`. A pair at distance d is then found with probability
    1 - (1 - C(128 - d, prefix) / C(128, prefix)) ** tables.

    Rows that repeat a doc_id are told apart by their text: each is searched, and each is kept or not on its own; of
    those of one group the least hash of a text is kept. A null doc_id, and null or blank text, joins no group: such a
    row has its own doc_id as group_id (null for null) and is kept. An empty table gives an empty table. Other columns
    are left out.
    """
    h0, h1, doc = text_hash()[0], text_hash()[1], F.col("doc_id").cast("bigint")
    groups = _groups(docs.where(doc.isNotNull()), budget, tables, prefix).distinct()
    out = docs.select(doc.alias("doc_id"), h0.alias("h0"), h1.alias("h1")).join(groups, ["doc_id", "h0", "h1"], "left")
    keep = F.col("group_id").isNull() | ((F.col("group_id") == F.col("doc_id")) & (F.col("first.h0") == F.col("h0")) & (F.col("first.h1") == F.col("h1")))
    return out.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), keep.alias("keep"))


def stage(docs: DataFrame, budget: int = 20, tables: int | None = None, prefix: int | None = None, without_id: bool = False) -> DataFrame:
    """One document of each group of :func:`near_dups`, with all its columns.

    Of rows that repeat both doc_id and text one stays. Rows without a doc_id, or without words, all stay; but with
    ``without_id`` those with a null doc_id are searched like all others: they come last in a group, and a null repeats another.
    """
    g, a, b, g_, a_, b_, n = fresh(docs, *(f"__simhash_{x}" for x in ("doc", "h0", "h1", "its_doc", "its_h0", "its_h1", "n")))
    rows = docs.withColumns({g: F.col("doc_id").cast("bigint"), a: text_hash()[0], b: text_hash()[1]})
    groups = settled(_groups(docs if without_id else docs.where(F.col("doc_id").cast("bigint").isNotNull()), budget, tables, prefix))
    stays = F.col("group_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h0") == F.col("h0")) & (F.col("first.h1") == F.col("h1"))
    its = F.col("doc_id").alias(g_), F.col("h0").alias(a_), F.col("h1").alias(b_)
    gone = groups.where(~stays).select(*its).distinct()
    again = groups.where(stays).groupBy(*its).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    same = F.col(g).eqNullSafe(F.col(g_)) & (F.col(a) == F.col(a_)) & (F.col(b) == F.col(b_))
    kept = rows.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, same, "left_semi").dropDuplicates([g, a, b])
    return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
