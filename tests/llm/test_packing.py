import random

import numpy as np
import pyarrow as pa
import pytest
from loomtok.llm import packing, queries
from loomtok.llm.token_count import DEFAULT_RANKS, Counter, load_ranks

SF = "/root/testdata/sf0.001"


def brute_cost(lengths, whole, size, penalty):
    """Least cost by trying every window end, O(n * n)."""
    best = [0] + [None] * len(lengths)
    for j in range(1, len(lengths) + 1):
        n = 0
        for i in range(j - 1, -1, -1):
            n += lengths[i]
            if n > size:
                break
            cost = best[i] + size - n + (0 if whole[j - 1] else penalty)
            if best[j] is None or cost < best[j]:
                best[j] = cost
    return best[-1]


def cost_of(cuts, lengths, whole, size, penalty):
    at, total = 0, 0
    for c in cuts:
        n = sum(lengths[at:c])
        assert 0 < n <= size
        total += size - n + (0 if whole[c - 1] else penalty)
        at = c
    assert at == len(lengths)
    return total


@pytest.mark.parametrize("seed", range(200))
def test_cuts_cost_as_little_as_brute_force(seed):
    r = random.Random(seed)
    n, size, penalty = r.randint(1, 40), r.randint(5, 30), r.choice([0, 1, 4, 50])
    lengths = np.array([r.randint(1, size) for _ in range(n)])
    whole = np.array([r.random() < 0.4 for _ in range(n - 1)] + [True])
    cost, cuts = packing.best_cuts(lengths, whole, size, penalty)
    assert cost == cost_of(cuts, lengths, whole, size, penalty) == brute_cost(lengths.tolist(), whole.tolist(), size, penalty)


@pytest.fixture(scope="module")
def counter():
    return Counter(load_ranks(DEFAULT_RANKS), 16_384, 256)


def ids(counter, text):
    return counter.encoding.encode_ordinary(text)


def units(docs, size, counter):
    """(document's place, start, end, tokens, whether it ends there) over (doc_id, text)."""
    u = packing.units(pa.array([t for _, t in docs], pa.large_string()), size, counter)
    return list(zip(u.doc.tolist(), u.first.tolist(), u.last.tolist(), u.tokens.tolist(), u.whole.tolist(), strict=True))


SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_sentences(text):
    """Spans of sentences, character by character."""
    cuts = [0]
    for i in range(1, len(text)):
        if text[i] in SPACE and text[i - 1] not in SPACE:
            run = text[i : i + len(text[i:]) - len(text[i:].lstrip(SPACE))]
            if (text[i - 1] in ".!?" or "\n" in run) and i + len(run) < len(text):
                cuts.append(i)
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True)) if text.strip(SPACE) else []


def test_sentences_are_the_whole_text_and_have_its_ids(counter, monkeypatch):
    monkeypatch.setattr(packing.buffers, "BLOCK_BYTES", 200)
    r = random.Random(1)
    for _ in range(300):
        texts = ["".join(r.choice([*"ab1 .!?\n\t\r'", "  ", "\u00a0", "\u2003", "\u180e", "\x1c", "\x85", "é", "漢", "😀", "'s", "\u3000"]) for _ in range(r.randint(0, 40))) for _ in range(12)]
        found = units(list(enumerate(texts)), 10**6, counter)
        for k, text in enumerate(texts):
            own = [u for u in found if u[0] == k]
            assert [(a, b) for _, a, b, *_ in own] == plain_sentences(text), repr(text)
            assert [n for *_, n, _ in own] == [len(ids(counter, text[a:b])) for _, a, b, *_ in own], repr(text)
            assert not own or [i for _, a, b, *_ in own for i in ids(counter, text[a:b])] == ids(counter, text), repr(text)
            assert [w for *_, w in own] == [False] * (len(own) - 1) + [True] * bool(own)


def test_long_runs_of_white_space(spark, counter):
    texts = ["a" + " " * 3_000_000 + "b.", " " * 1_200_000, "x\n" + "\t" * 1_500_000, " \u3000" * 150_000 + "é"]
    windows = packing.packing(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    got = {k: "".join(w.text.split("\n\n")[w.doc_ids.index(k)] for w in sorted(windows, key=lambda w: w.window_no) if k in w.doc_ids) for k in (0, 3)}
    assert got == {0: texts[0], 3: texts[3]} and {d for w in windows for d in w.doc_ids} == {0, 2, 3}
    for n in (99_990, 100_005):  # short enough for the pattern itself, and around the length from which runs go another way
        for text in ("a" + " " * n + "b", "a" + " " * n, "\t" * n + "b", " " * n + "\u00a0!"):
            assert counter.ids(text) == counter.encoding.encode_ordinary(text)


def test_sentences_end_where_they_should(counter):
    cut = lambda text: [text[a:b] for _, a, b, *_ in units([(0, text)], 10**6, counter)]
    assert cut("One 2.5 x.y. Two! \n Three?!  four\nfive \n\n six. ") == ["One 2.5 x.y.", " Two!", " \n Three?!", "  four", "\nfive", " \n\n six. "]


def check(windows, docs, size, counter):
    """Every text is in the windows of its shard whole and in order, and the sums are right."""
    texts = {}
    for w in windows:
        assert w.padding == size - w.n_tokens >= 0 and len(w.doc_ids) == len(w.starts) == len(w.ends) > 0
        parts = []
        for d, a, b in zip(w.doc_ids, w.starts, w.ends, strict=True):
            texts.setdefault(d, []).append((a, b))
            parts.append(docs[d][a:b])
        assert w.text == "\n\n".join(parts) and w.n_tokens == sum(len(ids(counter, p)) for p in parts)
    assert set(texts) == {d for d, t in docs.items() if t and t.strip()}
    for d, spans in texts.items():
        assert spans[0][0] == 0 and spans[-1][1] == len(docs[d]) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))  # noqa: B905


def test_query_against_brute_force(spark, documents, counter):
    docs = {r.doc_id: r.text for r in documents.collect()}
    windows = sorted(queries.op4_packing(spark, SF).collect(), key=lambda w: (w.shard, w.window_no))
    check(windows, docs, 2048, counter)
    for shard in {w.shard for w in windows}:
        own = sorted((d, t) for d, t in docs.items() if d // 1024 == shard)
        parts = units(own, 2048, counter)
        lengths, whole = [u[3] for u in parts], [u[4] for u in parts]
        mine = [w for w in windows if w.shard == shard]
        ends = [(w.doc_ids[-1], w.ends[-1]) for w in mine]
        broken = sum(b < len(docs[d].rstrip()) for d, b in ends)
        assert sum(w.padding for w in mine) + 64 * broken == brute_cost(lengths, whole, 2048, 64)


def test_awkward_rows(clashing, awkward_rows, counter):
    windows = packing.stage(clashing).orderBy("shard", "window_no").collect()
    once = {r[0]: r[1] for r in awkward_rows if r[0] is not None and r[0] not in (6, 7, 8)}
    check([w for w in packing.packing(clashing.where("doc_id is not null and doc_id not in (6, 7, 8)")).orderBy("shard", "window_no").collect()], once, 2048, counter)
    assert [w.shard for w in windows] == sorted(w.shard for w in windows)
    docs = [d for w in windows for d in w.doc_ids]
    assert docs.count(7) == 2 and docs.count(8) == 2 and docs.count(None) == 1 and not {2, 3, 4} & set(docs)
    assert sum(w.n_tokens for w in windows) == sum(len(ids(counter, r[1])) for r in awkward_rows if (r[1] or "").strip())


def test_a_sentence_longer_than_a_window_is_cut_by_tokens(spark, counter):
    text = " ".join(["w"] * 50) + "."
    windows = packing.packing(spark.createDataFrame([(1, text), (2, "end.")], "doc_id bigint, text string"), size=20).orderBy("window_no").collect()
    check(windows, {1: text, 2: "end."}, 20, counter)
    assert [w.n_tokens for w in windows] == [20, 20, 13]


@pytest.mark.parametrize("text", ["😀" * 300, "漢字" * 400, "x" * 5000, "é漢😀a" * 200, "👩‍👩‍👧‍👦" * 60])
def test_characters_stay_whole_where_sentences_are_cut(spark, counter, text):
    windows = packing.packing(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), size=17).orderBy("window_no").collect()
    assert "".join(w.text for w in windows) == text and all(0 < w.n_tokens <= 17 for w in windows)
    assert [(s, e) for w in windows for s, e in zip(w.starts, w.ends)][-1][1] == len(text)  # noqa: B905
    assert sum(w.n_tokens for w in windows) == len(ids(counter, text))


def test_empty_table(empty):
    assert packing.packing(empty).count() == 0
