import random
import struct

import pytest
from loomtok.llm import queries
from loomtok.llm import sentencepiece_fst as module
from loomtok.llm.sentencepiece_fst import BLANK, DEFAULT_MODEL, UNIGRAM, Model, Transducer, _fields, parse_model, read_model, sentencepiece, shortest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import sentencepiece as spm

    return spm.SentencePieceProcessor(model_file=DEFAULT_MODEL)


@pytest.fixture(scope="module")
def fst():
    return Transducer(read_model(DEFAULT_MODEL))


def test_query_equals_the_library(spark, library, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op3_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) and r.decoded == texts[r.doc_id]


def test_random_texts_equal_the_library(library, fst):
    r = random.Random(8)
    letters = [*"abcdehiorst  ", "  ", "\n", "\t", "é", "漢", "😀", "1", "0", ".", "ﬁ", BLANK, "\x00", "ing", "tion"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert fst.encode(text) == library.encode(text), repr(text)
        assert fst.decode(fst.encode(text)) == library.decode(library.encode(text)), repr(text)


def test_decoding_broken_bytes(library, fst):
    ids = [fst.bytes[b] for b in (0xE6, 0xBC, 0x41, 0xFF)]
    assert fst.decode(ids) == library.decode(ids)


def test_chunks_change_nothing(fst):
    for text in ("a  b\n c", "x" * 500 + " y", " lead", "trail  ", "\n\n", "  "):
        assert fst.encode(text) == fst.path(fst.normalise(text))


def test_unigram_paths_weigh_as_little_as_brute_force():
    r = random.Random(2)
    for _ in range(100):
        pieces = [("<unk>", 0.0, 2)] + [(c, -r.random() * 5, 1) for c in "ab"] + [(p, -r.random() * 8, 1) for p in {"".join(r.choice("ab") for _ in range(r.randint(2, 4))) for _ in range(6)}]
        t = Transducer(Model(pieces, UNIGRAM, prefix=False, escape=False))
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        score = {p: -s for p, s, k in pieces if k == 1}

        def least(rest, score=score, t=t):
            return 0.0 if not rest else min([score[p] + least(rest[len(p) :]) for p in score if rest.startswith(p)] + ([t.unknown_cost + least(rest[1:])] if rest[0] == "c" else []))

        got = t.path(text)
        runs = sum(c == "c" for c in text)
        assert abs(sum(-pieces[i][1] for i in got if i) + runs * t.unknown_cost - least(text)) < 1e-9


def test_awkward_rows(clashing, awkward_rows, library):
    rows = sentencepiece(clashing).collect()
    assert len(rows) == len(awkward_rows)
    for r, (doc_id, text, *_) in zip(rows, awkward_rows, strict=True):
        assert r.doc_id == doc_id and r.decoded == text
        assert r.ids == (None if text is None else library.encode(text)) and r.n_pieces == len(r.ids or [])


def test_empty_table(empty):
    assert sentencepiece(empty).count() == 0


# ---- models put together here, and the library's own reading of them ------------------------------------------------


def varint(n):
    out = b""
    while n > 127:
        out += bytes((n & 127 | 128,))
        n >>= 7
    return out + bytes((n,))


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(int(value))


def proto(pieces, kind, charsmap=b"", prefix=True, squeeze=True, escape=True, fallback=False):
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, t)) for p, s, t in pieces)
    out += field(2, field(3, kind) + field(4, len(pieces)) + field(35, fallback))
    return out + field(3, field(1, b"own") + field(2, charsmap) + field(3, prefix) + field(4, squeeze) + field(5, escape))


def charsmap_of(name):
    """A character map that the library brings, as it writes it."""
    import sentencepiece as spm

    data = spm.SentencePieceNormalizer(rule_name=name).serialized_model_proto()
    return dict(_fields(dict(_fields(data))[3]))[2]


def own_pieces(seed, user=(), fallback=False, kind=UNIGRAM):
    r = random.Random(seed)
    letters = [BLANK, *"abcdehiorst1fié漢"]
    longer = sorted({"".join(r.choice(letters[1:]) for _ in range(r.randint(2, 4))) for _ in range(60)} | {BLANK + "".join(r.choice(letters[1:]) for _ in range(r.randint(1, 3))) for _ in range(40)})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((u, 0.0, 4) for u in user)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    made = [*dict.fromkeys(letters), *longer]
    r.shuffle(made)
    scores = [-(k + 1.0) for k in range(len(made))] if kind == 2 else [-1 - r.random() * 9 for _ in made]
    return [*pieces, *((p, s, 1) for p, s in zip(made, scores, strict=True))]


TEXTS = [*"abcdehiorst  ", "  ", "\n", "\t", "é", "e\u0301", "漢", "😀", "1", "①", "ﬁ", "Ａ", "\u00a0", "\u3000", BLANK, "\x00", "\u200b", "¨", "ｶﾞ", "<sep>", "<s", "ab"]


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_models_with_character_maps_equal_the_library(kind, rule, squeeze):
    import sentencepiece as spm

    charsmap = charsmap_of(rule)
    for seed, (user, fallback) in enumerate([((), False), ((), True), (("<sep>", "ab"), False), (("<sep>",), True)]):
        data = proto(own_pieces(seed, user, fallback, kind), kind, charsmap, seed % 2 == 0, squeeze, fallback=fallback)
        own, library = Transducer(parse_model(data)), spm.SentencePieceProcessor(model_proto=data)
        r = random.Random(seed)
        for _ in range(400):
            text = "".join(r.choice(TEXTS) for _ in range(r.randint(0, 20)))
            assert own.normalise(text) == library.normalize(text), repr(text)
            assert own.encode(text) == library.encode(text), repr(text)


def test_composing_first_gives_the_same_paths(fst):
    r = random.Random(5)
    own = [Transducer(parse_model(proto(own_pieces(k, ("<sep>", "ab"), k % 2, kind), kind, fallback=k % 2))) for k, kind in enumerate((1, 2, 1, 2))]
    for t in [fst, *own]:
        for _ in range(150):
            text = t.normalise("".join(r.choice(TEXTS) for _ in range(r.randint(0, 14))))
            found = shortest(t.arcs(text), len(text))
            if t.unknown in found:
                found = [x for k, x in enumerate(found) if x != t.unknown or k == 0 or found[k - 1] != x]
            assert found == t.path(text), repr(text)


def test_what_workers_remember_is_bounded(fst, monkeypatch):
    monkeypatch.setattr(module, "MEMO", 50)
    monkeypatch.setattr(module, "PAIRS", 40)
    memo, r = {}, random.Random(3)
    t = Transducer(read_model(DEFAULT_MODEL))
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    assert t.encode(text, memo) == fst.encode(text) and len(memo) <= 50 and len(t.pairs) <= 40
