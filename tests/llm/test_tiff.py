import random
import struct

import numpy as np
import pytest
from loomtok.llm import queries, tiff

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark, against_sql):
    against_sql(queries.op5_tiff(spark, SF), SF, queries.ORACLES["op5_tiff"])


def test_known_codes():
    """Examples of the published specification, and of codes that widen."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 258, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes).ljust(72, "0")
    assert tiff.lzw_decode(int(bits, 2).to_bytes(9, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6])
    assert tiff.unpack_bits(b"\x80\x00A") == b"A"
    for bad in (bytes([0xFF, 0xFF, 0xFF]), bytes([0x80, 0x7F, 0xFF, 0xFF])):
        with pytest.raises(ValueError):
            tiff.lzw_decode(bad)


@pytest.mark.parametrize("seed", range(30))
def test_codecs_go_round(seed):
    r = random.Random(seed)
    data = bytes(r.choice(b"ab" if seed % 2 else range(256)) for _ in range(r.choice([0, 1, 5, 200, 9000])))
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data and tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("dtype", ["u1", "u2", "u4", "i2", "f4", "f8"])
@pytest.mark.parametrize("kind", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("layout", [3, 100, (16, 16)])
def test_files_go_round(order, dtype, kind, layout):
    r = np.random.default_rng(1)
    pages = []
    for shape in ((7, 19), (20, 5, 3)):
        image = (r.random(shape) * 200).astype(dtype)
        pages += [(image, kind, p, layout) for p in ((1, 3) if dtype[0] == "f" else (1, 2))]
    back = tiff.read(tiff.write(pages, order))
    assert [p.error for p in back] == [None] * 4
    for p, (image, k, predictor, _) in zip(back, pages, strict=True):
        assert p.predictor == predictor and p.compression == k and p.tiled == isinstance(layout, tuple)
        assert np.array_equal(p.pixels.reshape(image.shape), image)


def test_bits(order="<"):
    fields = [(256, 4, 10), (257, 4, 2), (258, 3, 1), (259, 3, 1), (273, 4, 8), (278, 4, 2), (279, 4, 4)]
    data = b"II" + struct.pack("<HI", 42, 12) + bytes([0b10110000, 0b01000000, 0xFF, 0xC0]) + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<H", v) + b"\0\0" if k == 3 else struct.pack("<I", v)) for t, k, v in fields) + struct.pack("<I", 0)
    (page,) = tiff.read(data)
    assert page.error is None and page.pixels[:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 0, 0, 1], [1] * 10]


def test_broken_files_say_so():
    good = tiff.write([(np.arange(60, dtype="u1").reshape(6, 10), tiff.DEFLATE, 1, 6)] * 2)
    assert [p.error is None for p in tiff.read(good)] == [True, True]
    for cut in range(0, len(good), 3):
        assert tiff.read(good[:cut])[-1].error
    loop = bytearray(good)
    first = struct.unpack_from("<I", good, 4)[0]
    count = struct.unpack_from("<H", good, first)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * count, first)
    pages = tiff.read(bytes(loop))
    assert pages[0].error is None and "loop" in pages[1].error
    r = random.Random(5)
    for _ in range(300):
        noise = bytearray(good)
        for _ in range(4):
            noise[r.randrange(len(noise))] = r.randrange(256)
        tiff.read(bytes(noise))  # never raises


def test_awkward_media(spark):
    good = tiff.write([(np.arange(60, dtype="u2").reshape(6, 10), tiff.LZW, 2, 4)] * 2)
    big = tiff.write([(np.zeros((900, 1000), "u1"), tiff.PACKBITS, 1, 64)])
    rows = [("a", good, 1), ("a", good, 1), (None, good, 2), ("b", None, 3), ("c", b"", 4), ("d", b"not an image", 5), ("e", big, 6)]
    df = spark.createDataFrame(rows, "name string, media binary, pixels int")
    out = tiff.tiff_pages(df, "name", "media").collect()
    count = lambda name: sum(r.name == name for r in out)
    assert [count(n) for n in ("a", None, "b", "c", "d", "e")] == [4, 2, 0, 1, 1, 1]
    assert all((r.pixels is None) == (r.error is not None) for r in out) and all((r.error is not None) == (r.name in ("c", "d")) for r in out)
    assert next(r for r in out if r.name == "a").pixels == np.arange(60, dtype="<u2").tobytes()
    assert tiff.tiff_pages(df.limit(0), "name", "media").count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.5, None]), (None, [0.25] * 9)], "vec_id bigint, embedding array<float>")
    assert {r.vec_id: r.media is not None for r in tiff.rendered(odd).collect()} == {1: False, 2: False, 3: False, None: True}


# ---- files put together field by field, apart from the module's own writer ------------------------------------------

SORTS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}


def file(fields, blocks, order="<"):
    """A file of one directory of (tag, type, values); the values "at" and "sizes" are where the blocks are and how long."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 42)
    at, body = [], b""
    for b in blocks:
        at.append(8 + len(body))
        body += b
    body += b"\0" * (len(body) % 2)
    place, extra, table = 8 + len(body) + 2 + 12 * len(fields) + 4, b"", b""
    for tag, sort, values in fields:
        values = at if values == "at" else [len(b) for b in blocks] if values == "sizes" else values
        packed = values if isinstance(values, bytes) else struct.pack(order + SORTS[sort] * len(values), *(values if len(SORTS[sort]) == 1 else [x for v in values for x in (v, 1)]))
        count = len(values)
        if len(packed) > 4:
            table += struct.pack(order + "HHII", tag, sort, count, place + len(extra))
            extra += packed
        else:
            table += struct.pack(order + "HHI", tag, sort, count) + packed.ljust(4, b"\0")
    return head + struct.pack(order + "I", 8 + len(body)) + body + struct.pack(order + "H", len(fields)) + table + struct.pack(order + "I", 0) + extra


def basic(w, h, bits=8, coding=1, samples=1, rows=None, more=()):
    fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits] * samples), (259, 3, [coding]), (273, 4, "at"), (277, 3, [samples]), (278, 3, [rows or h]), (279, 4, "sizes"), *more]
    return sorted(fields)


@pytest.mark.parametrize("order", "<>")
def test_planes_apart(order):
    image = np.arange(5 * 4 * 3, dtype="u2").reshape(5, 4, 3)
    strips = [image[top : top + 2, :, c].astype(order + "u2").tobytes() for c in range(3) for top in (0, 2, 4)]
    (page,) = tiff.read(file(basic(4, 5, 16, samples=3, rows=2, more=[(284, 3, [2])]), strips, order))
    assert page.error is None and np.array_equal(page.pixels, image)
    tiles = [np.pad(image[:, :, c], ((0, 11), (0, 12))).astype(order + "u2").tobytes() for c in range(3)]
    fields = [f for f in basic(4, 5, 16, samples=3, more=[(284, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, "at"), (325, 4, "sizes")]) if f[0] not in (273, 278, 279)]
    (page,) = tiff.read(file(fields, tiles, order))
    assert page.error is None and np.array_equal(page.pixels, image)


def test_reversed_bits():
    data = bytes([0b10110000, 0b01000000])
    turned = bytes(int(f"{b:08b}"[::-1], 2) for b in data)
    (page,) = tiff.read(file(basic(10, 1, 1, more=[(266, 3, [2])]), [turned]))
    assert page.error is None and page.pixels[0, :, 0].tolist() == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1]


def test_a_known_file_of_deflate_with_differences():
    import zlib

    raw = bytes([10, 1, 1, 255, 200, 100, 0, 1])  # rows 10 11 12 11 and 200 44 44 45
    (page,) = tiff.read(file(basic(4, 2, 8, 8, more=[(317, 3, [2])]), [zlib.compress(raw)]))
    assert page.error is None and page.pixels[:, :, 0].tolist() == [[10, 11, 12, 11], [200, 44, 44, 45]]


WRONG = [(256, 4, []), (256, 2, b"ab"), (256, 11, [4.0]), (256, 4, [2**32 - 1]), (257, 9, [-1]), (258, 5, [8]), (259, 12, [1.0]), (273, 2, b"x"), (277, 3, [65535]), (278, 6, [-1]), (279, 11, [1.0]), (284, 3, [7]), (317, 4, [2**32 - 1]), (322, 4, [0]), (339, 2, b"q")]


@pytest.mark.parametrize("field", WRONG, ids=str)
def test_forged_fields_are_error_pages(spark, field):
    fields = sorted([f for f in basic(3, 2) if f[0] != field[0]] + [field])
    data = file(fields, [bytes(range(6))])
    rows = tiff.tiff_pages(spark.createDataFrame([(1, data), (2, file(basic(3, 2), [bytes(range(6))]))], "k int, media binary"), "k", "media").collect()
    assert sorted(r.k for r in rows) == [1, 2]
    assert all((r.error is None) == (r.k == 2) and (r.pixels is None) == (r.k == 1) for r in rows)


def test_any_field_of_any_type_and_count_goes_through_the_operator(spark):
    r, rows = random.Random(8), []
    for k in range(1500):
        fields = {f[0]: f for f in basic(3, 2, samples=r.choice([1, 1, 2]))}
        for _ in range(r.randint(1, 3)):
            tag, sort, n = r.choice(sorted(tiff.TAGS)), r.choice([*SORTS, 13, 0]), r.choice([0, 1, 1, 2, 5])
            fields[tag] = (tag, sort, r.randbytes(n * 8)[: r.choice([n, n * 2, n * 4, n * 8])])
        data = bytearray(file(sorted(fields.values()), [r.randbytes(r.randint(0, 9))], r.choice("<>")))
        for _ in range(r.randint(0, 2)):
            data[r.randrange(len(data))] = r.randrange(256)
        rows.append((k, bytes(data)))
    out = tiff.tiff_pages(spark.createDataFrame(rows, "k int, media binary"), "k", "media").collect()
    assert {x.k for x in out} == set(range(1500)) and all((x.error is None) != (x.pixels is None) for x in out)


def test_small_files_cannot_ask_for_much_memory():
    for coding in (1, 5, 8, 32773):
        (page,) = tiff.read(file(basic(30_000, 30_000, coding=coding), [b"abc"]))
        assert page.error and page.pixels is None and page.width == 30_000
    shared = [(tag, 4, [0] * 3000) for tag in (273, 279, 324, 325)]
    many = b"II*\0" + struct.pack("<I", 8)
    for k in range(50):  # directories that all point at the same values
        many += struct.pack("<H", 4) + b"".join(struct.pack("<HHII", t, s, len(v), 100) for t, s, v in shared) + struct.pack("<I", len(many) + 2 + 48 + 4 if k < 49 else 0)
    assert "share" in tiff.read(many + bytes(12_000))[-1].error


def test_the_limit_is_a_parameter(spark):
    df = spark.createDataFrame([(1, tiff.write([(np.zeros((20, 20), "u1"), tiff.NONE, 1, 20)]))], "k int, media binary")
    (row,) = tiff.tiff_pages(df, "k", "media", most_bytes=399).collect()
    assert "limit" in row.error and tiff.tiff_pages(df, "k", "media", most_bytes=400).first().error is None


def test_a_key_named_like_a_result(spark):
    df = spark.createDataFrame([(7, tiff.write([(np.zeros((2, 3), "u1"), tiff.NONE, 1, 2)]))], "width int, media binary")
    (row,) = tiff.tiff_pages(df, "width", "media").collect()
    assert (row["width"], row["width_"], row["height"]) == (7, 3, 2)
