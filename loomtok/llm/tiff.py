"""Media columns: TIFF files to one row per page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import fresh

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: Bytes and struct letter of the field types of unsigned whole numbers, which sizes, places and codes must have.
FIELD = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
#: The tags that are read; others are passed over.
TAGS = frozenset((256, 257, 258, 259, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339))
#: At most this many bytes come out of one byte of each coding, so that a forged header is found before memory is taken.
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: The default of the most bytes of samples in a page, within what a row of a table can hold.
MOST_BYTES = 1 << 30
#: Bytes of pixels after which a batch is handed on.
BATCH_BYTES = 1 << 26
#: Each byte with its bits in reverse.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
NAMED = (("page_no", "int"), ("width", "int"), ("height", "int"), ("samples", "int"), ("bits", "int"), ("sample_format", "int"), ("compression", "string"), ("predictor", "int"), ("tiled", "boolean"), ("pixels", ""), ("error", "string"))


# ---- codecs ---------------------------------------------------------------------------------------------------------


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of each code after a clear: 9 to 12, one code before the table needs them, since a table grows by one a code from the second on."""
    size = 259 + np.maximum(np.arange(n) - 1, 0)
    return 9 + (size >= 512) + (size >= 1024) + (size >= 2048).astype(np.int64)


#: Widths of codes, and the bits before each, up to where every encoder has cleared.
WIDTHS = _widths(4200)
BEFORE = np.concatenate([[0], np.cumsum(WIDTHS)])
_BYTES = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_codes(data: bytes) -> Iterator[list[int]]:
    """Runs of codes between those that clear the table, up to the one that ends. All codes of a run are cut out of the bits at once."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bit, total = 0, 8 * len(data)
    while bit < total:
        n = int(np.searchsorted(BEFORE, total - bit, "right")) - 1  # whole codes that are left
        at = bit + BEFORE[:n]
        byte = at >> 3
        codes = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (at & 7) - WIDTHS[:n])) & ((1 << WIDTHS[:n]) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        if not len(stops):
            if n == len(WIDTHS):
                raise ValueError("LZW codes without a clear")
            yield codes.tolist()
            return
        k = int(stops[0])
        yield codes[:k].tolist()
        if codes[k] == 257:
            return
        bit += int(BEFORE[k + 1])


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that widen one code early; 256 clears, 257 ends."""
    out = []
    for codes in lzw_codes(data):
        if not codes:
            continue
        if codes[0] > 255:
            raise ValueError("LZW data begin with no byte")
        table = _BYTES.copy()
        before = table[codes[0]]
        out.append(before)
        for code in codes[1:]:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(before + entry[:1])
            out.append(entry)
            before = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """The inverse of :func:`lzw_decode`; a code and the byte after it are the key of a longer entry."""
    runs: list[list[int]] = [[256], []]
    table: dict[int, int] = {}
    now, new = -1, 258
    for byte in data:
        if now < 0:
            now = byte
            continue
        key = now << 8 | byte
        if (code := table.get(key)) is not None:
            now = code
            continue
        runs[-1].append(now)
        table[key] = new
        new += 1
        now = byte
        if new >= 4094:
            runs[-1].append(256)
            runs.append([])
            table, new = {}, 258
    if now >= 0:
        runs[-1].append(now)
    runs[-1].append(257)
    codes = np.array([c for run in runs for c in run])
    widths = np.concatenate([WIDTHS[: len(run)] for run in runs])
    bits = np.arange(11, -1, -1)
    return np.packbits((codes[:, None] >> bits & 1)[bits < widths[:, None]]).tobytes()


def decompress(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return unpack_bits(data)
    if kind == LZW:
        return lzw_decode(data)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {kind} isn't supported")


# ---- reading --------------------------------------------------------------------------------------------------------


@dataclass
class Page:
    width: int | None = 0
    height: int | None = 0
    samples: int | None = 1
    bits: int | None = 1
    sample_format: int | None = 1
    compression: int | None = NONE
    predictor: int | None = 1
    tiled: bool = False
    pixels: np.ndarray | None = None  # height x width x samples
    error: str | None = None


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each image directory by tag, and the byte order under -1.

    Only known tags of unsigned whole numbers with at least one value are there; of others ``None`` stands for the
    value. A chain that comes back to itself or leaves the file is an error, and so are fields that together have more
    bytes than the file, since such share their bytes.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, left = struct.unpack_from(order + "I", data, 4)[0], set(), len(data)
    while at:
        if at in seen:
            raise ValueError("the chain of directories is a loop")
        seen.add(at)
        fields: dict[int, tuple | None] = {-1: (order,)}
        (count,) = struct.unpack_from(order + "H", data, at)
        left -= 12 * count
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if tag not in TAGS or tag in fields:
                continue
            if kind not in FIELD or not n:
                fields[tag] = None
                continue
            size, letter = FIELD[kind]
            place = at + 2 + 12 * k + 8
            if size * n > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
                left -= size * n
            if place + size * n > len(data):
                raise ValueError("a field leaves the file")
            if left < 0:
                raise ValueError("fields share their bytes")
            fields[tag] = struct.unpack_from(f"{order}{n}{letter}", data, place)
        yield fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)


def whole(fields: dict[int, tuple | None], tag: int, default: int | None = None) -> int:
    """The first value of a tag; an error if it is no unsigned whole number, or missing without a default."""
    if tag not in fields:
        if default is None:
            raise ValueError(f"tag {tag} is missing")
        return default
    values = fields[tag]
    if values is None:
        raise ValueError(f"tag {tag} is no whole number")
    return values[0]


def header(fields: dict[int, tuple | None]) -> Page:
    """What a directory says, as far as it can be read: for pages with errors."""

    def get(tag: int, default: int | None) -> int | None:
        try:
            return whole(fields, tag, default)
        except ValueError:
            return None

    coding = get(259, NONE)
    return Page(get(256, 0), get(257, 0), get(277, 1), get(258, 1), get(339, 1), coding, get(317, 1), 322 in fields)


def _unpredict(block: np.ndarray, raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str, kind: str) -> np.ndarray:
    """Samples of a block, rows x width x samples, in the machine's order."""
    size = bits // 8
    if predictor == 3:
        if kind != "f":
            raise ValueError("predictor 3 needs floating point")
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").astype(f"=f{size}").reshape(rows, width, samples)
    if predictor == 2:
        if kind == "f":
            raise ValueError("predictor 2 needs whole numbers")
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return block


def read_page(data: bytes, fields: dict[int, tuple | None], most_bytes: int = MOST_BYTES) -> Page:
    get = lambda tag, default=None: whole(fields, tag, default)
    order, width, height, samples, bits = fields[-1][0], get(256), get(257), get(277, 1), get(258, 1)
    page = Page(width, height, samples, bits, get(339, 1), get(259, NONE), get(317, 1), 322 in fields)
    if not (width and height and samples):
        raise ValueError("the size is zero")
    if len(set(fields.get(258, (1,)))) > 1:
        raise ValueError("mixed depths aren't supported")
    if page.compression not in NAMES:
        raise ValueError(f"compression {page.compression} isn't supported")
    kind = {1: "u", 2: "i", 3: "f", 4: "u"}.get(page.sample_format, "u")
    if bits not in ((16, 32, 64) if kind == "f" else (1, 2, 4, 8, 16, 32, 64)):
        raise ValueError(f"{bits} bits aren't supported")
    fill, apart = get(266, 1), get(284, 1)
    if fill not in (1, 2) or apart not in (1, 2):
        raise ValueError("an unknown order of bits or of samples")
    layers, mixed = (samples, 1) if apart == 2 else (1, samples)  # planes apart are layers of one sample
    if page.tiled:
        block_w, block_h, offsets, sizes = get(322), get(323), fields.get(324), fields.get(325)
    else:
        block_w, block_h, offsets, sizes = width, min(get(278, height) or height, height), fields.get(273), fields.get(279, (len(data),))
    if not block_w or not block_h:
        raise ValueError("blocks have no size")
    across, down = -(-width // block_w), -(-height // block_h)
    count = layers * across * down
    if offsets is None or sizes is None or len(offsets) < count or len(sizes) < count:
        raise ValueError("blocks are missing")
    line = -(-block_w * mixed * bits // 8)
    if width * height * samples * max(8, bits) // 8 > most_bytes or block_h * line > most_bytes:
        raise ValueError("the size is over the limit")
    full = sum(min(block_h, height - k // across % down * block_h) if not page.tiled else block_h for k in range(count)) * line
    if full > GROWTH[page.compression] * sum(max(0, min(n, len(data) - at)) for at, n in zip(offsets[:count], sizes[:count], strict=True)):
        raise ValueError("blocks are too short for the size")
    out = np.zeros((height, width, samples), np.dtype(f"{kind}{max(1, bits // 8)}"))
    for k in range(count):
        layer, place = divmod(k, across * down)
        top, left = place // across * block_h, place % across * block_w
        rows = block_h if page.tiled else min(block_h, height - top)
        part = data[offsets[k] : offsets[k] + sizes[k]]
        raw = decompress(part.translate(REVERSED) if fill == 2 else part, page.compression, rows * line)[: rows * line]
        if len(raw) < rows * line:
            raise ValueError("a block is too short")
        if bits < 8:
            if page.predictor != 1:
                raise ValueError("predictors need whole bytes")
            flat = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : block_w * mixed * bits]
            block = np.packbits(np.pad(flat.reshape(rows, -1, bits), ((0, 0), (0, 0), (8 - bits, 0))), axis=2).reshape(rows, block_w, mixed)
        else:
            plain = np.frombuffer(raw, f"{order}{kind}{bits // 8}").astype(out.dtype).reshape(rows, block_w, mixed) if page.predictor != 3 else out[:0]
            block = _unpredict(plain, raw, rows, block_w, mixed, bits, page.predictor, order, kind)
        h, w = min(rows, height - top), min(block_w, width - left)
        out[top : top + h, left : left + w, layer : layer + mixed] = block[:h, :w]
    page.pixels = out
    return page


def pages(data: bytes, most_bytes: int = MOST_BYTES) -> Iterator[Page]:
    """All pages of a file, one by one. One that can't be read has an error instead of pixels; so has a file, as its last page."""
    walk = directories(data)
    while True:
        try:
            fields = next(walk, None)
        except Exception as e:  # noqa: BLE001 - the bytes come from anywhere, and whatever they raise is the page's error
            yield Page(error=str(e) or "the file is cut off")
            return
        if fields is None:
            return
        try:
            page = read_page(data, fields, most_bytes)
        except Exception as e:  # noqa: BLE001
            page = header(fields)
            page.error = str(e) or type(e).__name__
        yield page


def read(data: bytes, most_bytes: int = MOST_BYTES) -> list[Page]:
    return list(pages(data, most_bytes))


# ---- writing, for tables without media and for tests ----------------------------------------------------------------


def write(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | int]], order: str = "<") -> bytes:
    """A TIFF file of (samples, compression, predictor, rows per strip or tile size) pages, the samples being height x width or height x width x samples."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, kind, predictor, layout in pages:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = image.shape
        bits, tiled = image.dtype.itemsize * 8, isinstance(layout, tuple)
        bw, bh = layout if tiled else (width, layout)
        offsets, sizes = [], []
        for top in range(0, height, bh):
            for left in range(0, width, bw):
                block = image[top : top + bh, left : left + bw]
                if tiled:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)), "edge")
                rows = len(block)
                if predictor == 3:
                    planes = np.ascontiguousarray(block.astype(f">f{bits // 8}")).view(np.uint8).reshape(rows, -1, bits // 8).transpose(0, 2, 1).reshape(rows, -1, samples)
                    raw = np.diff(planes, axis=1, prepend=np.zeros((rows, 1, samples), np.uint8)).astype(np.uint8).tobytes()
                else:
                    if predictor == 2:
                        block = np.diff(block, axis=1, prepend=np.zeros((rows, 1, samples), block.dtype)).astype(block.dtype)
                    raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
                data = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: zlib.compress, OLD_DEFLATE: zlib.compress}[kind](raw)
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
        if len(out) % 2:
            out.append(0)
        fields: list[tuple[int, int, list[int]]] = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * samples), (259, 3, [kind]), (262, 3, [1]), (277, 3, [samples])]
        fields += [(322, 4, [bw]), (323, 4, [bh]), (324, 4, offsets), (325, 4, sizes)] if tiled else [(273, 4, offsets), (278, 4, [bh]), (279, 4, sizes)]
        fields += [(317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]] * samples)]
        body = bytearray()
        place = len(out) + 2 + 12 * len(fields) + 4
        table = bytearray()
        for tag, sort, values in sorted(fields):
            packed = struct.pack(f"{order}{len(values)}{FIELD[sort][1]}", *values)
            table += struct.pack(order + "HHI", tag, sort, len(values))
            if len(packed) <= 4:
                table += packed.ljust(4, b"\0")
            else:
                table += struct.pack(order + "I", place + len(body))
                body += packed
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(table)
        out += struct.pack(order + "H", len(fields)) + table + struct.pack(order + "I", 0) + body
    return bytes(out)


# ---- the operator ---------------------------------------------------------------------------------------------------


def _small(n: int | None) -> int | None:
    return n if n is not None and n < 1 << 31 else None


def tiff_pages(media: DataFrame, key: str, column: str, values: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``key`` and one row per page of the TIFF files in ``column``: page_no from 0, sizes, coding, pixels and error.

    ``pixels`` is binary, row by row, samples side by side, in the sample's own type with low bytes first (samples of
    less than a byte take one each); with ``values`` it is array<double>. Strips and tiles, samples together and in
    planes apart, both orders of bytes and of bits, no compression, PackBits, LZW and deflate, and predictors 1, 2 and 3
    are read.

    Null media gives no row, nor does a file without pages. What can't be read gives a row with ``error`` and null pixels:
    an unsupported or broken page in its place, a broken file as its last page; empty media is a broken file. A page
    of more than ``most_bytes`` of samples is such a page, and so is one whose blocks have too few bytes for its size.
    Bytes of any kind never end the job; what a broken page says of itself is null where it is no number that fits. A null
    key stays null, and repeated rows give repeated pages. If ``key`` is named like one of the columns here, that one gets
    an underscore. Other columns are left out. An empty table gives an empty table.
    """
    kind = media.select(key).schema[0].dataType.simpleString()
    names = fresh(media.select(key), *(n for n, _ in NAMED))
    sorts = ["array<double>" if n == "pixels" and values else "binary" if n == "pixels" else t for n, t in NAMED]
    schema = f"`{key}` {kind}, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, sorts, strict=True))
    types = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}.get(t, pa.list_(pa.float64())) for t in sorts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: pa.Array, rows: list, owner: list[int]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [key, *names])

        for batch in batches:
            rows, owner, held = [], [], 0
            for k in range(batch.num_rows):
                if (data := batch.column(1)[k].as_py()) is None:
                    continue
                for n, p in enumerate(pages(data, most_bytes)):
                    pixels = None if p.pixels is None else p.pixels.ravel().astype(float) if values else p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()
                    coding = None if p.compression is None else NAMES.get(p.compression, str(p.compression))
                    rows.append((n, *map(_small, (p.width, p.height, p.samples, p.bits, p.sample_format)), coding, _small(p.predictor), p.tiled, pixels, p.error))
                    owner.append(k)
                    held += 0 if pixels is None else pixels.nbytes if values else len(pixels)
                    if held > BATCH_BYTES:
                        yield emit(batch.column(0), rows, owner)
                        rows, owner, held = [], [], 0
            yield emit(batch.column(0), rows, owner)

    return media.select(key, column).mapInArrow(run, schema)


def rendered(vectors: DataFrame) -> DataFrame:
    """(vec_id, media): each embedding as a TIFF file of five pages, since the tables have no media of their own.

    Values from -1 to 1 are shades of 8 and of 16 bits in rows of 8; the pages go through all codecs, both layouts
    and all predictors, the byte order with the parity of vec_id. A null or empty embedding gives null media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not values or None in values:
                    media.append(None)
                    continue
                raw = np.zeros(-(-len(values) // 8) * 8, np.float32)
                raw[: len(values)] = values
                shade = np.clip((raw.astype(float) + 1) / 2, 0, 1)
                small, large, raw = (np.floor(shade * 255).astype(np.uint8).reshape(-1, 8), np.floor(shade * 65535).astype(np.uint16).reshape(-1, 8), raw.reshape(-1, 8))
                media.append(write([(small, PACKBITS, 1, 3), (small, LZW, 2, 5), (large, LZW, 2, (16, 16)), (large, DEFLATE, 2, 4), (raw, DEFLATE, 3, (16, 16))], "<>"[(vec_id or 0) % 2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["vec_id", "media"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, media binary")


ORACLE = """
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) > 0),
s AS (SELECT vec_id, e, list_transform(e, lambda x: least(greatest((CAST(x AS DOUBLE) + 1) / 2, 0), 1)) AS t FROM v),
p AS (SELECT * FROM (VALUES (0, 8, 1, 'packbits', 1, false), (1, 8, 1, 'lzw', 2, false), (2, 16, 1, 'lzw', 2, true),
                            (3, 16, 1, 'deflate', 2, false), (4, 32, 3, 'deflate', 3, true)) AS p(page_no, bits, sample_format, compression, predictor, tiled))
SELECT vec_id, page_no, 8 AS width, CAST(len(e) / 8 AS INTEGER) AS height, 1 AS samples, bits, sample_format, compression, predictor, tiled,
       CASE WHEN bits = 8 THEN list_transform(t, lambda x: floor(x * 255)) WHEN bits = 16 THEN list_transform(t, lambda x: floor(x * 65535))
            ELSE list_transform(e, lambda x: CAST(x AS DOUBLE)) END AS pixels, CAST(NULL AS VARCHAR) AS error
FROM s CROSS JOIN p
"""
