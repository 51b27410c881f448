"""Text functions as native column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtok.functions.chars import ENCODED, JAVA_CLASS, LATIN


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_text(text: Column | str) -> Column:
    """Neither null nor empty: such rows are dropped without being counted."""
    return _col(text).isNotNull() & (_col(text) != "")


def long_enough(text: Column | str, min_chars: int) -> Column:
    """Whether the text has ``min_chars`` code points; a shorter one is counted as skipped."""
    return F.char_length(_col(text)) >= min_chars


def truncate(text: Column | str, max_chars: int) -> Column:
    """The first ``max_chars`` code points; 0 is no limit."""
    return F.substring(_col(text), 1, max_chars) if max_chars > 0 else _col(text)


def byte_pieces(text: Column | str) -> Column:
    """Pieces of byte-level pre-tokenizing: a run of white space sticks to the run after it; one at the end stands alone."""
    return F.regexp_extract_all(_col(text), F.lit(f"[{JAVA_CLASS}]*[^{JAVA_CLASS}]+|[{JAVA_CLASS}]+"), F.lit(0))


def words(text: Column | str) -> Column:
    """What white space separates."""
    return F.filter(F.split(_col(text), f"[{JAVA_CLASS}]+"), lambda w: w != "")


def byte_encode(piece: Column | str) -> Column:
    """Each UTF-8 byte as its character of the byte alphabet."""
    return F.translate(F.decode(F.encode(_col(piece), "UTF-8"), "ISO-8859-1"), LATIN, ENCODED)


def byte_decode(piece: Column | str) -> Column:
    """The inverse of :func:`byte_encode`."""
    some = [k for k, c in enumerate(LATIN) if c != "\0"]  # translate drops what it maps to NUL
    latin = F.translate(_col(piece), "".join(ENCODED[k] for k in some), "".join(LATIN[k] for k in some))
    return F.decode(F.encode(F.replace(latin, F.lit(ENCODED[LATIN.index("\0")]), F.lit("\0")), "ISO-8859-1"), "UTF-8")


def code_points(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), ""), lambda c: c != "")


def continued(chars: Column | str, prefix: str) -> Column:
    """Characters of a word as WordPiece symbols: all but the first with ``prefix``."""
    return F.transform(_col(chars), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(prefix), c)))


def adjacent(symbols: Column | str) -> Column:
    """array<struct<l, r>> of neighbours; none for fewer than two symbols."""
    s = _col(symbols)
    n = F.greatest(F.size(s) - 1, F.lit(0))
    return F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.struct(a.alias("l"), b.alias("r")))


def substrings(text: Column | str, longest: int) -> Column:
    """All substrings of 2 to ``longest`` code points."""
    t = _col(text)
    n = F.char_length(t)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(max(longest, 1)), n - i + 1)), lambda k: F.substring(t, i, k)))) if longest >= 2 else F.array().cast("array<string>")


def wrap(ids: Column | str, bos: int | None, eos: int | None) -> Column:
    """``ids`` with a first and a last id, even if there are no others."""
    parts = [F.array(F.lit(bos).cast("int"))] * (bos is not None) + [_col(ids)] + [F.array(F.lit(eos).cast("int"))] * (eos is not None)
    return F.concat(*parts)


def pad(ids: Column | str, size: Column | int, pad_id: int = 0) -> Column:
    """``ids`` filled up on the right to ``size``."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(_col(ids), F.array_repeat(F.lit(pad_id).cast("int"), F.greatest(size - F.size(_col(ids)), F.lit(0))))


def prefixed(text: Column | str, prefix: str) -> Column:
    return F.startswith(_col(text), F.lit(prefix))


def suffixed(text: Column | str, suffix: str) -> Column:
    return F.endswith(_col(text), F.lit(suffix))
