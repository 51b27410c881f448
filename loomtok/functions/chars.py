"""Constants of characters: the 26 code points that count as white space, and the byte alphabet."""

from __future__ import annotations

WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: The same as the inside of a bracket expression, for Java and for RE2.
JAVA_CLASS = "\\t-\\r \\u0085\\u00a0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RE2_CLASS = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
PYTHON_CLASS = JAVA_CLASS


def _byte_chars() -> list[str]:
    """Printable bytes stand for themselves; the other 68 take the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 256 + 68))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


BYTE_CHARS = _byte_chars()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}
#: What differs between Latin-1 and the byte alphabet, as arguments of translate.
LATIN, ENCODED = ("".join(x) for x in zip(*((chr(b), c) for b, c in enumerate(BYTE_CHARS) if chr(b) != c), strict=True))


def byte_encode(text: str) -> str:
    return "".join(BYTE_CHARS[b] for b in text.encode("utf-8", "surrogatepass"))


def byte_decode(text: str) -> str:
    return bytes(CHAR_BYTES[c] for c in text if c in CHAR_BYTES).decode("utf-8", "replace")
