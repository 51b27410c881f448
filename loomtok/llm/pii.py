"""PII: a linear-chain conditional random field over word shapes, decoded by Viterbi in numpy batches."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "KEY", "SECRET")
#: A token with none of these bytes, and without a run of LONG capitals, is plain.
SPECIAL = b"0123456789@=+_/\\<>{}[]~^`"
LONG = 16
BLOCK_BYTES = 4_000_000
SECRET_WORDS = frozenset("password passwd pwd secret token api_key apikey key auth bearer credential pass".split())
_EDGE = "\"'`.,;:!?()[]{}<>*#%&$|"
_CODE = re.compile("[A-Z]{%d}" % LONG)
_V4 = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$")
_MAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s.]{2,}$")
_SHAPE = re.compile(r"[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|[0-9]+|[^\x00-\x7f]+|(.)\1*", re.S)


# ---- features -------------------------------------------------------------------------------------------------------


def shape(token: str) -> str:
    """Runs of small letters as a, of capitals as A, of digits as 9, of other letters as u; a sign as itself."""

    def one(m: re.Match) -> str:
        c = m.group()[0]
        return m.group(1) or ("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "u")

    return _SHAPE.sub(one, token)[:16]


def _bucket(n: int) -> str:
    return str(n) if n <= 4 else next(f"<{b}" for b in (8, 12, 16, 17, 20, 21, 32, 48, 10**9) if n < b)


def features(token: str) -> list[str]:
    """What the field sees of a token by itself; of a plain one, nothing."""
    if is_plain(token):
        return []
    core = token.strip(_EDGE)
    name, sep, value = core.partition("=")
    digits = sum(c.isdigit() for c in core)
    out = ["bias", "shape:" + shape(core), "edge:" + shape(token)[:2] + "~" + shape(token)[-1:], "length:" + _bucket(len(core)), "digits:" + _bucket(digits)]
    kinds = "".join(k for k, test in (("a", str.islower), ("A", str.isupper), ("9", str.isdigit)) if any(map(test, core)))
    out.append("kinds:" + kinds + ("*" if not core.isalnum() else ""))
    out.append(f"kinds:{kinds}{'*' if not core.isalnum() else ''}:{_bucket(len(core))}")
    if m := _V4.match(core):
        out.append("v4" if all(int(g) < 256 for g in m.groups()) else "not v4")
    if "@" in core:
        out.append("mail" if _MAIL.match(core) else "at")
    if sep:
        out += ["named:" + ("secret" if name.lower().strip(_EDGE) in SECRET_WORDS else "other"), "value:" + _bucket(len(value))]
    if re.fullmatch(r"[0-9a-f]{16,}", value or core):
        out.append("hex")
    if re.fullmatch(r"[A-Z0-9]{16,}", core):
        out.append("code:" + core[:4])
    return out


def context(token: str | None) -> str:
    """What the field sees of the token before or after."""
    if token is None:
        return "none"
    core = token.strip(_EDGE)
    if core.lower() in SECRET_WORDS:
        return "secret"
    return "w" if is_plain(token) else shape(token)[:4]


def is_plain(token: str) -> bool:
    raw = token.encode("utf-8", "surrogatepass")
    return not any(b in SPECIAL for b in raw) and not _CODE.search(token)


# ---- labelled table -------------------------------------------------------------------------------------------------


def labelled_rows(seed: int = 7, sentences: int = 700) -> list[tuple[int, int, str, str]]:
    """(seq, pos, token, label): a small labelled table of made-up sentences."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "re", "in", "so", "the", "an", "er", "lo", "mi", "und", "que", "é"]) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))

    def entity() -> list[tuple[str, str]]:
        kind = r.choice(LABELS[1:])
        if kind == "EMAIL":
            user = r.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}+{word()}"])
            return [(f"{user}@{r.choice([word(), word() + digits(1), word() + '-' + word()])}{r.choice(['', '.example', '.mail', '.co'])}.{r.choice(['com', 'org', 'net', 'de', 'fr'])}", kind)]
        if kind == "PHONE":
            form = r.choice(["+1 (%3) %3-%4", "+1 (%3) %3-%4", "(%3) %3-%4", "%3-%3-%4", "+1-%3-%3-%4", "+%2 %3 %6", "+1 %3 %3 %4", "%3.%3.%4", "+%2%10"])
            return [(t, kind) for t in re.sub(r"%(\d+)", lambda m: digits(int(m[1])), form).split()]
        if kind == "IP":
            return [(".".join(str(r.randint(0, 255)) for _ in range(4)), kind)]
        if kind == "CARD":
            n = digits(16)
            return [(t, kind) for t in r.choice([n, n, n, " ".join(n[i : i + 4] for i in (0, 4, 8, 12)), "-".join(n[i : i + 4] for i in (0, 4, 8, 12)), n[:15]]).split()]
        if kind == "KEY":
            return [(r.choice(["AKIA", "AKIA", "ASIA"]) + upper(16), kind)]
        value = r.choice([hexes(r.randint(16, 40)), hexes(18), hexes(40), word() + digits(3) + word()])
        name = r.choice(["password", "passwd", "secret", "token", "api_key", "pwd"])
        return r.choice([[(f"{name}={value}", kind)], [(f'{name}="{value}"', kind)], [(name, "O"), ("=", "O"), (f'"{hexes(r.choice([32, 40]))}"', kind)], [(f"{name}:", "O"), (hexes(r.randint(20, 40)), kind)]])

    def decoy() -> list[tuple[str, str]]:
        tokens = r.choice([
            f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{r.randint(1000, 2100)}", f"({r.randint(1000, 2100)})", f"({digits(3)})", f"{digits(2)}:{digits(2)}", f"{digits(2)}%",
            f"${digits(2)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", digits(r.randint(1, 10)), f"{digits(1)}-{digits(1)}", f"{word()}/{word()}", f"{word()}={digits(1)}", f"{word()}={word()}", f"v{digits(1)}.{digits(1)}.{digits(1)}",
            f"@{word()}", f"{word()}{digits(1)}", f"{upper(3)}{digits(2)}", f"{word()}_{word()}", f"CC BY-NC {digits(1)}.0.", f"{word()}{word()}{word()}{word()}{word()}ta", "=", "+", f"+{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"[{digits(1)}]", f"<{word()}>",
            (word() * 5).upper(), word() * 7, f"{word() * 7}{r.choice('*#%&$') * 3}", f"{word() * 6}.{r.choice('*#%&$') * 3}", f"{word() * 6},", f"{word() * 6}é".capitalize() + ".", f"{word() * 3}...{word() * 3}", f"{digits(3)} {digits(3)}", f"https://{word()}.com/{word()}", f"x = {digits(2)}", f'{word()} = "{word()}"', f"{word()}***", f"{digits(2)}.{digits(2)}.{r.randint(1900, 2030)}",
        ])
        return [(t, "O") for t in tokens.split()]

    out = []
    for seq in range(sentences):
        row: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 4)):
            row += [(word().capitalize() if r.random() < 0.2 else word(), "O") for _ in range(r.randint(0, 4))]
            if r.random() < 0.85:
                part = entity() if r.random() < 0.55 else decoy()
                if r.random() < 0.2:
                    part[-1] = (part[-1][0] + r.choice([*".,;:!?)", r.choice("*#%&$") * 3]), part[-1][1])
                row += part
            if r.random() < 0.3:
                row.append((word() + r.choice([",", ".", "!!", ";"]), "O"))
        out += [(seq, pos, t, y) for pos, (t, y) in enumerate(row)]
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "seq int, pos int, token string, label string")


# ---- the field ------------------------------------------------------------------------------------------------------


#: The field's constraint: a plain token is outside. Sequences can be cut there without changing any best path.
OUTSIDE = np.array([0.0, *[-1e6] * (len(LABELS) - 1)])


@dataclass
class Field:
    """Weights of own features and of the contexts before and after, and of pairs of labels; start and end are label 0."""

    own: dict[str, np.ndarray]
    before: dict[str, np.ndarray]
    after: dict[str, np.ndarray]
    pairs: np.ndarray

    def emission(self, token: str) -> np.ndarray:
        return sum((self.own[f] for f in features(token) if f in self.own), OUTSIDE if is_plain(token) else np.zeros(len(LABELS)))


def viterbi(emit: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once. ``emit``: all tokens' weights, sequence after sequence; ties go to the lower label.

    Sequences are taken longest first, so that step t works on those that have a token t, and nothing is padded.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    out = np.zeros(len(emit), np.int8)
    if not len(sizes):
        return out
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    score = emit[begin] + pairs[0]
    ends, back = np.empty((len(sizes), emit.shape[1])), []
    for t in range(1, sizes[0]):
        n = alive[t]
        ends[n : len(score)] = score[n:]
        step = score[:n, :, None] + pairs
        back.append(step.argmax(1).astype(np.int8))
        score = step.max(1) + emit[begin[:n] + t]
    ends[: len(score)] = score
    label = (ends + pairs[:, 0]).argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        n = alive[t]
        out[begin[:n] + t] = label[:n]
        if t:
            label[:n] = back[t - 1][np.arange(n), label[:n]]
    return out


def train(rows: list[tuple[int, int, str, str]], rounds: int = 100, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps (Adam), forward-backward over all sequences at once."""
    seqs: dict[int, list] = {}
    for seq, pos, token, label in sorted(rows):
        seqs.setdefault(seq, []).append((token, LABELS.index(label)))
    data = sorted(seqs.values(), key=len, reverse=True)
    n, most, k = len(data), max(map(len, data)), len(LABELS)
    names: dict[str, int] = {}
    base = np.zeros((len(rows), k))
    at, rowsf, colsf = np.full((n, most), -1), [], []
    gold, mask, flat = np.zeros((n, most), int), np.zeros((n, most), bool), 0
    for i, row in enumerate(data):
        for t, (token, label) in enumerate(row):
            base[flat] = OUTSIDE if is_plain(token) else 0
            own = ["o " + f for f in features(token)]
            around = ["b " + context(row[t - 1][0] if t else None), "a " + context(row[t + 1][0] if t + 1 < len(row) else None)]
            ids = [names.setdefault(f, len(names)) for f in own + around]
            rowsf += [flat] * len(ids)
            colsf += ids
            at[i, t], gold[i, t], mask[i, t] = flat, label, True
            flat += 1
    rowsf, colsf = np.array(rowsf), np.array(colsf)
    W, T = np.zeros((len(names), k)), np.zeros((k, k))
    goldflat = np.zeros((flat, k))
    goldflat[at[mask], gold[mask]] = 1
    steps = [(np.zeros_like(x), np.zeros_like(x)) for x in (W, T)]
    gold_pairs = np.zeros((k, k))
    for i, row in enumerate(data):
        path = [0, *(y for _, y in row), 0]
        np.add.at(gold_pairs, (path[:-1], path[1:]), 1)
    lengths = mask.sum(1)
    alive = mask.sum(0)

    # tokens' features stand together in rowsf, and every feature is some token's: sums over runs, of tokens and of features in turn
    by_token = np.flatnonzero(np.diff(rowsf, prepend=-1))
    order = np.argsort(colsf, kind="stable")
    by_feature, token_of = np.flatnonzero(np.diff(colsf[order], prepend=-1)), rowsf[order]

    for it in range(1, rounds + 1):
        E = np.concatenate([np.add.reduceat(W[colsf], by_token) + base, np.zeros((1, k))])[at]  # n, most, k
        fwd, bwd = np.zeros((n, most, k)), np.broadcast_to(T[:, 0], (n, most, k)).copy()
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        fwd[:, 0] = E[:, 0] + T[0]
        for t in range(1, most):  # the longest sequences come first, so those that go on are the first ones
            m = alive[t]
            fwd[:m, t] = lse(fwd[:m, t - 1, :, None] + T, 1) + E[:m, t]
        for t in range(most - 2, -1, -1):
            m = alive[t + 1]
            bwd[:m, t] = lse(T + (bwd[:m, t + 1] + E[:m, t + 1])[:, None, :], 2)
        z = lse(fwd[np.arange(n), lengths - 1] + T[:, 0], 1)
        post = np.exp(fwd + bwd - z[:, None, None])[mask]
        grad_w = np.add.reduceat((post - goldflat)[token_of], by_feature)  # both are in the order of tokens, sequence by sequence
        inner = mask[:, 1:]
        pair = np.exp((fwd[:, :-1] - z[:, None, None])[inner][:, :, None] + T + (bwd[:, 1:] + E[:, 1:])[inner][:, None, :])
        grad_t = pair.sum(0) - gold_pairs
        grad_t[0] += np.exp(E[:, 0] + T[0] + bwd[:, 0] - z[:, None]).sum(0)
        grad_t[:, 0] += np.exp(fwd[np.arange(n), lengths - 1] + T[:, 0] - z[:, None]).sum(0)
        for x, g, (m, v) in ((W, grad_w + decay * n * W / 10, steps[0]), (T, grad_t + decay * n * T / 10, steps[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    pick = lambda side: {f[2:]: W[i] for f, i in names.items() if f[0] == side}
    return Field(pick("o"), pick("b"), pick("a"), T)


def fit(labelled: DataFrame, max_rows: int = 50_000) -> Field:
    """The field of a labelled table (seq, pos, token, label), of which at most ``max_rows`` first rows are used."""
    rows = labelled.orderBy("seq", "pos").limit(max_rows).collect()
    return train([tuple(r) for r in rows])


# ---- decoding -------------------------------------------------------------------------------------------------------

_NONSPACE = np.ones(256, bool)
_NONSPACE[[9, 10, 11, 12, 13, 32]] = False
_IS_SPECIAL = np.zeros(256, bool)
_IS_SPECIAL[list(SPECIAL)] = True


def find(field: Field, data: np.ndarray, bounds: np.ndarray, cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, label) of each token in ``data`` that isn't O. ``bounds``: where texts begin, and the end of the last.

    With ``cut`` only runs of tokens that aren't plain are decoded, with the same result (see ``OUTSIDE``).
    """
    none = np.empty(0, np.int64)
    lo, hi = bounds[0], bounds[-1]
    body = data[lo:hi]
    inside = _NONSPACE[body]
    if not inside.any():
        return none, none, none
    edge = np.zeros(len(body) + 1, bool)
    edge[bounds - lo] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    text_of = np.searchsorted(bounds - lo, starts, "right")
    if cut:
        looked = np.zeros(len(starts), bool)
        looked[np.searchsorted(starts, np.flatnonzero(_IS_SPECIAL[body]), "right") - 1] = True
        looked |= ends - starts >= LONG
        chosen = np.flatnonzero(looked)
    else:
        chosen = np.arange(len(starts))
    if not len(chosen):
        return none, none, none
    raw = body.tobytes()
    word = lambda i: raw[starts[i] : ends[i]].decode("utf-8", "replace")
    ids: dict[str, int] = {}
    own = np.fromiter((ids.setdefault(word(i), len(ids)) for i in chosen), np.int64, len(chosen))
    table = np.stack([field.emission(w) for w in ids])
    emit = table[own]
    zero = np.zeros(len(LABELS))
    for side, shift in ((field.before, -1), (field.after, 1)):
        near = chosen + shift
        ok = (near >= 0) & (near < len(starts))
        ok[ok] = text_of[near[ok]] == text_of[chosen[ok]]
        kinds: dict[str, int] = {}
        which = np.fromiter((kinds.setdefault(context(word(i) if there else None), len(kinds)) for i, there in zip(near, ok, strict=True)), np.int64, len(near))
        emit = emit + np.stack([side.get(k, zero) for k in kinds])[which]
    new = np.concatenate([[True], (np.diff(chosen) > 1) | (np.diff(text_of[chosen]) > 0)])
    begin = np.flatnonzero(new)
    labels = viterbi(emit, field.pairs, np.diff(np.append(begin, len(chosen))))
    hit = labels > 0
    return starts[chosen[hit]] + lo, ends[chosen[hit]] + lo, labels[hit].astype(np.int64)


#: Neighbouring tokens of at least this many bytes each are two numbers, not two parts of one.
WHOLE = 12
#: Signs that don't belong to what stands before them.
_TRAILING = frozenset(bytes((c,)) for c in b".,;:!?\"'*#%&$|")


def spans(raw: bytes, starts, ends, labels) -> list[tuple[int, int, int]]:
    """Tokens as spans to mask: parts of one phone or card number together, without quotes and stops at the edges, and without a secret's name."""
    out: list[tuple[int, int, int]] = []
    for s, e, y in zip(starts, ends, labels, strict=True):
        s, e = int(s), int(e)
        whole = bool(out) and min(out[-1][1] - out[-1][0], e - s) >= WHOLE
        if LABELS[y] in ("PHONE", "CARD") and out and out[-1][2] == y and raw[out[-1][1] : s] == b" " and not whole:
            out[-1] = (out[-1][0], e, y)
            continue
        if LABELS[y] == "SECRET":
            at = max(raw.find(b"=", s, e), raw.find(b":", s, e))
            s = at + 1 if s <= at < e - 1 else s
        out.append((s, e, y))
    cleaned = []
    for s, e, y in out:
        while e > s + 1 and raw[e - 1 : e] in _TRAILING:
            e -= 1
        while e > s + 1 and raw[s : s + 1] in (b'"', b"'"):
            s += 1
        cleaned.append((s, e, int(y)))
    return cleaned


def _masked(field: Field, column: pa.Array) -> tuple[pa.Array, list[int]]:
    """The texts with spans replaced by <LABEL>, and the number of spans of each. Null stays null, with 0."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    changed: dict[int, str] = {}
    counts, row = [0] * len(column), 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        bounds = offsets[row : last + 1].astype(np.int64)
        starts, ends, labels = find(field, data, bounds)
        owner = np.searchsorted(bounds, starts, "right") - 1
        for k in np.unique(owner):
            own = owner == k
            a, b = int(bounds[k]), int(bounds[k + 1])
            raw, parts, at = data[a:b].tobytes(), [], 0
            todo = spans(raw, starts[own] - a, ends[own] - a, labels[own])
            for s, e, y in todo:
                parts += [raw[at:s], f"<{LABELS[y]}>".encode()]
                at = e
            changed[row + int(k)] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            counts[row + int(k)] = len(todo)
        row = last
    if not changed:
        return column.cast(pa.string()), counts
    values = column.to_pylist()
    for i, v in changed.items():
        values[i] = v
    return pa.array(values, pa.string()), counts


def _masker(field: Field, schema_names: list[str] | None):
    at = 1 if schema_names is None else [n.lower() for n in schema_names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, counts = _masked(field, batch.column(at))
            if schema_names is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(counts, pa.int32())], ["doc_id", "text", "n_masked"])
            else:
                yield pa.RecordBatch.from_arrays([text if i == at else batch.column(i) for i in range(len(schema_names))], schema_names)

    return run


def pii(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, n_masked): texts with personal data and secrets replaced by <EMAIL>, <PHONE>, <IP>, <CARD>, <KEY> or <SECRET>.

    Tokens are what white space separates. ``labelled`` (seq, pos, token, label) trains the field; by default
    :func:`labelled_table`. Whole texts are decoded, of any length.

    The field is constrained: a token is O, whatever its neighbours, if it has no ASCII digit and none of the signs of
    ``SPECIAL`` and no 16 capitals in a row. So names, streets, secrets of letters only, and numbers in other digits than
    ASCII ones aren't found, also with another ``labelled``. Shapes have 16 signs at most.

    Null text stays null and empty text empty, with 0 masked; a null doc_id stays null. Repeated rows are treated
    alike. Equal scores go to the label named first in ``LABELS``. Other columns are left out. An empty table gives
    an empty table.
    """
    field = fit(labelled if labelled is not None else labelled_table(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_masker(field, None), "doc_id bigint, text string, n_masked int")


def stage(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with masked texts, and ``n_chars`` to match."""
    field = fit(labelled if labelled is not None else labelled_table(docs.sparkSession))
    out = docs.mapInArrow(_masker(field, list(docs.columns)), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
