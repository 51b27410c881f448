"""Queries over the test tables, one for each group of operators, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtok.functions import text as T
from loomtok.functions.chars import BYTE_CHARS, RE2_CLASS
from loomtok.operators import bpe, counts, unigram
from loomtok.operators.encode import Model, encode_column, joined_column, round_trip_column
from loomtok.plans.config import TrainConfig, TrainerKind
from loomtok.plans.dataset import file_totals, in_shards, kept_text, pending, placed
from loomtok.plans.tokenizer import offsets, token_ids
from loomtok.plans.training import Trained, learn
from loomtok.sources import readers
from loomtok.sources.shared import settled, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PIECES = f"regexp_extract_all(text, '[{RE2_CLASS}]*[^{RE2_CLASS}]+|[{RE2_CLASS}]+')"
WORDS = f"list_filter(regexp_split_to_array(text, '[{RE2_CLASS}]+'), lambda w: w <> '')"
CHARS = "string_split(piece, '')"
_BYTE_LIST = "['" + "','".join(c.replace("'", "''") for c in BYTE_CHARS) + "']"


def encoded(column: str) -> str:
    """Each byte of a string as its character of the byte alphabet."""
    return f"array_to_string(list_transform(range(1, octet_length(encode({column})) + 1), lambda i: {_BYTE_LIST}[CAST('0x' || substr(hex(encode({column})), 2 * i - 1, 2) AS INTEGER) + 1]), '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(counts.prepared(_docs(spark, sf_dir).select("text"), max_chars=0))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.piece_counts(_rows(spark, sf_dir), TrainerKind.bpe)


_WORD_COUNTS = f"SELECT piece, count(*) AS freq FROM (SELECT unnest({WORDS}) AS piece FROM documents WHERE text <> '') GROUP BY piece"
_PIECE_COUNTS = f"SELECT piece, count(*) AS freq FROM (SELECT unnest({PIECES}) AS piece FROM documents WHERE text <> '') GROUP BY piece"

# ---- sources, filters, functions ------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n_chars, length(left(text, 1000)) AS n_kept, length(text) >= 100 AS long_enough FROM documents WHERE text <> ''")
def truncated_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(T.has_text("text"))
    return docs.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.char_length(T.truncate("text", 1000)).cast("bigint").alias("n_kept"), T.long_enough("text", 100).alias("long_enough"))


@query(f"""SELECT lang, count(*) FILTER (WHERE length(text) >= 200) AS num_docs, count(*) FILTER (WHERE length(text) < 200 AND text <> '') AS num_skipped,
count(*) FILTER (WHERE text IS NULL OR text = '') AS num_empty, CAST(coalesce(sum(length(text)) FILTER (WHERE length(text) >= 200), 0) AS BIGINT) AS num_chars
FROM documents GROUP BY lang""")
def doc_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.filter_stats(_docs(spark, sf_dir), 200, 0, "lang")


@query("SELECT event_id, json_extract_string(line, '$.text') AS text FROM (SELECT event_id, to_json({'id': event_id, 'text': event_type || ' \"' || coalesce(props, '') || '\"'}) AS line FROM events)")
def json_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON written by Spark, read by the scanner for the first string of a key."""
    import pyarrow as pa

    text = F.concat("event_type", F.lit(' "'), F.coalesce("props", F.lit("")), F.lit('"'))
    lines = spread(_docs(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), text.alias("text"))).alias("line")))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([readers.line_text(x, "text") for x in b.column(1).to_pylist()], pa.string())], ["event_id", "text"])

    return lines.mapInArrow(run, "event_id bigint, text string")


@query("SELECT p_partkey, p_name, starts_with(p_name, 'a') AS is_prefixed, ends_with(p_name, 'e') AS is_suffixed FROM part")
def prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").select("p_partkey", "p_name", T.prefixed("p_name", "a").alias("is_prefixed"), T.suffixed("p_name", "e").alias("is_suffixed"))


# ---- counting -------------------------------------------------------------------------------------------------------


@query(_PIECE_COUNTS)
def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.counted(_rows(spark, sf_dir))


@query(_WORD_COUNTS)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


@query(f"SELECT {encoded('piece')} AS piece, freq FROM ({_PIECE_COUNTS})")
def bytelevel_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.piece_counts(_rows(spark, sf_dir), TrainerKind.byte_bpe)


@query(f"SELECT {encoded('piece')} AS piece, freq FROM ({_PIECE_COUNTS} ORDER BY freq DESC, encode(piece) LIMIT 200)")
def topk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most frequent byte-level pieces; the order of raw pieces breaks ties."""
    return counts.top_pieces(counts.counted(_rows(spark, sf_dir)), 200).select(T.byte_encode("piece").alias("piece"), "freq")


@query(f"SELECT piece, freq FROM ({_WORD_COUNTS}) WHERE freq >= 2")
def min_freq_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.frequent(_words(spark, sf_dir), 2)


@query(f"SELECT DISTINCT unnest({CHARS}) AS symbol FROM ({_WORD_COUNTS})")
def char_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.alphabet(_words(spark, sf_dir))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select(T.continued(T.code_points("piece"), "##").alias("syms"), "freq")


_SYMBOLS = f"SELECT list_transform({CHARS}, lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END) AS syms, freq FROM ({_WORD_COUNTS})"
_SYMBOL_COUNTS = f"SELECT symbol, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(syms) AS symbol, freq FROM ({_SYMBOLS})) GROUP BY symbol"
_PAIR_COUNTS = f"SELECT l, r, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT syms[i] AS l, syms[i + 1] AS r, freq FROM (SELECT syms, freq, unnest(range(1, len(syms))) AS i FROM ({_SYMBOLS}))) GROUP BY l, r"


@query(_SYMBOL_COUNTS)
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.symbol_counts(_symbols(spark, sf_dir))


@query(_PAIR_COUNTS)
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pair_counts(_symbols(spark, sf_dir))


@query(f"""WITH s AS ({_SYMBOL_COUNTS}), p AS ({_PAIR_COUNTS})
SELECT p.l, p.r, p.freq, CAST(p.freq AS DOUBLE) / (CAST(a.freq AS DOUBLE) * CAST(b.freq AS DOUBLE)) AS score FROM p JOIN s a ON p.l = a.symbol JOIN s b ON p.r = b.symbol""")
def wordpiece_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = settled(_words(spark, sf_dir))  # read for pairs and for symbols, and the texts once
    return counts.pair_scores(words.select(T.continued(T.code_points("piece"), "##").alias("syms"), "freq"))


_SEEDS = f"""SELECT token, CAST(sum(freq) AS BIGINT) AS freq, length(token) = 1 AS required FROM (
SELECT substr(piece, i, k) AS token, freq FROM (SELECT piece, freq, i, unnest(range(1, least(6, length(piece) - i + 1) + 1)) AS k
FROM (SELECT piece, freq, unnest(range(1, length(piece) + 1)) AS i FROM ({_WORD_COUNTS}) WHERE freq >= 5))) GROUP BY token"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.seed_counts(_words(spark, sf_dir), 6, 5)


@query(_SEEDS)
def unigram_seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir)


def _logp(seeds: str) -> str:
    return f"SELECT token, round(ln((freq + 1e-6) / (sum(freq) OVER () + count(*) OVER () * 1e-6)), 8) AS logp FROM ({seeds})"


@query(_logp(_SEEDS))
def unigram_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of these seeds with their normalised log-probability."""
    return unigram.normalised(_seeds(spark, sf_dir)).select("token", F.round("logp", 8).alias("logp"))


UNIGRAM_CONFIG = TrainConfig(trainer=TrainerKind.unigram)

_ALL_SEEDS = f"""SELECT token, CAST(sum(freq) AS BIGINT) AS freq, length(token) = 1 AS required FROM (
SELECT substr(piece, i, k) AS token, freq FROM (SELECT piece, freq, i, unnest(range(1, least(16, length(piece) - i + 1) + 1)) AS k
FROM (SELECT piece, freq, unnest(range(1, length(piece) + 1)) AS i FROM ({_WORD_COUNTS}) WHERE freq >= 2))) GROUP BY token"""


@query(_ALL_SEEDS)
def unigram_all_seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character and substring that the trainer counts by default."""
    return counts.seed_counts(_words(spark, sf_dir), UNIGRAM_CONFIG.max_token_length, UNIGRAM_CONFIG.min_freq)


@query(f"""WITH s AS MATERIALIZED ({_ALL_SEEDS}), r AS (SELECT count(*) AS n FROM s WHERE required),
t AS (SELECT token, freq FROM (SELECT *, row_number() OVER (PARTITION BY required ORDER BY freq DESC, encode(token)) AS k FROM s), r WHERE required OR k <= greatest(greatest(49999, n) * 4, n + 32) - n)
{_logp("SELECT * FROM t")}""")
def unigram_seed_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed table that the trainer starts from by default, with all characters, and its normalised log-probabilities."""
    c = UNIGRAM_CONFIG
    words = settled(counts.frequent(_words(spark, sf_dir), c.min_freq))
    seeds = unigram.seed(words, c.vocab_size - len(c.specials()), c.min_freq, c.max_token_length, c.unigram_seed_multiplier)
    return unigram.normalised(seeds).select("token", F.round("logp", 8).alias("logp"))


# ---- merges and encoding --------------------------------------------------------------------------------------------

ROUNDS = 6


def _merge_sql(rounds: int) -> str:
    """Words with symbols between two signs, the best pair, and replacement, unrolled."""
    o, c = "chr(57344)", "chr(57345)"
    out = [f"w0 AS (SELECT {o} || array_to_string({CHARS}, {c} || {o}) || {c} AS word, freq FROM ({_WORD_COUNTS}) WHERE freq >= 2)"]
    for k in range(rounds):
        split = f"string_split(substr(word, 2, length(word) - 2), {c} || {o})"
        out.append(f"p{k} AS (SELECT syms[i] AS l, syms[i + 1] AS r, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT syms, freq, unnest(range(1, len(syms))) AS i FROM (SELECT {split} AS syms, freq FROM w{k})) GROUP BY ALL)")
        out.append(f"b{k} AS (SELECT l, r, freq FROM p{k} ORDER BY freq DESC, encode(l), encode(r) LIMIT 1)")
        out.append(f"w{k + 1} AS (SELECT replace(w.word, {o} || b.l || {c} || {o} || b.r || {c}, {o} || b.l || b.r || {c}) AS word, w.freq FROM w{k} w, b{k} b)")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f'SELECT {k} AS "rank", l AS "left", r AS "right" FROM b{k}' for k in range(rounds))


@query(_merge_sql(ROUNDS))
def bpe_first_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first merges that training learns from words of at least two occurrences."""
    words = settled(counts.frequent(_words(spark, sf_dir), 2).select(T.code_points("piece").alias("syms"), "freq"))
    base = {r[0] for r in words.select(F.explode("syms")).distinct().collect()}
    merges = bpe.learn_distributed(words, base, len(base) + ROUNDS, 1)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left string, right string")


MERGES = [("t", "h"), ("e", "r"), ("o", "n"), ("i", "n"), ("a", "n"), ("r", "e"), ("th", "e"), ("e", "n"), ("e", "s"), ("in", "g"), ("an", "d"), ("o", "u")]
_LETTERS = [chr(c) for c in range(33, 127)]
BPE_MODEL = Model("BPE", {t: i for i, t in enumerate([*_LETTERS, *("".join(m) for m in MERGES)])}, MERGES, unk_token="?", byte_level=False)


def _bpe_sql() -> str:
    o, c = "chr(57344)", "chr(57345)"
    word = f"{o} || array_to_string({CHARS}, {c} || {o}) || {c}"
    for left, right in MERGES:
        word = f"replace({word}, {o} || '{left}' || {c} || {o} || '{right}' || {c}, {o} || '{left + right}' || {c})"
    vocab = "MAP {" + ", ".join(f"'{t.replace(chr(39), chr(39) * 2)}': {i}" for t, i in BPE_MODEL.vocab.items()) + "}"
    ids = f"list_transform(string_split(substr(m, 2, length(m) - 2), {c} || {o}), lambda s: {vocab}[s])"
    return f"""WITH d AS (SELECT doc_id, w.piece, w.pos FROM (SELECT doc_id, unnest(list_zip({WORDS}, range(1, len({WORDS}) + 1))) AS z FROM documents) t, LATERAL (SELECT z[1] AS piece, z[2] AS pos) w),
u AS (SELECT piece, CASE WHEN regexp_full_match(piece, '[!-~]+') THEN {ids} ELSE [] END AS ids FROM (SELECT piece, {word} AS m FROM (SELECT DISTINCT piece FROM d)))
SELECT doc_id, CAST(coalesce(sum(len(ids)), 0) AS BIGINT) AS n_ids, coalesce(string_agg(array_to_string(ids, ' '), ' ' ORDER BY pos) FILTER (WHERE len(ids) > 0), '') AS ids
FROM (SELECT doc_id FROM documents) LEFT JOIN d USING (doc_id) LEFT JOIN u USING (piece) GROUP BY doc_id"""


@query(_bpe_sql())
def bpe_encode_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a small fixed model; a word with a character that it hasn't gives nothing."""
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text"))
    ids = encode_column(docs, BPE_MODEL, ["doc_id"])
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


WORDPIECE_MODEL = Model("WordPiece", {t: i for i, t in enumerate(["[UNK]", *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), "the", "th", "an", "and", "on", "##er", "##re", "##on", "##ing", "##th", "##in", "##es", "##nt", "##an"])}, unk_token="[UNK]", byte_level=False)


def _wordpiece_sql() -> str:
    vocab = ", ".join(f"('{t}', {i})" for t, i in WORDPIECE_MODEL.vocab.items())
    return f"""WITH RECURSIVE v(token, id) AS (VALUES {vocab}), w AS MATERIALIZED (SELECT piece FROM ({_WORD_COUNTS})),
m(piece, place, ids) AS (SELECT piece, 1, CAST([] AS INTEGER[]) FROM w UNION ALL
 SELECT s.piece, s.place + s.n, list_append(s.ids, s.id) FROM (
  SELECT m.piece, m.place, m.ids, k.n, v.id, row_number() OVER (PARTITION BY m.piece, m.place ORDER BY k.n DESC) AS best
  FROM m, (SELECT unnest(range(1, 6)) AS n) k, v WHERE m.place + k.n <= length(m.piece) + 1 AND v.token = CASE WHEN m.place > 1 THEN '##' ELSE '' END || substr(m.piece, m.place, k.n)) s WHERE best = 1)
SELECT w.piece, coalesce(array_to_string(f.ids, ' '), '0') AS ids FROM w LEFT JOIN (SELECT piece, ids FROM m WHERE place = length(piece) + 1) f USING (piece)"""


@query(_wordpiece_sql())
def wordpiece_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode_column(_words(spark, sf_dir), WORDPIECE_MODEL, ["piece"], "piece")
    return ids.select("piece", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


#: No two segmentations of a word score alike: weights are powers of 2 apart for tokens of several letters.
UNIGRAM_MODEL = Model("Unigram", {}, scores=[*((c, -8.0 - k / 64) for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")), ("th", -9.0), ("the", -10.5), ("er", -9.25), ("on", -9.125), ("ing", -11.0), ("and", -12.0), ("re", -9.375), ("in", -10.0)], byte_level=False)
UNIGRAM_MODEL.vocab = {t: i for i, (t, _) in enumerate(UNIGRAM_MODEL.scores)}


def _unigram_sql() -> str:
    """The dynamic program letter by letter; of the best sums and their ids the last three are enough for tokens of three letters."""
    model = UNIGRAM_MODEL
    scores = "MAP {" + ", ".join(f"'{t}': {s}" for t, s in model.scores) + "}"
    ids = "MAP {" + ", ".join(f"'{t}': {i}" for t, i in model.vocab.items()) + "}"
    ends = [f"substr(piece, j - {k - 2}, {k})" if k > 1 else "substr(piece, j + 1, 1)" for k in (1, 2, 3)]
    sums = [f"best[{4 - k}] + s[{ends[k - 1]}]" if k == 1 else f"CASE WHEN j >= {k - 1} THEN best[{4 - k}] + s[{ends[k - 1]}] END" for k in (1, 2, 3)]
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT piece FROM ({_WORD_COUNTS})), t AS MATERIALIZED (SELECT {scores} AS s, {ids} AS d),
r(piece, j, best, path) AS (SELECT piece, 0, [NULL, NULL, CAST(0 AS DOUBLE)], [NULL, NULL, ''] FROM w WHERE regexp_full_match(piece, '[a-z]+') UNION ALL
 SELECT piece, j + 1, [best[2], best[3], greatest(c1, coalesce(c2, c1), coalesce(c3, c1))],
  [path[2], path[3], CASE WHEN c3 >= greatest(c1, coalesce(c2, c1)) THEN path[1] || ' ' || d[{ends[2]}] WHEN c2 >= c1 THEN path[2] || ' ' || d[{ends[1]}] ELSE path[3] || ' ' || d[{ends[0]}] END]
 FROM (SELECT r.*, t.d, {", ".join(f"{x} AS c{k + 1}" for k, x in enumerate(sums))} FROM r, t WHERE j < length(piece)))
SELECT w.piece, coalesce(substr(f.path[3], 2), '') AS ids FROM w LEFT JOIN (SELECT piece, path FROM r WHERE j = length(piece)) f USING (piece)"""


@query(_unigram_sql())
def unigram_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best segmentations; a word with none gives nothing, since the model has no unknown token."""
    ids = encode_column(_words(spark, sf_dir), UNIGRAM_MODEL, ["piece"], "piece")
    return ids.select("piece", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


# ---- ids, batches, shards -------------------------------------------------------------------------------------------


#: A byte-level model without merges: the id of a token is its byte.
BYTE_MODEL = Model("BPE", {c: b for b, c in enumerate(BYTE_CHARS)})


def _byte_ids(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return encode_column(_docs(spark, sf_dir, name), BYTE_MODEL, columns)


_BYTES = "list_transform(range(1, octet_length(encode(text)) + 1), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i - 1, 2) AS INTEGER))"


@query(f"SELECT item_id, array_to_string(list_concat([256], {_BYTES}, [257]), ' ') AS ids FROM benchmark")
def bos_eos_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_column(_docs(spark, sf_dir, "benchmark"), BYTE_MODEL, ["item_id"], bos=256, eos=257)


@query(f"""WITH b AS (SELECT conv_id, turn, {_BYTES} AS ids FROM conversations), m AS (SELECT conv_id, max(len(ids)) AS longest FROM b GROUP BY conv_id)
SELECT b.conv_id, b.turn, array_to_string(list_concat(ids, list_transform(range(0, longest - len(ids)), lambda i: 0)), ' ') AS input_ids, len(ids) AS "length" FROM b JOIN m USING (conv_id)""")
def padded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a batch, filled up to its longest turn."""
    from loomtok.plans.tokenizer import padded

    out = padded(_byte_ids(spark, sf_dir, "conversations", ["conv_id", "turn"]), "conv_id")
    return out.select("conv_id", "turn", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"), F.col("length").cast("bigint").alias("length"))


@query("""SELECT doc_id, octet_length(encode(text)) AS "length", CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS doc_offset FROM documents""")
def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.octet_length("text").cast("bigint").alias("length"), F.floor(F.col("doc_id") / 4096).alias("block"))
    return offsets(rows, ["doc_id"], "block").select("doc_id", "length", "doc_offset")


@query("""WITH d AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM conversations),
k AS (SELECT s, n, unnest(range(s // 5000, (s + n - 1) // 5000 + 1)) AS shard FROM d WHERE n > 0)
SELECT shard, greatest(shard * 5000, s) - shard * 5000 AS "at", least((shard + 1) * 5000, s + n) - greatest(shard * 5000, s) AS n_tokens FROM k""")
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of documents that go to each shard of 5000 tokens."""
    ids = _byte_ids(spark, sf_dir, "conversations", ["conv_id", "turn"])
    docs = placed(ids.select(F.lit(0).alias("file_idx"), F.floor(F.col("conv_id") / 64).alias("part"), F.struct("conv_id", "turn").alias("pos"), "ids"), 0)
    return in_shards(docs, 5000).select("shard", "at", F.size("ids").cast("bigint").alias("n_tokens"))


_VOCAB = f"SELECT piece AS token, row_number() OVER (ORDER BY freq DESC, encode(piece)) - 1 AS id FROM (SELECT * FROM ({_WORD_COUNTS}) ORDER BY freq DESC, encode(piece) LIMIT 1000)"


@query(f"WITH v AS ({_VOCAB}) SELECT piece, freq, id FROM ({_WORD_COUNTS}) LEFT JOIN v ON token = piece")
def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its id in a vocabulary of the 1000 most frequent, null for others."""
    words = settled(_words(spark, sf_dir))
    top = [r.piece for r in counts.top_pieces(words, 1000).collect()]  # a vocabulary of a fixed size
    return token_ids(words, Model("WordPiece", {t: i for i, t in enumerate(top)}, byte_level=False), "piece")


@query("SELECT d.doc_id, d.n_chars FROM documents d ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that a manifest doesn't list, with documents and labels in these parts."""
    done = _docs(spark, sf_dir, "labels").where("quality = 1")
    return pending(_docs(spark, sf_dir).select("doc_id", "n_chars"), done, ["doc_id"])


@query("""SELECT source, count(*) FILTER (WHERE length(text) >= 100) AS docs, count(*) FILTER (WHERE length(text) < 100) AS skipped, count(*) FILTER (WHERE length(text) > 1000) AS truncated,
CAST(coalesce(sum(octet_length(encode(left(text, 1000)))) FILTER (WHERE length(text) >= 100), 0) AS BIGINT) AS tokens FROM documents WHERE text <> '' GROUP BY source""")
def per_file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dataset job says of its files, with sources as files."""
    docs = spread(_docs(spark, sf_dir).select("source", "text")).where(T.has_text("text"))
    return file_totals(encode_column(kept_text(docs, 100, 1000), BYTE_MODEL, ["source", "cut"]), "source")


@query("SELECT item_id, text AS decoded FROM benchmark")
def decode_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level encoding and its inverse."""
    return _docs(spark, sf_dir, "benchmark").select("item_id", T.byte_decode(T.byte_encode("text")).alias("decoded"))


@query(f"SELECT doc_id, array_to_string(list_concat([256], {_BYTES}, [257]), ' ') AS ids FROM documents")
def bos_eos_wrap_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of whole documents between a first and a last one."""
    return joined_column(_docs(spark, sf_dir), BYTE_MODEL, ["doc_id"], bos=256, eos=257)


#: A byte-level model with a few merges: all text has ids, of one or more bytes each.
BYTE_BPE_MODEL = Model("BPE", {t: i for i, t in enumerate([*BYTE_CHARS, *("".join(m) for m in MERGES)])}, MERGES)


@query("SELECT doc_id, text AS decoded FROM documents")
def decode_round_trip_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents to ids and back to text."""
    return round_trip_column(spread(_docs(spark, sf_dir).select("doc_id", "text")), BYTE_BPE_MODEL, ["doc_id"])


def _trained(spark: SparkSession, sf_dir: str, kind: TrainerKind) -> tuple[TrainConfig, Trained]:
    config = TrainConfig(trainer=kind)
    texts = counts.prepared(_docs(spark, sf_dir).select("text"), config.max_chars_per_doc)
    return config, learn(settled(counts.piece_counts(spread(texts), kind)), config)


def _vocabulary(spark: SparkSession, found: Trained) -> DataFrame:
    return spark.createDataFrame([(i, t, round(s, 8)) for i, (t, s) in enumerate(zip(found.tokens, found.scores, strict=True))], "id bigint, token string, score double")


@query()
def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merges that the trainer learns by default from documents. No SQL: each merge follows from the one before."""
    _, found = _trained(spark, sf_dir, TrainerKind.byte_bpe)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(found.merges)], "rank int, left string, right string")


@query()
def wordpiece_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary that the WordPiece trainer learns by default from documents."""
    return _vocabulary(spark, _trained(spark, sf_dir, TrainerKind.wordpiece)[1])


@query()
def unigram_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary and scores that the Unigram trainer learns by default from documents."""
    return _vocabulary(spark, _trained(spark, sf_dir, TrainerKind.unigram)[1])


@query("SELECT doc_id, text AS decoded FROM documents")
def bpe_train_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with a vocabulary that was learned from them by default, and decoded."""
    config, found = _trained(spark, sf_dir, TrainerKind.byte_bpe)
    model = Model("BPE", {t: i for i, t in enumerate(found.tokens)}, found.merges, unk_token=config.unk_token)
    return round_trip_column(spread(_docs(spark, sf_dir).select("doc_id", "text")), model, ["doc_id"])


@query(f"SELECT conv_id, turn, {encoded('text')} AS text FROM conversations")
def byte_encoded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "conversations").select("conv_id", "turn", T.byte_encode("text").alias("text"))
