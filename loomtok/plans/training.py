"""Training: sources to exact counts to a vocabulary to files."""

from __future__ import annotations

import copy
import hashlib
import json
import warnings
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtok.functions import text as T
from loomtok.functions.chars import BYTE_CHARS
from loomtok.operators import bpe, counts, unigram, wordpiece
from loomtok.plans import model_file
from loomtok.plans.config import TrainConfig, TrainerKind
from loomtok.plans.progress import progress
from loomtok.sources import files, inputs, readers


@dataclass
class Trained:
    """A vocabulary, and from :func:`train` how many ``records`` were counted, how many of them ``truncated``, and their ``chars``."""

    tokens: list[str]
    merges: list[tuple[str, str]]
    scores: list[float]
    records: dict[str, int] = field(default_factory=dict)


def _held(pieces: DataFrame, config: TrainConfig) -> pa.Table | None:
    """The pieces on the driver, in one job, or none if there are more than ``driver_pieces`` or the job is to stay distributed."""
    if config.backend == "distributed":
        return None
    table = (pieces if config.backend == "driver" else pieces.limit(config.driver_pieces + 1)).toArrow()
    if config.backend == "auto" and table.num_rows > config.driver_pieces:
        return None
    return table


def learn(pieces: DataFrame, config: TrainConfig) -> Trained:
    """The vocabulary of counted pieces (piece, freq). Byte-level BPE on the driver reads them once; else they should be cached or written.

    The driver learns from the reduced table as long as that has at most ``driver_pieces`` rows, or rounds of
    DataFrame operations do; the result is the same.
    """
    if config.pair_max_entries > 0:
        warnings.warn("pair_max_entries has no effect: all pairs are counted", stacklevel=2)
    specials = config.specials()
    if config.top_k > 0:
        pieces = counts.top_pieces(pieces, config.top_k)
    kept = counts.frequent(pieces, config.min_freq)
    if config.trainer is TrainerKind.unigram:
        if pieces.isEmpty():
            raise ValueError("nothing was counted")
        room = max(0, config.vocab_size - len(specials))
        found = unigram.learn(pieces, room, config.min_freq, config.max_token_length, config.unigram_em_iters, config.unigram_seed_multiplier, config.unigram_prune_ratio)
        model = [(t, s) for t, s in found if t not in specials]
        return Trained([*specials, *(t for t, _ in model)], [], [-100.0] * len(specials) + [s for _, s in model])
    held = _held(kept, config)
    if not (held and held.num_rows) and pieces.isEmpty():
        raise ValueError("nothing was counted")
    if config.trainer is TrainerKind.wordpiece:
        prefix = config.wordpiece_continuing_prefix
        symbols = T.continued(T.code_points("piece"), prefix)
        base = wordpiece.base(held, prefix) if held is not None else sorted(r[0] for r in kept.select(F.explode(symbols)).distinct().collect())
        target = config.target(len(base))
        if held is not None:
            made = wordpiece.learn_on_driver(held, base, target, config.min_pair_freq, prefix)
        else:
            made = wordpiece.learn_distributed(kept.select(symbols.alias("syms"), "freq"), base, target, config.min_pair_freq, prefix)
        tokens, merges = [*base, *made], []
    else:
        symbols = T.code_points("piece")
        base = list(BYTE_CHARS) if config.trainer is TrainerKind.byte_bpe else sorted(r[0] for r in counts.alphabet(pieces).collect())
        target = config.target(len(base))
        if held is not None:
            merges = bpe.learn_on_driver(held, set(base), target, config.min_pair_freq)
        else:
            merges = bpe.learn_distributed(kept.select(symbols.alias("syms"), "freq"), set(base), target, config.min_pair_freq)
        tokens = [*base, *("".join(m) for m in merges)]
    tokens = list(dict.fromkeys([*specials, *tokens]))
    return Trained(tokens, merges, [-1.0] * len(tokens))


def _count_key(config: TrainConfig, sources: list[inputs.InputSource]) -> str:
    what = [config.trainer is TrainerKind.byte_bpe, config.text_field, config.max_chars_per_doc, sorted((s.normalized_id, s.file_size, s.file_mtime) for s in sources)]
    return hashlib.sha256(json.dumps(what).encode()).hexdigest()[:24]


def train(config: TrainConfig, inputs_: list[str] | None = None, spark: SparkSession | None = None) -> Trained:
    """Learns a tokenizer from files and writes it. With ``resume`` the counts are kept in ``chunk_dir`` as Parquet, by a
    hash of all that they depend on, and taken from there by a later run; it may be a URI. ``prescan_records`` writes
    progress to stderr; records are counted as they are read, without a scan of their own."""
    config = copy.copy(config)
    if inputs_:
        config.input_entries = list(inputs_)
    spark = spark or SparkSession.builder.getOrCreate()
    sources = inputs.resolve(config.input_entries, config.data_glob, config.data_list, inputs.cache_for(spark))
    place = files.join(files.absolute(config.chunk_dir), f"counts-{_count_key(config, sources)}")
    with progress(spark, "train", config.progress_interval_ms if config.prescan_records else 0):
        if not (config.resume and files.exists(files.join(place, "_SUCCESS"))):
            texts, seen = readers.observed(readers.read(spark, sources, config.text_field), config.max_chars_per_doc)
            counts.piece_counts(counts.prepared(texts, config.max_chars_per_doc), config.trainer).write.mode("overwrite").parquet(place)
            files.write_text(files.join(place, "_records.json"), json.dumps(seen.get))
        out = learn(spark.read.parquet(place), config)
    out.records = json.loads(files.read_text(files.join(place, "_records.json")) or "{}")
    model_file.save(config, out.tokens, out.merges, out.scores)
    return out
