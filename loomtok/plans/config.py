"""Settings of training and of dataset jobs, from Python, a .env file or the command line."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path


class TrainerKind(Enum):
    byte_bpe = 0
    bpe = 1
    wordpiece = 2
    unigram = 3


@dataclass
class TrainConfig:
    """How a vocabulary is learned and where it goes.

    Counts are exact and Spark plans memory, threads and queues itself, so ``chunk_files``, ``chunk_docs``, ``threads``,
    ``max_memory_mb``, ``pair_max_entries``, ``records_per_chunk``, ``queue_capacity`` and ``progress_interval_ms`` are
    taken and have no effect. ``top_k`` bounds the pieces that learning uses, by count, ties in binary order.
    ``backend`` is "driver", "distributed", or "auto": the driver up to ``driver_pieces`` distinct pieces.
    """

    env_path: str = ".env"
    data_glob: str = ""
    data_list: str = ""
    input_entries: list[str] = field(default_factory=list)
    text_field: str = "text"
    output_json: str = "tokenizer.json"
    output_vocab: str = "vocab.json"
    output_merges: str = "merges.txt"
    unk_token: str = "<|endoftext|>"
    special_tokens: list[str] = field(default_factory=lambda: ["<|endoftext|>"])
    trainer: TrainerKind = TrainerKind.byte_bpe
    vocab_size: int = 50_000
    min_freq: int = 2
    min_pair_freq: int = 2
    chunk_files: int = 1
    chunk_docs: int = 20_000
    top_k: int = 0
    max_chars_per_doc: int = 20_000
    threads: int = 0
    progress_interval_ms: int = 1000
    max_memory_mb: int = 0
    pair_max_entries: int = 0
    records_per_chunk: int = 5000
    queue_capacity: int = 0
    max_token_length: int = 16
    unigram_em_iters: int = 4
    unigram_seed_multiplier: int = 4
    unigram_prune_ratio: float = 0.75
    wordpiece_continuing_prefix: str = "##"
    prescan_records: bool = False
    chunk_dir: str = "artifacts/bpe/chunks"
    resume: bool = True
    write_vocab: bool = True
    write_merges: bool = True
    backend: str = "auto"
    driver_pieces: int = 16_000_000

    def specials(self) -> list[str]:
        """The special tokens, each once, with the unknown token at the end if it isn't among them."""
        return list(dict.fromkeys([*self.special_tokens, self.unk_token]))

    def target(self, base: int) -> int:
        """Symbols to learn besides the specials, never fewer than the ``base`` alphabet."""
        room = self.vocab_size - len(self.specials())
        return max(base, room) if room > 0 else base

    def clamp(self) -> TrainConfig:
        """Bounds that the command line keeps: counts at least 1, the prune ratio in (0, 1]."""
        for name in ("records_per_chunk", "chunk_docs", "unigram_em_iters", "unigram_seed_multiplier"):
            setattr(self, name, max(1, getattr(self, name)))
        if not 0 < self.unigram_prune_ratio <= 1:
            self.unigram_prune_ratio = 0.75
        return self


@dataclass
class TokenizeArgs:
    """A dataset job. ``threads``, ``encode_batch_size``, ``max_memory_mb`` and ``progress_every`` have no effect; ``max_docs`` must be 0."""

    env_file: str = ".env"
    data_glob: str = ""
    data_list: str = ""
    input_entries: list[str] = field(default_factory=list)
    text_field: str = "text"
    tokenizer_path: str = "tokenizer.json"
    out_dir: str = "data/tokens"
    max_tokens_per_shard: int = 50_000_000
    encode_batch_size: int = 256
    min_chars: int = 1
    max_chars: int = 20_000
    max_docs: int = 0
    eos_token: str = "<|endoftext|>"
    bos_token: str = ""
    progress_every: int = 10_000
    threads: int = 0
    cache_max_entries: int = 50_000
    max_memory_mb: int = 0
    prescan_records: bool = False
    resume: bool = True


def split_csv(text: str, trim: bool = True) -> list[str]:
    parts = [p.strip() if trim else p for p in text.split(",")]
    return [p for p in parts if p]


def read_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, a byte-order mark and one pair of quotes are dropped. A missing file is empty."""
    try:
        text = Path(path).read_text("utf-8-sig", "replace")
    except OSError:
        return {}
    out = {}
    for line in text.split("\n"):
        key, sep, value = (x.strip() for x in line.strip().partition("="))
        if not sep or key.startswith("#"):
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key] = value
    return out


#: Environment keys of other names than the field's; where two set one field, the later one here wins.
_KEYS = [("DATA_PATH", "data_glob"), ("DATA_GLOB", "data_glob"), ("DATA_LIST", "data_list"), ("DATA_URL_LIST", "data_list"), ("TRAINER", "trainer"), ("TRAINER_KIND", "trainer")]
_KEYS += [("PROGRESS_INTERVAL", "progress_interval_ms"), ("PROGRESS_INTERVAL_MS", "progress_interval_ms"), ("PRESCAN_RECORDS", "prescan_records"), ("PRESCAN", "prescan_records")]
_KEYS += [
    (name.upper(), name)
    for name in "text_field vocab_size min_freq min_pair_freq chunk_files chunk_docs records_per_chunk queue_capacity top_k max_chars_per_doc max_token_length threads max_memory_mb pair_max_entries output_json output_vocab output_merges unk_token chunk_dir resume wordpiece_continuing_prefix unigram_em_iters unigram_seed_multiplier unigram_prune_ratio special_tokens".split()
]


def parse(value: str, like: object) -> object:
    """``value`` as the type of ``like``; ``like`` itself where it can't be read."""
    if isinstance(like, bool):
        return {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}.get(value.lower(), like)
    if isinstance(like, TrainerKind):
        return TrainerKind.__members__.get(value.lower().replace("-", "_"), like)
    if isinstance(like, list):
        return split_csv(value) or like
    if isinstance(like, (int, float)):
        try:
            return type(like)(value)
        except ValueError:
            return like
    return value


def with_env(config: TrainConfig, env: dict[str, str]) -> TrainConfig:
    for key, name in _KEYS:
        if key in env:
            setattr(config, name, parse(env[key], getattr(config, name)))
    return config


def data_from_env(args: TokenizeArgs) -> TokenizeArgs:
    """Only where the data are, and only if the arguments don't say."""
    env = read_env(args.env_file)
    if not (args.input_entries or args.data_glob or args.data_list):
        args.data_glob = env.get("DATA_PATH", "")
        args.data_list = env.get("DATA_URL_LIST", env.get("DATA_LIST", ""))
    return args
