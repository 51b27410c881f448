"""Command line: ``python -m loomtok.cli train ...`` and ``python -m loomtok.cli tokenize ...``."""

from __future__ import annotations

import argparse
import sys

from loomtok.plans.config import TokenizeArgs, TrainConfig, parse, read_env, split_csv, with_env
from loomtok.plans.dataset import tokenize
from loomtok.plans.training import train

#: Flags whose field has another name.
TRAIN_FLAGS = {"env": "env_path", "data": "data_glob", "progress-interval": "progress_interval_ms", "max-chars": "max_chars_per_doc", "unigram-iters": "unigram_em_iters", "unigram-seed-mult": "unigram_seed_multiplier", "wordpiece-prefix": "wordpiece_continuing_prefix", "output": "output_json", "vocab": "output_vocab", "merges": "output_merges"}
TRAIN_FLAGS |= {n: n.replace("-", "_") for n in "data-list text-field trainer vocab-size min-freq min-pair-freq records-per-chunk chunk-docs chunk-files top-k chunk-dir threads queue-capacity max-memory-mb pair-max-entries max-token-length unigram-prune-ratio special-tokens unk-token backend".split()}
TOKENIZE_FLAGS = {"tokenizer": "tokenizer_path"} | {n: n.replace("-", "_") for n in "env-file data-glob data-list text-field out-dir max-tokens-per-shard encode-batch-size min-chars max-chars max-docs eos-token bos-token threads cache-max-entries max-memory-mb progress-every".split()}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomtok")
    jobs = top.add_subparsers(dest="job", required=True)
    for job, flags, switches in (("train", TRAIN_FLAGS, ["resume", "prescan"]), ("tokenize", TOKENIZE_FLAGS, ["resume", "prescan"])):
        p = jobs.add_parser(job, argument_default=argparse.SUPPRESS)
        p.add_argument("inputs", nargs="*", default=[])
        for flag, name in flags.items():
            p.add_argument(f"--{flag}", dest=name)
        for s in switches:
            p.add_argument(f"--{s}", dest={"prescan": "prescan_records"}.get(s, s), action=argparse.BooleanOptionalAction)
        if job == "train":
            p.add_argument("--no-vocab", dest="write_vocab", action="store_false")
            p.add_argument("--no-merges", dest="write_merges", action="store_false")
    return top


def main(argv: list[str] | None = None) -> int:
    given = vars(_parser().parse_args(argv))
    job, files = given.pop("job"), given.pop("inputs")
    config: TrainConfig | TokenizeArgs
    config = with_env(TrainConfig(), read_env(given.get("env_path", ".env"))) if job == "train" else TokenizeArgs()
    for name, value in given.items():
        like = getattr(config, name)
        setattr(config, name, split_csv(value, trim=False) if isinstance(like, list) else parse(value, like) if isinstance(value, str) else value)
    if job == "train":
        train(config.clamp(), files)
    else:
        tokenize(config, files)
    return 0


if __name__ == "__main__":
    sys.exit(main())
