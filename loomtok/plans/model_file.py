"""tokenizer.json, vocab.json and merges.txt."""

from __future__ import annotations

import json

from loomtok.operators.encode import Model
from loomtok.plans.config import TrainConfig, TrainerKind
from loomtok.sources import files

_KINDS = {"BPE": "BPE", "WordPiece": "WordPiece", "Unigram": "Unigram"}


def load(path: str, strict_unk: bool = False) -> Model:
    """The model of a file. Only model, added_tokens and pre_tokenizer are read.

    A Unigram model's ``unk_id`` counts only with ``strict_unk``; otherwise it has no unknown token unless it names one.
    """
    data = json.loads(files.read_bytes(path).decode("utf-8"))
    model = data["model"]
    kind = model.get("type") or ("Unigram" if isinstance(model.get("vocab"), list) else "BPE")
    if kind not in _KINDS:
        raise ValueError(f"model type {kind} isn't supported")
    entries = model.get("vocab") or {}
    scores = [(t, float(s)) for t, s in entries] if isinstance(entries, list) else []
    vocab = {t: i for i, (t, _) in enumerate(scores)} if scores else dict(entries) if isinstance(entries, dict) else {}
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges") or []]
    unk = model.get("unk_token")
    if unk is None and strict_unk and scores and model.get("unk_id") is not None:
        unk = scores[model["unk_id"]][0]
    splits = [data.get("pre_tokenizer") or {}]
    splits += splits[0].get("pretokenizers", [])
    words = any(p.get("type") in ("Whitespace", "WhitespaceSplit") for p in splits)
    prefix = model.get("continuing_subword_prefix")
    out = Model(kind, vocab, [m for m in merges if len(m) == 2], scores, {t["content"]: t["id"] for t in data.get("added_tokens") or []}, unk, "##" if prefix is None else prefix, not words)
    if not out.vocab and not out.added:
        raise ValueError("the vocabulary is empty")
    return out


def as_json(config: TrainConfig, tokens: list[str], merges: list[tuple[str, str]], scores: list[float]) -> dict:
    specials = config.specials()
    ids = {t: i for i, t in enumerate(tokens)}
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    byte_level = config.trainer is TrainerKind.byte_bpe
    named = config.special_tokens if byte_level else [t for t in tokens if t in specials]
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True} if byte_level else {"type": "WhitespaceSplit"}
    decoder: dict | None = split if byte_level else None
    unk = config.unk_token
    if config.trainer is TrainerKind.wordpiece:
        prefix = config.wordpiece_continuing_prefix
        decoder = {"type": "WordPiece", "prefix": prefix, "cleanup": True}
        model: dict = {"type": "WordPiece", "unk_token": unk, "continuing_subword_prefix": prefix, "max_input_chars_per_word": 100, "vocab": ids}
    elif config.trainer is TrainerKind.unigram:
        model = {"type": "Unigram", "unk_id": ids.get(unk, 0), "byte_fallback": False, "vocab": [[t, float(f"{s:.8g}")] for t, s in zip(tokens, scores, strict=True)]}
    else:
        pairs: list = [" ".join(m) for m in merges] if byte_level else [list(m) for m in merges]
        model = {"type": "BPE", "dropout": None, "unk_token": unk, "continuing_subword_prefix": "", "end_of_word_suffix": "", "fuse_unk": False, "vocab": ids, "merges": pairs}
    return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [{"id": ids[t], "content": t} | flags for t in named], "normalizer": None, "pre_tokenizer": split, "post_processor": None, "decoder": decoder, "model": model}


def save(config: TrainConfig, tokens: list[str], merges: list[tuple[str, str]], scores: list[float]) -> None:
    compact = {"ensure_ascii": False, "separators": (",", ":")}
    files.write_text(config.output_json, json.dumps(as_json(config, tokens, merges, scores), **compact))
    if config.write_vocab:
        files.write_text(config.output_vocab, json.dumps({t: i for i, t in enumerate(tokens)}, **compact))
    if config.write_merges and config.trainer in (TrainerKind.byte_bpe, TrainerKind.bpe):
        files.write_text(config.output_merges, "\n".join(["#version: 0.2", *(" ".join(m) for m in merges)]) + "\n")
