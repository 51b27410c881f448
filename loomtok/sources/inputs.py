"""Inputs by name: files, globs, lists, URLs of files, HTTP and shared file systems, resolved on the driver to distinct paths."""

from __future__ import annotations

import hashlib
import os
import re
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyarrow import fs

from loomtok.sources import files
from loomtok.sources.shared import ensure_folder

SUFFIXES = (".json.gz", ".jsonl.gz", ".json.xz", ".jsonl.xz", ".json", ".jsonl", ".ndjson", ".parquet")


@dataclass(frozen=True)
class InputSource:
    source: str
    local_path: str
    normalized_id: str
    file_size: int
    file_mtime: int
    remote: bool = False


def detect(path: str) -> str:
    """The format by suffix; an unknown one is read as JSON lines."""
    for end, kind in ((".jsonl.gz", "jsonl_gz"), (".json.gz", "json_gz"), (".jsonl.xz", "jsonl_xz"), (".json.xz", "json_xz"), (".ndjson.gz", "jsonl_gz"), (".ndjson.xz", "jsonl_xz"), (".jsonl", "jsonl"), (".ndjson", "jsonl"), (".json", "json"), (".parquet", "parquet")):
        if path.endswith(end):
            return kind
    return "unknown"


def glob(pattern: str) -> list[str]:
    """Regular files that match: ``*`` is any text, slashes included, ``?`` one character. Sorted."""
    wild = re.search(r"[*?]", pattern)
    if not wild:
        return [pattern] if files.exists(pattern) else []
    if files.scheme(pattern) not in ("", "file"):
        base, (_, root) = pattern[: wild.start()].rpartition("/")[0], files.at(pattern[: wild.start()].rpartition("/")[0])
        match = re.compile("".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern), re.S).fullmatch
        found = [base + f.path[len(root) :] for f in files.listed(base, deep=True)]
        return sorted(p for p in found if match(p))
    if files.scheme(pattern):
        pattern = files.file_url(pattern)
        wild = re.search(r"[*?]", pattern)
    base = pattern[: wild.start()].rpartition("/")[0] or ("/" if pattern.startswith("/") else ".")
    match = re.compile("".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern), re.S).fullmatch
    found = [os.path.join(folder, name) for folder, _, names in os.walk(base) for name in names]
    if base == ".":
        found = [os.path.relpath(p) for p in found]
    return sorted(p for p in found if match(p) and os.path.isfile(p))


def expand(pattern: str) -> list[str]:
    """:func:`glob`, and if nothing matches, with the known suffixes in place of the pattern's or after it."""
    if found := glob(pattern):
        return found
    suffix = next((s for s in SUFFIXES if pattern.endswith(s)), "")
    stem = pattern[: len(pattern) - len(suffix)] if suffix else pattern
    return sorted({p for s in SUFFIXES if s != suffix for p in glob(stem + s)})


def is_url(name: str) -> bool:
    return name.startswith(("http://", "https://"))


def download(url: str, cache_dir: str) -> str:
    """A file of the cache, a path or URI, for ``url``; one that is there already is taken as it is."""
    path = urllib.parse.urlsplit(url).path
    suffix = next((s for s in SUFFIXES if path.endswith(s)), os.path.splitext(path)[1])
    target = files.join(cache_dir, f"remote_{hashlib.sha256(url.encode()).hexdigest()[:16]}{suffix}")
    if not files.exists(target):
        files.make_folder(cache_dir)
        with urllib.request.urlopen(url, timeout=300) as response, files.created(target + ".part") as out:
            while block := response.read(1 << 20):
                out.write(block)
        files.renamed(target + ".part", target)
    return target


def cache_for(spark) -> str:
    """Where downloads go so that executors reach them: a folder here for a local master, else one in the shared folder."""
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    return "cache/inputs" if local else files.join(ensure_folder(spark), "inputs")


def list_entries(ref: str, cache_dir: str) -> list[str]:
    """Entries of a list file, one a line without comments, relative ones taken from the list's own place."""
    path = download(ref, cache_dir) if is_url(ref) else files.absolute(ref)
    base = (ref if is_url(ref) else path).rpartition("/")[0] + "/"
    out = []
    for line in files.read_bytes(path).decode("utf-8").split("\n"):
        entry = line.rstrip("\r").strip()
        if entry and not entry.startswith("#"):
            absolute = "://" in entry or entry.startswith(("/", "\\")) or re.match(r"[A-Za-z]:[/\\]", entry)
            out.append(entry if absolute else base + entry)
    return out


def resolve(entries: list[str] = (), data_glob: str = "", data_list: str = "", cache_dir: str = "cache/inputs") -> list[InputSource]:
    """Distinct sources in order. Entries come before a list, and that before a glob. What is missing is an error.

    Names with a scheme other than http and https are on a shared file system that both Arrow and Spark reach.
    """
    names: list[str] = []
    if entries:
        for e in entries:
            names += expand(e) if re.search(r"[*?]", e) and not is_url(e) else [e]
    elif data_list:
        for e in list_entries(data_list, cache_dir):
            names += [e] if "://" in e else expand(e) or [e]
    elif data_glob:
        names = expand(data_glob)
    if not names:
        raise FileNotFoundError("no input files")
    out: dict[str, InputSource] = {}
    for name in names:
        remote = is_url(name)
        local = files.scheme(name) in ("", "file")
        path = download(name, cache_dir) if remote else name if not local else files.file_url(name) if files.scheme(name) else name
        there = files.info(path)
        if there.type != fs.FileType.File:
            raise FileNotFoundError(f"input not found: {name}")
        key = name if remote else files.absolute(path).replace("\\", "/")
        out.setdefault(key, InputSource(name, path, key, there.size, int(there.mtime.timestamp()) if there.mtime else 0, remote))
    return list(out.values())
