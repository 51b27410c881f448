"""Files by path or URI: local ones, and those of the file systems that Arrow knows (hdfs, s3, gs, abfs and others)."""

from __future__ import annotations

import os
import re
import urllib.parse
from typing import IO

from pyarrow import fs

#: Schemes that Spark has for what Arrow calls otherwise.
_ALIASES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "wasbs": "abfss"}


def scheme(name: str) -> str:
    """The scheme of a URI; none of a path, nor of a drive's letter."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]+)://", name)
    return m[1].lower() if m else ""


def file_url(url: str) -> str:
    """The path in a file URL."""
    path = urllib.parse.unquote_plus(url[len("file://") :])
    path = path[len("localhost") :] if path.startswith("localhost/") else path
    return path[1:] if re.match(r"/[A-Za-z]:[/\\]", path) else path


def absolute(name: str) -> str:
    """A local name, or file URL, as an absolute path; another URI as it is."""
    kind = scheme(name)
    return name.rstrip("/") if kind not in ("", "file") else os.path.abspath(file_url(name) if kind else name)


def at(name: str) -> tuple[fs.FileSystem, str]:
    """The file system of a name, and the path in it."""
    kind = scheme(name)
    if kind in ("", "file"):
        return fs.LocalFileSystem(), absolute(name)
    return fs.FileSystem.from_uri(_ALIASES.get(kind, kind) + name[len(kind) :])


def join(folder: str, *parts: str) -> str:
    return "/".join([folder.rstrip("/"), *parts])


def info(name: str) -> fs.FileInfo:
    system, path = at(name)
    return system.get_file_info(path)


def is_file(name: str) -> bool:
    return info(name).type == fs.FileType.File


def exists(name: str) -> bool:
    return info(name).type != fs.FileType.NotFound


def listed(folder: str, deep: bool = False) -> list[fs.FileInfo]:
    """The files of a folder, and with ``deep`` of those in it; none if it isn't there."""
    system, path = at(folder)
    return [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=deep)) if f.type == fs.FileType.File]


def make_folder(name: str) -> None:
    system, path = at(name)
    system.create_dir(path, recursive=True)


def remove(name: str) -> None:
    """Deletes a file or a folder, if it is there."""
    system, path = at(name)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)


def read_bytes(name: str) -> bytes:
    system, path = at(name)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def read_text(name: str) -> str | None:
    """The text of a file, none if it isn't there."""
    return read_bytes(name).decode("utf-8") if is_file(name) else None


def opened(name: str) -> IO[bytes]:
    system, path = at(name)
    return system.open_input_stream(path, compression=None)


def created(name: str) -> IO[bytes]:
    """A file to write, on its way to be renamed by :func:`renamed`."""
    system, path = at(name)
    return system.open_output_stream(path, compression=None)


def renamed(old: str, new: str) -> None:
    system, path = at(old)
    system.move(path, at(new)[1])


def write_text(name: str, text: str) -> None:
    """Writes aside and renames, so that no reader sees half a file."""
    name = absolute(name)
    make_folder(name.rpartition("/")[0])
    with created(name + ".part") as f:
        f.write(text.encode())
    renamed(name + ".part", name)
