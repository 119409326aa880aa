"""Files that tasks write and read themselves, in the shared folder, through pyarrow's file systems. A task names its
files anew on each attempt and hands their names on in its rows, so retried and speculative tasks can't mix."""

from __future__ import annotations

import uuid
from functools import lru_cache

import pyarrow.fs as pafs


def _at(uri: str):
    return pafs.FileSystem.from_uri(uri)


def fresh(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """An output stream; the folder is made where it is missing."""
    fs, path = _at(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


@lru_cache(maxsize=4)
def opened(uri: str):
    """A random access file; a worker keeps a few open. Files are written once and never change."""
    fs, path = _at(uri)
    return fs.open_input_file(path)


def span(uri: str, offset: int, length: int) -> bytes:
    """A range read."""
    return opened(uri).read_at(length, offset)


def size_of(uri: str) -> int:
    return opened(uri).size()
