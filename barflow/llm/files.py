"""Binary files in a shared folder, written and read by tasks: a final name appears only when the file is whole."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO

import numpy as np
import pyarrow.fs as pafs


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def local_path(uri: str) -> str | None:
    """The path of a file on a mounted folder, else None."""
    fs, path = _filesystem(uri)
    return path if isinstance(fs, pafs.LocalFileSystem) else None


@contextmanager
def writing(folder: str, name: str) -> Iterator[IO[bytes]]:
    """Write ``folder/name`` by way of a name of this attempt alone; attempts of a task that runs twice don't mix."""
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        yield out
    fs.move(draft, f"{path}/{name}")


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped on a mounted folder, else read."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    fs, there = _filesystem(uri)
    with fs.open_input_file(there) as f:
        return np.frombuffer(f.read(), dtype)


@contextmanager
def reading(uri: str) -> Iterator[IO[bytes]]:
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        yield f
