"""Arrays in the shared folder that tasks write and workers map into memory.

A file is written under a name of its own and then renamed, so a repeated or speculative
task leaves the same file and no reader sees half of one. Where the shared folder is
mounted, workers map the file itself; on an object store they fetch it once to a
temporary file of their own, which is only a cache.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np


def mounted(uri: str) -> str | None:
    """The path, if ``uri`` is a file that every machine sees under it."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_bytes(uri: str, content) -> None:
    path = mounted(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with open(draft, "wb") as file:
            file.write(content)
        os.replace(draft, path)
        return
    from pyarrow.fs import FileSystem

    store, path = FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as file:
        file.write(content)
    store.move(draft, path)


def write_array(uri: str, values: np.ndarray) -> None:
    write_bytes(uri, np.ascontiguousarray(values).data if len(values) else b"")


def exists(uri: str) -> bool:
    path = mounted(uri)
    if path is not None:
        return os.path.exists(path)
    from pyarrow.fs import FileSystem, FileType

    store, path = FileSystem.from_uri(uri)
    return store.get_file_info(path).type == FileType.File


@lru_cache(maxsize=4096)
def _fetched(uri: str) -> str:
    from pyarrow.fs import FileSystem

    store, path = FileSystem.from_uri(uri)
    with store.open_input_stream(path) as source, tempfile.NamedTemporaryFile(delete=False) as target:
        while block := source.read(1 << 22):
            target.write(block)
    return target.name


@lru_cache(maxsize=512)
def map_array(uri: str, dtype: str) -> np.ndarray:
    """The file's values, mapped and not read. Kept open for the next call."""
    path = mounted(uri) or _fetched(uri)
    if not os.path.getsize(path):
        return np.zeros(0, dtype)
    return np.memmap(path, dtype, mode="r")
