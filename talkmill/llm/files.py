"""Arrays as files in the cluster's shared folder, mapped into memory by the tasks that read them."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs

from pyspark.sql import SparkSession

from talkmill.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Name of a new folder below the shared one; files appear in it when tasks write them."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_array(uri: str, values: np.ndarray) -> None:
    """Write under another name and rename, so a second attempt of a task never leaves half a file."""
    store, path = _place(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    store.move(part, path)


@lru_cache(4096)
def map_array(uri: str, kind) -> np.ndarray:
    """Read-only memory map of an array file.

    A file in a store without local paths is copied to an unnamed temporary file first; it goes
    with the process, and serves all tasks that the process runs.
    """
    store, path = _place(uri)
    if store.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with tempfile.TemporaryFile() as copy:
        with store.open_input_stream(path) as source:
            while piece := source.read(1 << 22):
                copy.write(piece)
        copy.flush()
        return np.memmap(copy, kind, "r")
