"""Arrow tables and lines as files in the cluster's shared folder, written by tasks and read by tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import pyarrow as pa
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


def write_file(uri: str, table: pa.Table) -> None:
    """Write under another name and rename, so a second attempt of a task never leaves half a file."""
    store, path = _place(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    store.move(part, path)


def read_file(uri: str) -> pa.Table:
    """The table of a file; mapped, not read, where the store has local paths."""
    store, path = _place(uri)
    if isinstance(store, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(path)).read_all()
    with store.open_input_file(path) as source:
        return pa.ipc.open_file(source).read_all()


def emptied(spark: SparkSession, path: str) -> str:
    """Full name of a folder, made empty; Spark's own settings say which store a path without one is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(place, True)
    store.mkdirs(place)
    return store.makeQualified(place).toString()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of files that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_lines(uri: str, lines: Iterable[str]) -> None:
    """A text file; until it is whole its name begins with ``_``, which readers pass over."""
    store, path = _place(uri)
    folder = os.path.dirname(path)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for line in lines:
            out.write(f"{line}\n".encode())
    store.move(part, path)
