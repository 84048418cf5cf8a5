"""Binary files that tasks leave in the shared folder for later tasks.

A file has a name of its own for each attempt, and only rows of finished tasks name it, so a
lost executor leaves nothing that is read. Where the folder is mounted, files are
memory-mapped: all workers of a machine share their pages. Elsewhere they are read whole.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from tabshift.session import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder, as an address that pyarrow opens."""
    path = shared_folder(spark, name)
    return path if "://" in path else f"file://{path}"


def put(folder: str, parts: list) -> str:
    """Writes the buffers one after the other; the file's address."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    name = f"part-{uuid.uuid4().hex}.bin"
    with system.open_output_stream(f"{root}/{name}", compression=None) as out:
        for part in parts:
            out.write(part)
    return f"{folder.rstrip('/')}/{name}"


def view(path: str) -> pa.Buffer:
    system, place = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(place) as mapped:
            return mapped.read_buffer()
    with system.open_input_file(place) as raw:
        return raw.read_buffer()
