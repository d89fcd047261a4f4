"""Flat files in the folder that all executors share, written and read by tasks through the store's own file system.

A task writes to a name of its own, so a retried or speculative attempt never touches another's file; only names that
a finished task has reported are read.
"""

from __future__ import annotations

import uuid

from pyspark import TaskContext


def opened(uri: str):
    """The file system of a URI or absolute path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def part_number() -> int:
    return TaskContext.get().partitionId()


def own_name(folder: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/{kind}-{part_number():06d}-{uuid.uuid4().hex}"


def made(folder: str) -> str:
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    return folder


def read_range(uri: str, start: int, size: int) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return f.read_at(size, start)
