"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def atomic_writer(folder: str, name: str) -> Iterator[BinaryIO]:
    """Write ``name`` under another name and move it there when whole, so a task that is lost or run twice leaves one good file."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, f"{path}/{name}")


def open_file(folder: str, name: str):
    store, path = open_folder(folder)
    return store.open_input_file(f"{path}/{name}")
