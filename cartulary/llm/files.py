"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@contextmanager
def written_whole(store: fs.FileSystem, path: str) -> Iterator:
    """A stream to a file that appears under its name only when it is complete: a task that is run again replaces it by the same."""
    context = TaskContext.get()
    held = f"{path}.{context.taskAttemptId() if context else 0}.tmp"
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(held) as out:
        yield out
    store.move(held, path)


def part_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


class Reader:
    """Range reads from one open file at a time."""

    def __init__(self, folder: str):
        self.store, self.root = open_store(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.store.open_input_file(f"{self.root}/{name}")
        self.file.seek(offset)
        return self.file.read(length)

    def size(self, name: str) -> int:
        self.read(name, 0, 0)
        return self.file.size()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name = self.file = None


Batches = Callable[[Iterator], Iterator]
