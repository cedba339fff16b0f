"""Files in the shared folder, opened from tasks by any path that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; Spark writes local ones as file:/x, file:///x or /x."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = open_folder(uri)
    store.create_dir(path, recursive=True)


def attempt_name(number: int, suffix: str) -> str:
    """A file name that no other attempt of any task uses; only files named in a manifest count."""
    task = TaskContext.get()
    return f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}{suffix}"
