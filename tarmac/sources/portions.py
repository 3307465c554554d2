"""Portions of a task's results that outlive the task.

A task that calls an external service stores what it learned in small Parquet files while it runs. When it is repeated, after a lost executor or
in a later run of the same work, it reads them first and asks only for the rest.
"""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

# How Spark's names of shared stores are called outside of Spark.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "file": "file", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


class UnknownStore(ValueError):
    pass


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a shared folder that tasks read and write themselves; ``UnknownStore`` if they cannot."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    scheme, rest = folder.split(":", 1)
    if scheme not in _SCHEMES:
        raise UnknownStore(f"tasks cannot write to {scheme}: use one of {sorted(_SCHEMES)} or a mounted shared folder")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{rest}")


class Portions:
    """The stored portions of one part of some work under ``folder``, which all executors share."""

    def __init__(self, folder: str, part: int):
        self.store, path = open_store(folder)
        self.path = f"{path.rstrip('/')}/part-{part:06d}"
        self.made = False

    @staticmethod
    def check(folder: str) -> None:
        """Refuse a folder that tasks could not write to, before any work starts."""
        open_store(folder)

    def read(self) -> pd.DataFrame | None:
        """Everything stored for this part, None if there is nothing."""
        found = [file.path for file in self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True)) if file.path.endswith(".parquet")]
        tables = [pq.read_table(path, filesystem=self.store, partitioning=None) for path in sorted(found)]
        return pa.concat_tables(tables).to_pandas() if tables else None

    def write(self, rows: pd.DataFrame, schema: pa.Schema) -> None:
        """Store one portion; a file is complete before it gets the name that ``read`` looks for."""
        if not self.made:
            self.store.create_dir(self.path, recursive=True)
            self.made = True
        name = f"{self.path}/{uuid.uuid4().hex}"
        pq.write_table(pa.Table.from_pandas(rows, schema=schema, preserve_index=False), f"{name}.part", filesystem=self.store)
        self.store.move(f"{name}.part", f"{name}.parquet")
