"""A bucket's files: listing, ranged reads, atomic writes and deletes, on any file system that pyarrow opens by URI or path.

Works alike on the driver and in tasks. A file appears whole or not at all: it is written beside its place under a
name that no listing takes, then moved there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session, whose one machine shares everything, may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/pagetide-checkpoints")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/pagetide-{uuid.uuid4().hex}"


class Store:
    def __init__(self, root: str):
        short = root.startswith("file:/") and not root.startswith("file://")  # as Spark writes local paths
        self.root = ("file://" + root[5:] if short else root).rstrip("/")

    def _open(self, name: str = "") -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(f"{self.root}/{name}" if name else self.root)

    def get(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        """A file or a range of it; FileNotFoundError if there is none. A range beyond the end is cut."""
        fs, path = self._open(name)
        with fs.open_input_file(path) as f:
            end = f.size() if size is None else min(f.size(), offset + size)
            return f.read_at(max(0, end - offset), offset)

    def size(self, name: str) -> int:
        fs, path = self._open(name)
        with fs.open_input_file(path) as f:
            return f.size()

    @contextmanager
    def writing(self, name: str) -> Iterator[pa.NativeFile]:
        """A stream to a file that takes its place when the block ends, and leaves nothing if it fails."""
        fs, path = self._open(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            with fs.open_output_stream(beside) as f:
                yield f
            fs.move(beside, path)
        except BaseException:
            if fs.get_file_info(beside).type != pafs.FileType.NotFound:
                fs.delete_file(beside)
            raise

    def put(self, name: str, data: bytes) -> None:
        with self.writing(name) as f:
            f.write(data)

    def exists(self, name: str) -> bool:
        fs, path = self._open(name)
        return fs.get_file_info(path).type != pafs.FileType.NotFound

    def list(self, folder: str = "") -> list[tuple[str, int]]:
        """Names and sizes of a folder's files, sorted; none if it isn't there."""
        fs, path = self._open(folder)
        infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted((i.base_name, i.size) for i in infos if i.type == pafs.FileType.File)

    def delete(self, *names: str) -> int:
        """Deletes files or folders; those that aren't there count as deleted. How many were."""
        n = 0
        for name in names:
            fs, path = self._open(name)
            kind = fs.get_file_info(path).type
            if kind == pafs.FileType.Directory:
                fs.delete_dir(path)
            elif kind == pafs.FileType.File:
                fs.delete_file(path)
            n += kind != pafs.FileType.NotFound
        return n
