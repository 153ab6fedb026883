"""Data source writers for plain files: many tasks, one commit, nothing half-written in place.

Both stage their files in a hidden folder beside the target, in a file system that driver and executors share, and move
them in when all tasks have ended well. A task that dies leaves its files in the staging folder, which goes with commit or
abort; nothing of a job that fails is ever seen under its final name.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes of neighbouring pieces that are written together.
BUFFER = 1 << 20


def local_path(path: str) -> str:
    """The path of a plain or ``file:`` name; these writers need a mounted file system."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: these files are written to a mounted file system; use sinks.document_parts for other stores")
    return parts.path if parts.scheme else path


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: bytes by name, or files by folder."""

    folder: str
    counts: dict[str, int] = field(default_factory=dict)


class _Staged(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = local_path(path).rstrip("/")
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    def abort(self, messages: list) -> None:
        """Takes the staging folder away. It is renamed first: tasks that still run then find no folder to write to."""
        dead = f"{self.staging}-dead"
        if os.path.isdir(self.staging):
            os.rename(self.staging, dead)
        shutil.rmtree(dead, ignore_errors=True)


class _PlacedWriter(_Staged):
    def __init__(self, path: str, sizes: dict[str, int]):
        super().__init__(path)
        self.sizes = sizes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done: Counter[str] = Counter()
        files: dict[str, int] = {}
        name, start, held, size = None, 0, [], 0

        def flush() -> None:
            nonlocal size
            if held:
                if name not in files:
                    if len(files) >= 64:
                        os.close(files.pop(next(iter(files))))
                    files[name] = os.open(f"{self.staging}/{name}", os.O_WRONLY | os.O_CREAT, 0o644)
                data = memoryview(b"".join(held))
                at = start
                while data:
                    n = os.pwrite(files[name], data, at)
                    data, at = data[n:], at + n
                done[name] += size
                held.clear()
                size = 0

        for batch in batches:
            for to, at, piece in zip(*(batch.column(k) for k in range(3))):
                to, at, piece = to.as_py(), at.as_py(), piece.as_py()
                if to != name or at != start + size or size >= BUFFER:
                    flush()
                    name, start = to, at
                held.append(piece)
                size += len(piece)
        flush()
        for descriptor in files.values():
            os.fsync(descriptor)
            os.close(descriptor)
        return Written(self.staging, dict(done))

    def commit(self, messages: list) -> None:
        done: Counter[str] = Counter()
        for message in messages:
            done.update(message.counts if message else {})
        if dict(done) != self.sizes:
            self.abort(messages)
            raise OSError(f"{self.path}: {dict(done)} bytes were written where {self.sizes} were announced")
        for name in self.sizes:
            os.replace(f"{self.staging}/{name}", f"{self.path}/{name}")
        self.abort(messages)


class PlacedFiles(DataSource):
    """Writes pieces (name, at, piece) of files at their byte offsets, from any task in any order.

    Options: ``path``, the folder, and ``size.<name>``, each file's bytes. A piece that is written twice is the same bytes
    in the same place, so tasks may be run again.
    """

    @classmethod
    def name(cls) -> str:
        return "placed_files"

    def schema(self) -> str:
        return "name string, at long, piece binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        names = [k for k in self.options if k.startswith("name.")]
        return _PlacedWriter(self.options["path"], {self.options[k]: int(self.options[f"size.{k[5:]}"]) for k in names})


def write_placed(pieces: DataFrame, folder: str, sizes: dict[str, int]) -> None:
    """Writes (name, at, piece); ``sizes`` has an entry for each file."""
    spark = pieces.sparkSession
    spark.dataSource.register(PlacedFiles)
    writer = pieces.select("name", "at", "piece").write.format("placed_files").mode("append").option("path", folder)
    for k, (name, size) in enumerate(sizes.items()):  # option keys lose their case, so names are values
        writer = writer.option(f"name.{k}", name).option(f"size.{k}", str(size))
    writer.save()


class _RoutedWriter(_Staged):
    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder = f"{self.staging}/{TaskContext.get().taskAttemptId()}"
        counts: Counter[str] = Counter()
        os.mkdir(folder)
        for batch in batches:
            for category, name, data in zip(*(batch.column(k) for k in range(3))):
                category, name, data = category.as_py(), name.as_py(), data.as_py()
                if category not in counts:
                    os.mkdir(f"{folder}/{category}")
                with open(f"{folder}/{category}/{name}", "xb") as out:
                    out.write(data or b"")
                counts[category] += 1
        return Written(folder, dict(counts))

    def commit(self, messages: list) -> None:
        for message in messages:
            for category in message.counts if message else ():
                os.makedirs(f"{self.path}/{category}", exist_ok=True)
                for entry in os.scandir(f"{message.folder}/{category}"):
                    os.replace(entry.path, f"{self.path}/{category}/{entry.name}")
        self.abort(messages)


class RoutedFiles(DataSource):
    """Writes rows (category, name, data) as files ``path``/category/name; each is to come once. Replaces older ones."""

    @classmethod
    def name(cls) -> str:
        return "routed_files"

    def schema(self) -> str:
        return "category string, name string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _RoutedWriter(self.options["path"])


def write_routed(files: DataFrame, folder: str) -> None:
    files.sparkSession.dataSource.register(RoutedFiles)
    files.select("category", "name", "data").write.format("routed_files").mode("append").option("path", folder).save()
