"""Tar archives of any size as a data source: spark.read.format("tessera_tar").load(path).

A partition is a run of an archive's entries of about `bytes`: an archive above that is walked
from header to header with seeks when the read is planned, and read by several tasks, each
of which seeks to its entries. Smaller archives are a partition each, walked by its task.
Without bodies an archive of any size is listed by reading its headers only.

Options: path, a file or a folder, in any store that pyarrow.fs opens by its URI;
bodies, "false" to list entries (data is null); bytes, per partition. An entry's bytes are one
value, so an entry of 2 GB or more can be listed, not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.archives import walk

NAME = "tessera_tar"
BYTES = 64 << 20
_MOST = (1 << 31) - 1
SCHEMA = "path string, index int, name string, type string, size long, mtime long, offset long, data binary"
_KINDS = [("path", pa.string()), ("index", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("offset", pa.int64()), ("data", pa.binary())]
#: Bytes of entries that a batch has, or one larger entry.
_BATCH = 16 << 20


@dataclass
class Run(InputPartition):
    """Entries of an archive: all of them, or those that the plan found."""

    path: str
    entries: list[tuple] | None = None

    def __init__(self, path: str, entries: list[tuple] | None = None) -> None:
        super().__init__(path)
        self.path, self.entries = path, entries


def _walked(store: fs.FileSystem, path: str) -> list[tuple]:
    with store.open_input_file(path) as file:
        return list(walk(lambda at, n: file.read_at(n, at), file.size()))


class TarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bodies = str(options.get("bodies", "true")).lower() == "true"
        self.bytes = int(options.get("bytes", BYTES))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def partitions(self) -> list[Run]:
        store, at = self._store()
        found = store.get_file_info(at)
        files = [found] if found.type == fs.FileType.File else sorted(store.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda f: f.path)
        runs: list[Run] = []
        for file in files:
            if file.type != fs.FileType.File:
                continue
            if not self.bodies or file.size <= self.bytes:
                runs.append(Run(file.path))
                continue
            own, size = [], 0
            for entry in _walked(store, file.path):
                if own and size + entry[3] > self.bytes:
                    runs.append(Run(file.path, own))
                    own, size = [], 0
                own.append(entry)
                size += entry[3]
            if own:
                runs.append(Run(file.path, own))
        return runs or [Run("", [])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = self._store()
        rows, size = [], 0
        with store.open_input_file(partition.path) as file:
            end = file.size()
            for entry in partition.entries if partition.entries is not None else walk(lambda at, n: file.read_at(n, at), end):
                data = None
                if self.bodies:
                    if entry[3] > _MOST:
                        raise ValueError(f"{entry[1]} in {partition.path} has {entry[3]} bytes, more than a value holds")
                    data = file.read_at(entry[3], entry[5])
                    size += entry[3]
                rows.append((partition.path, *entry, data))
                if size >= _BATCH or len(rows) >= 4096:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _KINDS, strict=True)], [n for n, _ in _KINDS])


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)
