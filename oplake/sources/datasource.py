"""Spark data sources over native files: ``kv_wal``, ``kv_sst`` and ``kv_manifest``.

``spark.read.format("kv_sst").load(path)`` reads a file or all matching files of a folder, one
partition a file.  Paths are those that the executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from oplake.errors import OplakeError
from oplake.sources import native


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    kind = ""

    def __init__(self, options: dict):
        self.path = options.get("path", "")

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            names = sorted(n for n in os.listdir(self.path) if (p := native.parse_file_name(n)) and p[0] == self.kind)
            return [_File(os.path.join(self.path, n)) for n in names]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from self.rows(os.path.basename(partition.path), f.read())

    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError


class WalReader(_Reader):
    kind = "log"

    def rows(self, name, data):
        for item in native.read_log(data):
            if isinstance(item, native.LogCorruption):
                yield name, item.offset, "corruption", None, None, None, None, f"{item.error} dropped_bytes={item.dropped_bytes}"
                continue
            try:
                first, ops = native.decode_batch(item.data)
            except OplakeError as why:
                yield name, item.offset, "record_error", None, None, None, None, str(why)
                continue
            for i, (kind, key, value) in enumerate(ops):
                yield name, item.offset, "op", first + i, kind, key, value, None


class SstReader(_Reader):
    kind = "table"

    def rows(self, name, data):
        for key, value in native.TableReader(data).entries():
            try:
                user_key, sequence, kind = native.parse_internal_key(key)
            except OplakeError as why:
                yield name, key, None, None, value, str(why)
            else:
                yield name, user_key, sequence, kind, value, None


class ManifestReader(_Reader):
    kind = "manifest"

    def rows(self, name, data):
        for version, item in enumerate(native.read_log(data), 1):
            if isinstance(item, native.LogCorruption):
                raise item.error  # unlike a log's, a manifest's faults are fatal
            e = native.VersionEdit.decode(item.data)
            base = (name, version, item.offset)
            scalars = (e.comparator, e.log_number, e.previous_log_number, e.next_file_number, e.last_sequence)
            yield *base, "scalars", *scalars, None, None, None, None, None
            for level, key in e.compact_pointers:
                yield *base, "compact_pointer", *[None] * 5, level, None, None, key, None
            for level, number in sorted(e.deleted_files):
                yield *base, "delete_file", *[None] * 5, level, number, None, None, None
            for level, number, size, low, high in e.new_files:
                yield *base, "add_file", *[None] * 5, level, number, size, low, high


def _source(short: str, reader: type, fields: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            return reader(self.options)

    return Source


SOURCES = [
    _source("kv_wal", WalReader, "file string, offset long, event string, sequence long, kind int, user_key binary, value binary, error string"),
    _source("kv_sst", SstReader, "file string, user_key binary, sequence long, kind int, value binary, error string"),
    _source("kv_manifest", ManifestReader, "file string, version long, offset long, event string, comparator string, log_number long, previous_log_number long, next_file_number long, last_sequence long, level int, number long, file_size long, smallest binary, largest binary"),
]


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
