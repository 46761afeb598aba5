"""Native files as rows: op-logs packed into table, log and manifest files and read back.

The bytes travel as a BINARY column, so files can be written by any sink and read from any
source (``spark.read.format("binaryFile")`` has the same shape).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from oplake.errors import Corruption, OplakeError
from oplake.operators import compaction as comp
from oplake.sources import native


def _bytes(v) -> bytes | None:
    return None if v is None else v.encode() if isinstance(v, str) else bytes(v)


def table_files(ops: DataFrame, by: str, codec: int = native.SNAPPY) -> DataFrame:
    """(number, content): one sorted table of the ops (user_key, sequence, kind, value) of each value of ``by``."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((bytes(k), int(s), int(kind), _bytes(v) or b"") for k, s, kind, v in zip(part["user_key"], part["sequence"], part["kind"], part["value"])), key=lambda r: (r[0], -r[1]))
        return pd.DataFrame({"number": [int(part[by].iloc[0])], "content": [native.build_table(rows, codec=codec)]})

    return ops.select(by, "user_key", "sequence", "kind", "value").groupBy(by).applyInPandas(build, "number long, content binary")


def read_table_files(files: DataFrame) -> DataFrame:
    """(number, user_key, sequence, kind, value) of all entries; a deletion's value is null where it is empty."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for number, content in zip(part["number"], part["content"]):
                rows = [(number, *native.parse_internal_key(k), v) for k, v in native.TableReader(bytes(content)).entries()]
                yield pd.DataFrame([(n, k, s, kind, None if kind == 0 and not v else v) for n, k, s, kind, v in rows], columns=["number", "user_key", "sequence", "kind", "value"])

    return files.mapInPandas(read, "number long, user_key binary, sequence long, kind int, value binary")


def log_files(batches: DataFrame, by: str) -> DataFrame:
    """(number, content): one log of each value of ``by``; rows of one (by, batch_no) are one batch in
    order of sequence, and batches follow by their first sequence."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        data = bytearray()
        for _, batch in sorted(part.groupby("batch_no"), key=lambda g: int(g[1]["sequence"].min())):
            batch = batch.sort_values("sequence")
            ops = [(int(kind), bytes(k), _bytes(v)) for kind, k, v in zip(batch["kind"], batch["user_key"], batch["value"])]
            data += native.log_frames(native.encode_batch(int(batch["sequence"].iloc[0]), ops), len(data))
        return pd.DataFrame({"number": [int(part[by].iloc[0])], "content": [bytes(data)]})

    names = list(dict.fromkeys([by, "batch_no", "user_key", "sequence", "kind", "value"]))
    return batches.select(*names).groupBy(by).applyInPandas(build, "number long, content binary")


def read_log_files(files: DataFrame) -> DataFrame:
    """(number, first_sequence, user_key, sequence, kind, value, error): ops, or what could not be read."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for number, content in zip(part["number"], part["content"]):
                rows = []
                for item in native.read_log(bytes(content)):
                    if isinstance(item, native.LogCorruption):
                        rows.append((number, None, None, None, None, None, str(item.error)))
                        continue
                    try:
                        first, ops = native.decode_batch(item.data)
                    except OplakeError as why:
                        rows.append((number, None, None, None, None, None, str(why)))
                        continue
                    rows += [(number, first, k, first + i, kind, v, None) for i, (kind, k, v) in enumerate(ops)]
                yield pd.DataFrame(rows, columns=["number", "first_sequence", "user_key", "sequence", "kind", "value", "error"], dtype=object)

    return files.mapInPandas(read, "number long, first_sequence long, user_key binary, sequence long, kind int, value binary, error string")


def manifest_file(edits: DataFrame) -> bytes:
    """A manifest of file edits (version, number, level, action, file_size, smallest_key, largest_key).
    A manifest is one small file by nature; it is built on the driver."""
    data, by_version = bytearray(), {}
    for r in edits.collect():
        edit = by_version.setdefault(r.version, native.VersionEdit())
        if r.action == "delete":
            edit.deleted_files.add((r.level, r.number))
        else:
            low, high = (native.internal_key(bytes(k), native.MAX_SEQUENCE, 1) for k in (r.smallest_key, r.largest_key))
            edit.new_files.append((r.level, r.number, r.file_size, low, high))
    for version in sorted(by_version):
        edit = by_version[version]
        edit.new_files.sort()
        edit.last_sequence = version
        data += native.log_frames(edit.encode(), len(data))
    return bytes(data)


def read_manifest(content: bytes) -> list[tuple[int, int, int, str]]:
    """(version, number, level, action) of every file edit; any fault is fatal."""
    out = []
    for item in native.read_log(content):
        if isinstance(item, native.LogCorruption):
            raise item.error
        edit = native.VersionEdit.decode(item.data)
        if edit.last_sequence is None:
            raise Corruption("edit has no version")
        out += [(edit.last_sequence, n, lv, "delete") for lv, n in sorted(edit.deleted_files)]
        out += [(edit.last_sequence, n, lv, "add") for lv, n, *_ in edit.new_files]
    assert all(0 <= lv < comp.LEVELS for _, _, lv, _ in out)
    return out
