"""Write batches: sequence assignment, last write in a batch, encoded size, group commit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oplake.errors import InvalidArgument
from oplake.functions.coding import varint_length
from oplake.functions.sequence import dense_sequence

#: Encoded header: sequence and count (fixed value).
HEADER_BYTES = 12
#: Group commit: a leader up to SMALL bytes admits SMALL more, a larger one up to LARGE in all (fixed values).
SMALL, LARGE = 128 << 10, 1 << 20
PUT, DELETE = 1, 0


@dataclass
class WriteBatch:
    """An ordered list of puts and deletes, applied whole or not at all."""

    ops: list[tuple[int, bytes, bytes | None]] = field(default_factory=list)

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((DELETE, bytes(key), None))
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        self.ops.extend(list(other.ops))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def copy(self) -> WriteBatch:
        return WriteBatch(list(self.ops))

    def __len__(self) -> int:
        return len(self.ops)

    def approximate_size(self) -> int:
        size = HEADER_BYTES
        for kind, key, value in self.ops:
            size += 1 + varint_length(len(key)) + len(key)
            if kind == PUT:
                size += varint_length(len(value)) + len(value)
        return size


def expand(batches: DataFrame, last_sequence: int = 0) -> DataFrame:
    """Op rows (batch_no, pos, ...) with the sequence each takes after ``last_sequence``."""
    out = dense_sequence(batches, ["batch_no", "pos"])
    return out.withColumn("sequence", F.col("sequence") + F.lit(last_sequence))


def last_wins(batches: DataFrame) -> DataFrame:
    """What each batch leaves of each key: the highest pos, unless it deletes."""
    w = Window.partitionBy("batch_no", "user_key").orderBy(F.desc("pos"))
    return batches.withColumn("__rank", F.row_number().over(w)).where("__rank = 1 and kind = 1").drop("__rank")


def _varint(n: Column) -> Column:
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)


def sizes(batches: DataFrame, key: Column | None = None, value: Column | None = None) -> DataFrame:
    """(batch_no, batch_bytes, records): the encoded size of each batch."""
    key = key if key is not None else F.col("user_key")
    value = value if value is not None else F.encode("value", "UTF-8")
    k, v = F.octet_length(key), F.octet_length(value)
    record = 1 + _varint(k) + k + F.when(F.col("kind") == PUT, _varint(v) + v).otherwise(0)
    return batches.groupBy("batch_no").agg((F.sum(record) + HEADER_BYTES).cast("long").alias("batch_bytes"), F.count("*").alias("records"))


class GroupFold:
    """Groups of waiting writes, one after the other.

    A leader takes those that follow while the group stays within its limit; a leader that does
    not sync takes none that does.
    """

    def __init__(self):
        self.group, self.total, self.limit, self.sync = -1, 0, 0, False

    def add(self, size: int, wants_sync: bool) -> int:
        """The group number of the next write."""
        if size < HEADER_BYTES:
            raise InvalidArgument("a batch is at least its header")
        if self.group >= 0 and self.total + size <= self.limit and (self.sync or not wants_sync):
            self.total += size
        else:
            self.group, self.total, self.sync = self.group + 1, size, wants_sync
            self.limit = size + SMALL if size <= SMALL else LARGE
        return self.group


def group_commits(queue: Iterable[tuple[int, bool]]) -> list[int]:
    """The group number of each waiting write (bytes, sync) in order."""
    fold = GroupFold()
    return [fold.add(size, sync) for size, sync in queue]


def group_commit_plan(batches: DataFrame, sync_every: int = 0) -> DataFrame:
    """(batch_no, batch_bytes, group_no) of batches written in order of number; each ``sync_every``-th
    syncs.

    A group's members follow from all groups before it, so the last step is one task that reads the
    sorted queue as a stream, two numbers a batch, and holds one group's state; sizes are added up and
    batches sorted in parallel before."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = GroupFold()
        for part in parts:
            groups = [fold.add(size, bool(sync_every) and no % sync_every == sync_every - 1) for no, size in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(groups, pa.int64())], names=["batch_no", "batch_bytes", "group_no"])

    sized = sizes(batches).select(F.col("batch_no").cast("long").alias("batch_no"), "batch_bytes")
    return sized.orderBy("batch_no").coalesce(1).mapInArrow(run, "batch_no long, batch_bytes long, group_no long")
