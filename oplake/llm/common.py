"""Helpers shared by the training-data operators: shared scratch tables, input
projection and vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[str, SparkSession] = {}


# --------------------------------------------------------------------------- scratch


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Where it is unset, a local one is
    set if the session runs on this machine alone; on a cluster it has to be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="oplake-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def release(spark: SparkSession) -> None:
    """Lets shuffle files and broadcasts go that nothing refers to any more; else they stay until the
    driver's JVM happens to collect its garbage, which large stages seldom make it do.  What this process
    has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)
    for wait in (0.0, 1.0):  # what the first collection finds held by a step that is just ending goes with the second
        time.sleep(wait)
        spark.sparkContext._jvm.System.gc()


def scratch(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back, which cuts its
    lineage: a lost executor costs no more than the stage that was running.  ``free`` also
    releases what was shuffled for it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/oplake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    if free:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Removes the scratch tables of this process; call it once their results are stored."""
    for path, spark in list(_written.items()):
        _written.pop(path)
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(drop_scratch)


#: Rows of a batch that goes to a Python worker, where the session has Spark's default of 10000.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Has rows of whole texts go to Python in batches of BATCH_ROWS: a batch is held several times over, outside
    the executor's heap and in its workers.  A number that was chosen for the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ------------------------------------------------------------------------- counted hashes


def packed(rows: DataFrame) -> list[np.ndarray]:
    """The columns of ``rows`` (all long, none null) on the driver; they travel as packed bytes."""
    names = rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(i)).astype("<i8").tobytes()], pa.binary()) for i in range(len(names))], names=names)

    found = rows.mapInArrow(pack, ", ".join(f"{n} binary" for n in names)).collect()
    return [np.frombuffer(b"".join(bytes(r[i]) for r in found), dtype="<i8").astype(np.int64) for i in range(len(names))]


def heaviest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` rows (h long, c long > 0) of the largest ``c``, of equal ones those of the smallest
    ``h``: (h, c) in order of ``h``.  The least count is found by histograms, whose size does not follow
    the table's, and only the rows chosen come to the driver."""

    def edge(bins: list, room: int) -> tuple[int | None, int]:
        """Of (bin, rows), taken in order, the first that does not fit whole, and the room left for it."""
        for b, n in bins:
            if n > room:
                return b, room
            room -= n
        return None, room

    level = F.floor(F.log2(F.col("c").cast("double")) * 64)
    top, room = edge(counts.groupBy(level.alias("b")).count().orderBy(F.desc("b")).collect(), most)
    chosen = counts
    if top is not None:
        own = counts.where(level == top)
        least, room = edge(own.groupBy("c").count().orderBy(F.desc("c")).collect(), room)
        tied = own.where(F.col("c") == least)
        part = F.shiftright("h", 48)
        last, room = edge(tied.groupBy(part.alias("b")).count().orderBy("b").collect(), room)
        (ends,) = packed(tied.where(part == last).select("h"))
        end = np.sort(ends)[room].item()  # the first that has no room
        chosen = counts.where((F.col("c") > least) | (F.col("c") == least) & (F.col("h") < end))
    h, c = packed(chosen.select("h", "c"))
    order = np.argsort(h)
    return h[order], c[order]


# ---------------------------------------------------------------- words of Arrow batches

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective, so equal outputs mean equal inputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 21)
        out = np.full(n, _BASE, dtype=np.uint64)
        out[0] = 1
        _powers = np.cumprod(out, dtype=np.uint64)
        out[1:] = pow(_BASE, -1, 1 << 64)
        _inverse = np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of a run of documents: byte spans, 64-bit hashes, and where each document's words begin."""

    __slots__ = ("bytes", "doc_bytes", "start", "end", "first", "hash", "_total")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        b = data
        if lower:
            upper = (data - np.uint8(65)) < np.uint8(26)  # wraps round below 65
            b = data + (upper.view(np.uint8) << np.uint8(5))
        n = len(b)
        solid = (b != np.uint8(32)) & ((b - np.uint8(9)) >= np.uint8(5))
        begin, stop = solid.copy(), solid.copy()
        if n:
            begin[1:] &= ~solid[:-1]
            stop[:-1] &= ~solid[1:]
            cut = offsets[(offsets > 0) & (offsets < n)]
            begin[cut] = solid[cut]
            stop[cut - 1] = solid[cut - 1]
        self.bytes, self.doc_bytes = b, offsets
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        _grow(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        spread = b.astype(np.uint64)
        spread += np.uint64(1)
        spread *= _powers[:n]
        np.cumsum(spread, out=total[1:])
        self._total = total
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans: a polynomial of the bytes that does not depend on where they stand."""
        return mix64((self._total[end] - self._total[start]) * _inverse[start] + (end - start).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def text_chunks(array: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(array))
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_chunks(array: pa.Array, lower: bool = True, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    for at, to, data, offsets in text_chunks(array, limit):
        yield at, to, Words(data, offsets, lower)
