"""Flush and compaction: scores, picking, retention, splitting and placement.

Picking works on the file list of one version, which is small and lives on the driver; retention
works on op rows and is a DataFrame plan.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oplake.functions.keys import BYTEWISE, KeyOrder
from oplake.operators.visibility import versions

#: Levels, level-0 thresholds and growth of the level capacities (fixed values).
LEVELS = 7
L0_TRIGGER, L0_SLOWDOWN, L0_STOP = 4, 8, 12
LEVEL1_BYTES, LEVEL_FACTOR = 10 * 1048576, 10
EXPAND_FACTOR, GRANDPARENT_FACTOR = 25, 10
MAX_FLUSH_LEVEL = 2
#: How long a write is held up, once, where level-0 files pile up (fixed value).
SLOWDOWN_SECONDS = 0.001


def capacity(level: int) -> float:
    return float(LEVEL1_BYTES) * LEVEL_FACTOR ** max(0, level - 1)


@dataclass(frozen=True, order=True)
class TableFile:
    """One immutable sorted file.  Internal keys order by user key, then newest sequence first;
    keys compare by their sort keys, in ``order``."""

    number: int
    level: int = field(compare=False)
    size: int = field(compare=False)
    smallest: bytes = field(compare=False)
    largest: bytes = field(compare=False)
    smallest_sequence: int = field(default=0, compare=False)
    largest_sequence: int = field(default=0, compare=False)
    order: KeyOrder = field(default=BYTEWISE, compare=False)

    @functools.cached_property
    def first(self) -> bytes:
        return self.order.of(self.smallest)

    @functools.cached_property
    def last(self) -> bytes:
        return self.order.of(self.largest)

    @property
    def low(self) -> tuple[bytes, int]:
        return self.first, -self.smallest_sequence

    @property
    def high(self) -> tuple[bytes, int]:
        return self.last, -self.largest_sequence

    def at(self, level: int) -> TableFile:
        return replace(self, level=level)


Files = list[TableFile]


def total_size(files: Files) -> int:
    return sum(f.size for f in files)


def of_level(files: Files, level: int) -> Files:
    """Level 0 newest first is not needed here: by number; deeper levels by smallest key."""
    return sorted((f for f in files if f.level == level), key=(lambda f: f.number) if level == 0 else (lambda f: f.low))


def scores(files: DataFrame) -> DataFrame:
    """(level, file_count, file_bytes, score) of each level but the last that has files."""
    by_level = files.where(F.col("level") < LEVELS - 1).groupBy("level").agg(F.count("*").alias("file_count"), F.sum("file_size").cast("long").alias("file_bytes"))
    deep = F.col("file_bytes") / (F.lit(float(LEVEL1_BYTES)) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("level") - 1))
    return by_level.withColumn("score", F.when(F.col("level") == 0, F.col("file_count") / F.lit(float(L0_TRIGGER))).otherwise(deep))


def level_state(files: DataFrame) -> DataFrame:
    """(level, file_count, file_bytes) of all levels, empty ones too."""
    levels = files.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    by_level = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    return levels.join(by_level, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("file_count"), F.coalesce("b", F.lit(0)).cast("long").alias("file_bytes"))


def best_score(files: Files) -> tuple[int, float]:
    """The level that needs compaction most, the shallower one of equals, and its score."""
    best = (0, -1.0)
    for level in range(LEVELS - 1):
        own = of_level(files, level)
        score = len(own) / L0_TRIGGER if level == 0 else total_size(own) / capacity(level)
        if score > best[1]:
            best = (level, score)
    return best


def overlapping(files: Files, level: int, low: bytes, high: bytes) -> Files:
    """Files whose keys meet the sort keys [low, high]; in level 0 the range grows with what it meets."""
    own = of_level(files, level)
    while True:
        found = [f for f in own if f.last >= low and f.first <= high]
        if level or not found:
            return found
        wider = min(low, *(f.first for f in found)), max(high, *(f.last for f in found))
        if wider == (low, high):
            return found
        low, high = wider


def with_boundaries(files: Files, level: int, chosen: Files) -> Files:
    """Adds files of the level that begin with the user key at which ``chosen`` ends, as older
    versions left behind would hide newer ones moved down."""
    out = list(chosen)
    while out:
        end = max(f.high for f in out)
        after = [f for f in of_level(files, level) if f.low > end]
        step = min(after, key=lambda f: f.low, default=None)
        if step is None or step.first != end[0]:
            break
        out.append(step)
    return out


def key_range(files: Files) -> tuple[bytes, bytes]:
    """The sort keys that the files span."""
    return min(f.first for f in files), max(f.last for f in files)


@dataclass
class Compaction:
    level: int
    inputs: Files
    next_inputs: Files
    grandparents: Files
    pointer: tuple[bytes, int]  # (user key, -sequence) after which the next round of this level starts

    def is_trivial(self, target_size: int) -> bool:
        return len(self.inputs) == 1 and not self.next_inputs and total_size(self.grandparents) <= GRANDPARENT_FACTOR * target_size


def pick(files: Files, pointers: dict[int, tuple[bytes, int]], target_size: int, seek_file: TableFile | None = None) -> Compaction | None:
    """The next compaction: by size first, else the file that seeks have used up."""
    level, score = best_score(files)
    if score >= 1:
        own = of_level(files, level)
        start = pointers.get(level)
        after = None if start is None else (own[0].order.of(start[0]), start[1])
        inputs = [next((f for f in own if after is None or f.high > after), own[0])]
    elif seek_file is not None:
        level, inputs = seek_file.level, [seek_file]
    else:
        return None
    if level == 0:
        inputs = overlapping(files, 0, *key_range(inputs))
    inputs = with_boundaries(files, level, inputs)
    below = with_boundaries(files, level + 1, overlapping(files, level + 1, *key_range(inputs)))
    if below:
        wider = with_boundaries(files, level, overlapping(files, level, *key_range(inputs + below)))
        if len(wider) > len(inputs) and total_size(wider) + total_size(below) < EXPAND_FACTOR * target_size:
            deeper = with_boundaries(files, level + 1, overlapping(files, level + 1, *key_range(wider)))
            if len(deeper) == len(below):
                inputs, below = wider, deeper
    grand = overlapping(files, level + 2, *key_range(inputs + below)) if level + 2 < LEVELS else []
    end = max(inputs, key=lambda f: f.high)
    return Compaction(level, inputs, below, grand, (end.largest, -end.largest_sequence))


def flush_level(files: Files, low: bytes, high: bytes, target_size: int) -> int:
    """The level for a flushed range of sort keys: down to 2 while nothing there overlaps and little below does."""
    level = 0
    if overlapping(files, 0, low, high):
        return 0
    while level < MAX_FLUSH_LEVEL and not overlapping(files, level + 1, low, high) and total_size(overlapping(files, level + 2, low, high)) <= GRANDPARENT_FACTOR * target_size:
        level += 1
    return level


def flush_levels(ranges: DataFrame, files: DataFrame, target_size: int) -> DataFrame:
    """``flush_level`` of each row (low, high) over a file list that is a DataFrame."""
    limit = GRANDPARENT_FACTOR * target_size
    met = ranges.join(files, (F.col("largest_key") >= F.col("low")) & (F.col("smallest_key") <= F.col("high")), "left")
    there = lambda lv: F.coalesce(F.max(F.col("level") == lv), F.lit(False))
    held = lambda lv: F.coalesce(F.sum(F.when(F.col("level") == lv, F.col("file_size"))), F.lit(0))
    level = F.when(there(0) | there(1) | (held(2) > limit), 0).when(there(2) | (held(3) > limit), 1).otherwise(MAX_FLUSH_LEVEL)
    return met.groupBy("low", "high").agg(level.alias("flush_level"))


def room_for_write(l0_files: int, buffered: int, limit: int, has_immutable: bool, delayed: bool) -> str:
    """``delay`` once under slowdown, ``ok`` with room, ``stall`` where maintenance must end first, else ``rotate``."""
    if not delayed and l0_files >= L0_SLOWDOWN:
        return "delay"
    if buffered <= limit:
        return "ok"
    if has_immutable or l0_files >= L0_STOP:
        return "stall"
    return "rotate"


def seek_budget(size: int) -> int:
    """Seeks a file may cost before it is compacted."""
    return max(size // 16384, 100)


#: Key ranges up to this many bytes go to every task; more of them are joined.
RANGE_BYTES = 32 << 20


def merged_ranges(ranges: list[tuple[bytes, bytes]]) -> tuple[list[bytes], list[bytes]]:
    """The union of closed key ranges as disjoint ones in order: their lows and their highs."""
    lows: list[bytes] = []
    highs: list[bytes] = []
    for low, high in sorted(ranges):
        if highs and low <= highs[-1]:
            highs[-1] = max(highs[-1], high)
        else:
            lows.append(low)
            highs.append(high)
    return lows, highs


def _in_ranges(rows: DataFrame, key: str, ranges: list[tuple[bytes, bytes]]) -> DataFrame:
    """The rows whose key lies in one of the ranges, found by binary search in each task."""
    shared = rows.sparkSession.sparkContext.broadcast(merged_ranges(ranges))
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = shared.value
        for batch in batches:
            places = ((k, bisect.bisect_right(lows, k) - 1) for k in batch.column(at).to_pylist())
            yield batch.filter(pa.array([k is not None and i >= 0 and k <= highs[i] for k, i in places], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def retention(history: DataFrame, smallest_snapshot: int, deeper: DataFrame | list[tuple[bytes, bytes]] | None = None) -> DataFrame:
    """Rows that a compaction keeps.

    A row goes if the next newer row of its key is visible at ``smallest_snapshot`` already, or if
    it is a deletion visible there and no range of ``deeper`` (smallest_key, largest_key; of sort
    keys where the history has them) could hold an older version.

    So rows above the snapshot stay where they are; of the others the newest of each key is left,
    which shuffles one row of a key and task, and deletions among those are looked up.
    """
    key = "sort_key" if "sort_key" in history.columns else "user_key"
    above = history.where(F.col("sequence") > smallest_snapshot)
    newest = versions(history, smallest_snapshot)
    out = above.unionByName(newest.where(F.col("kind") != 0))
    deletions = newest.where(F.col("kind") == 0)
    if isinstance(deeper, list):
        if not deeper:
            return out
        if sum(len(a) + len(b) for a, b in deeper) <= RANGE_BYTES and history.schema[key].dataType.simpleString() == "binary":
            return out.unionByName(_in_ranges(deletions, key, deeper))
        deeper = history.sparkSession.createDataFrame([(bytearray(a), bytearray(b)) for a, b in deeper], "smallest_key binary, largest_key binary")
    if deeper is None:
        return out
    held = deletions.join(deeper.select("smallest_key", "largest_key"), (F.col(key) >= F.col("smallest_key")) & (F.col(key) <= F.col("largest_key")), "left_semi")
    return out.unionByName(held.select(*history.columns))


def overlap_files(files: DataFrame, low: bytes, high: bytes) -> DataFrame:
    return files.where((F.col("largest_key") >= F.lit(low)) & (F.col("smallest_key") <= F.lit(high)))


def fold_version(edits: DataFrame, version: int) -> DataFrame:
    """Files added by edits up to ``version`` and not deleted by a later one: (level, number)."""
    last = edits.where(F.col("version") <= version).groupBy("level", "number").agg(F.max(F.struct("version", F.col("action").alias("action"))).alias("last"))
    return last.where(F.col("last.action") == "add").select("level", "number")


def output_cuts(grandparents: Files, target_size: int) -> list[bytes]:
    """Sort keys at which an output file must end: a new one starts behind a grandparent once more than
    ten targets of grandparents overlap, so that no output will drag more than that into its next
    compaction.  Size splits the outputs besides."""
    out, overlap = [], 0
    for f in sorted(grandparents, key=lambda f: f.low):
        overlap += f.size
        if overlap > GRANDPARENT_FACTOR * target_size:
            out.append(f.last)
            overlap = 0
    return out
