"""Reads over an op-log: latest visible version, time travel, lookups and ordered scans.

``history`` has user_key BINARY, sequence BIGINT, kind INT (1 put, 0 delete) and value.  Keys
order as unsigned bytes; another order goes in as an extra ``sort_key`` column (see ``keyed``).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oplake.functions.keys import BYTEWISE, KeyOrder, prefix_end
from oplake.functions.sequence import dense_sequence


def keyed(history: DataFrame, order: KeyOrder = BYTEWISE) -> DataFrame:
    """Adds ``sort_key`` where the order is not that of the key's bytes."""
    return history if order is BYTEWISE else history.withColumn("sort_key", order.column(F.col("user_key")))


def _sort(df: DataFrame) -> str:
    return "sort_key" if "sort_key" in df.columns else "user_key"


def versions(history: DataFrame, sequence: int | None = None) -> DataFrame:
    """The newest version of each key at ``sequence`` (None: now), deletions included.

    Only the newest row of a key and task is shuffled, so a key written without end costs one row a task.
    """
    seen = history if sequence is None else history.where(F.col("sequence") <= sequence)
    w = Window.partitionBy(_sort(history)).orderBy(F.desc("sequence"))
    return seen.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def visible(history: DataFrame, sequence: int | None = None) -> DataFrame:
    """The state at ``sequence``: deletions are dropped after the newest version is chosen."""
    return versions(history, sequence).where("kind = 1")


def get(history: DataFrame, key: bytes, sequence: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """At most one row: the version of ``key`` that decides at ``sequence``; a deletion decides absence."""
    name = _sort(history)
    rows = history.where(F.col(name) == F.lit(order.of(key)))
    if sequence is not None:
        rows = rows.where(F.col("sequence") <= sequence)
    return rows.orderBy(F.desc("sequence")).limit(1).where("kind = 1")


#: A list of keys up to this many bytes is broadcast; a longer one is joined by shuffle.
BROADCAST_KEY_BYTES = 8 << 20


def multi_get_list(history: DataFrame, keys: list[bytes], sequence: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """``multi_get`` of a list on the driver, whose size decides how the log is cut to it."""
    asked = history.sparkSession.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "pos long, user_key binary")
    return multi_get(history, keyed(asked, order), sequence, small=sum(map(len, keys)) <= BROADCAST_KEY_BYTES)


def multi_get(history: DataFrame, keys: DataFrame, sequence: int | None = None, small: bool = False) -> DataFrame:
    """(pos, user_key, found, value) of each row of ``keys`` (pos, user_key), repeats kept.

    The log is first cut to the asked keys by a semi join; ``small`` says that the key list has a
    checked size, so that the cut happens in the scan and only rows of asked keys are shuffled.
    """
    name = _sort(history)
    asked = keys.select(F.col(name)).distinct()
    asked = F.broadcast(asked) if small else asked
    state = visible(history.join(asked, name, "left_semi"), sequence).select(name, "value", F.lit(True).alias("hit"))
    return keys.join(state, name, "left").select("pos", "user_key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def between(history: DataFrame, low: bytes | None = None, high: bytes | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """Rows with low <= key < high; the bounds reach the scan, as they are on the grouping key."""
    name = _sort(history)
    if low is not None:
        history = history.where(F.col(name) >= F.lit(order.of(low)))
    if high is not None:
        history = history.where(F.col(name) < F.lit(order.of(high)))
    return history


def range_scan(history: DataFrame, low: bytes | None, high: bytes | None, sequence: int | None = None) -> DataFrame:
    return visible(between(history, low, high), sequence)


def prefix_scan(history: DataFrame, prefix: bytes, sequence: int | None = None) -> DataFrame:
    """Keys that start with ``prefix`` as a half-open range, so that it prunes files and row groups."""
    return visible(between(history, prefix, prefix_end(prefix)).where(F.col("user_key").startswith(F.lit(prefix))), sequence)


def numbered(rows: DataFrame, ascending: bool = True, limit: int | None = None) -> DataFrame:
    """``pos`` from 0 in key order.  With a limit the top rows alone meet in one task; without, the
    rows are numbered by ranges of the seven bytes that follow the keys' common prefix."""
    name = _sort(rows)
    key: Column = F.asc(name) if ascending else F.desc(name)
    if limit is not None:
        top = rows.orderBy(key).limit(limit)
        return top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)).cast("long") - 1)
    ends = rows.agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).first()
    same = len(os.path.commonprefix([bytes(ends.low or b""), bytes(ends.high or b"")]))
    lead = F.conv(F.rpad(F.hex(F.substring(F.col(name), same + 1, 7)), 14, "0"), 16, 10).cast("double")
    out = dense_sequence(rows.withColumn("__lead", lead), ["__lead", name], "__place", count=ends.n)
    return out.withColumn("pos", F.col("__place") - 1 if ascending else F.lit(ends.n) - F.col("__place")).drop("__lead", "__place")


def seek(history: DataFrame, key: bytes, limit: int, sequence: int | None = None) -> DataFrame:
    """The first ``limit`` visible keys >= ``key``, with pos."""
    return numbered(visible(between(history, key, None), sequence), True, limit)


def seek_for_prev(history: DataFrame, key: bytes, limit: int, sequence: int | None = None, order: KeyOrder = BYTEWISE) -> DataFrame:
    """The last ``limit`` visible keys <= ``key``, with pos from the largest down."""
    name = _sort(history)
    return numbered(visible(history.where(F.col(name) <= F.lit(order.of(key))), sequence), False, limit)


def first_last(history: DataFrame, sequence: int | None = None) -> DataFrame:
    name = _sort(history)
    return visible(history, sequence).agg(F.min(name).alias("first_key"), F.max(name).alias("last_key"))


def snapshot_diff(history: DataFrame, before: int, after: int) -> DataFrame:
    """Keys added, removed or changed between two sequences, with both values.

    One pass: the newest version at each sequence is chosen per key, and the log is read once.
    """
    name = _sort(history)
    item = F.struct("sequence", "kind", "value")
    at = history.where(F.col("sequence") <= after).groupBy(name).agg(F.max(F.when(F.col("sequence") <= before, item)).alias("a"), F.max(item).alias("b"))
    value = lambda c: F.when(F.col(f"{c}.kind") == 1, F.col(f"{c}.value"))
    there = lambda c: F.coalesce(F.col(f"{c}.kind") == 1, F.lit(False))
    change = F.when(there("b") & ~there("a"), "added").when(there("a") & ~there("b"), "removed").when(there("a") & ~value("a").eqNullSafe(value("b")), "changed")
    return at.select(name, change.alias("change"), value("a").alias("before_value"), value("b").alias("after_value")).where("change is not null")


def history_of_key(history: DataFrame, key: bytes) -> DataFrame:
    return history.where(F.col("user_key") == F.lit(key))


def tombstones(history: DataFrame) -> DataFrame:
    """Deletions and versions of each key."""
    return history.groupBy("user_key").agg(F.sum((F.col("kind") == 0).cast("long")).alias("deletes"), F.count("*").alias("versions"))
