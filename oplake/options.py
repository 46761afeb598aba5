"""Options of a database, reads and writes.

Fields that only tune a native storage engine (marked *inert*) are accepted, validated and
reported, but Spark's own reader, cache and codecs decide the physical work.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from oplake.errors import InvalidArgument
from oplake.functions.keys import BYTEWISE, KeyOrder

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30

#: (field, least, most): values outside are clipped.
CLIPS = (("max_open_files", 74, 50_000), ("write_buffer_size", 64 * KIB, GIB), ("max_file_size", MIB, GIB), ("block_size", KIB, 4 * MIB))
COMPRESSIONS = {"none": "uncompressed", "snappy": "snappy", "zstd": "zstd"}
FILTER_LAYOUTS = ("automatic", "block_based", "full_table")
CACHE_POLICIES = ("automatic", "lru", "clock")


@dataclass(frozen=True)
class BlockCacheOptions:
    """Inert: what a block cache would hold, Spark's ``persist`` holds as whole DataFrames."""

    capacity: int = 0
    policy: str = "automatic"

    def __post_init__(self):
        if self.policy not in CACHE_POLICIES:
            raise InvalidArgument(f"unknown block cache policy {self.policy!r}")
        if self.capacity < 0:
            raise InvalidArgument("block cache capacity must not be negative")


@dataclass(frozen=True)
class Options:
    comparator: KeyOrder = BYTEWISE
    create_if_missing: bool = False
    error_if_exists: bool = False
    write_buffer_size: int = 4 * MIB
    max_file_size: int = 2 * MIB
    max_open_files: int = 1000  # inert
    allow_mmap_reads: bool = True  # inert
    block_size: int = 4 * KIB  # inert
    block_restart_interval: int = 16  # inert
    bloom_bits_per_key: int | None = 10
    bloom_filter_layout: str = "automatic"  # inert
    compression: str = "snappy"
    zstd_compression_level: int = 1
    sync_wal_creation: bool = True
    allow_weak_namespace_durability: bool = False  # inert
    block_cache: BlockCacheOptions | None = None  # inert
    reuse_table_readers: bool = False  # inert
    clock: Callable[[], float] = field(default=time.monotonic, compare=False)  # times the slow-down of writes
    executor: Callable[[Callable[[], Any]], Any] | None = field(default=None, compare=False)  # runs flushes and compactions beside writes

    def prepared(self) -> Options:
        """Validated and clipped."""
        if self.compression not in COMPRESSIONS:
            raise InvalidArgument(f"unknown compression {self.compression!r}")
        if self.bloom_filter_layout not in FILTER_LAYOUTS:
            raise InvalidArgument(f"unknown bloom filter layout {self.bloom_filter_layout!r}")
        if self.block_restart_interval < 1:
            raise InvalidArgument("block_restart_interval must be positive")
        if not -5 <= self.zstd_compression_level <= 22:
            raise InvalidArgument("zstd_compression_level must lie within -5 and 22")
        if self.bloom_bits_per_key is not None and self.bloom_bits_per_key < 0:
            raise InvalidArgument("bloom_bits_per_key must not be negative")
        if not isinstance(self.comparator, KeyOrder):
            raise InvalidArgument("comparator must be a KeyOrder")
        return replace(self, **{name: min(max(getattr(self, name), low), high) for name, low, high in CLIPS})

    @property
    def uses_bloom_filter(self) -> bool:
        """A custom order with the automatic layout has no filter, as its equal keys may differ in bytes."""
        return self.bloom_bits_per_key is not None and (self.comparator is BYTEWISE or self.bloom_filter_layout != "automatic")


@dataclass(frozen=True)
class ReadOptions:
    snapshot: Any = None
    fill_cache: bool = True


@dataclass(frozen=True)
class WriteOptions:
    sync: bool = False


@dataclass(frozen=True)
class MultiGetOptions:
    snapshot: Any = None
    max_concurrency: int = 4
    fill_cache: bool = True

    def __post_init__(self):
        if not 1 <= self.max_concurrency <= 16:
            raise InvalidArgument("max_concurrency must lie within 1 and 16")
