"""Codecs of the native files: write-ahead log, write batch, sorted table and version edits.

Pure functions over bytes, for inspection, import and the durable log of small writes; the
engine's own tables are Parquet.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from oplake.errors import Corruption, InvalidArgument, OplakeError
from oplake.functions import filters
from oplake.functions.coding import crc32c, get_bytes, get_varint, mask_crc, put_bytes, put_varint
from oplake.functions.keys import shortest_separator, short_successor

MAX_SEQUENCE = (1 << 56) - 1
#: Log framing (fixed values): block and header sizes, record types.
BLOCK, FRAME = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
#: Table framing (fixed values).
FOOTER, TRAILER, TABLE_MAGIC = 48, 5, 0xDB4775248B80FB57
NO_COMPRESSION, SNAPPY, ZSTD = 0, 1, 2
#: Metaindex keys: a full-table filter ends in this, whoever wrote it; the block-range filter has one name.
FULL_FILTER_SUFFIX, BLOCK_FILTER_KEY = ".FullBloom1", "filter.leveldb.BuiltinBloomFilter2"
FULL_FILTER_KEY = "filter.oplake" + FULL_FILTER_SUFFIX


# ------------------------------------------------------------------------- internal keys


def internal_key(user_key: bytes, sequence: int, kind: int) -> bytes:
    if not 0 <= sequence <= MAX_SEQUENCE:
        raise InvalidArgument("sequence out of range")
    return user_key + struct.pack("<Q", sequence << 8 | kind)


def parse_internal_key(key: bytes) -> tuple[bytes, int, int]:
    if len(key) < 8:
        raise Corruption("internal key is too short")
    (tail,) = struct.unpack_from("<Q", key, len(key) - 8)
    if tail & 255 > 1:
        raise Corruption("internal key has an unknown kind")
    return key[:-8], tail >> 8, tail & 255


# --------------------------------------------------------------------------- write batch


def encode_batch(sequence: int, ops: list[tuple[int, bytes, bytes | None]]) -> bytes:
    out = [struct.pack("<QI", sequence, len(ops))]
    for kind, key, value in ops:
        out.append(bytes([kind]) + put_bytes(key) + (put_bytes(value or b"") if kind == 1 else b""))
    return b"".join(out)


def decode_batch(data: bytes) -> tuple[int, list[tuple[int, bytes, bytes | None]]]:
    """(first sequence, ops); record i has the first sequence plus i."""
    if len(data) < 12:
        raise Corruption("write batch is too short")
    sequence, count = struct.unpack_from("<QI", data)
    ops, at = [], 12
    while at < len(data):
        kind = data[at]
        if kind > 1:
            raise Corruption("unknown write batch tag")
        key, at = get_bytes(data, at + 1)
        value = None
        if kind == 1:
            value, at = get_bytes(data, at)
        ops.append((kind, key, value))
    if len(ops) != count:
        raise Corruption("write batch has wrong count")
    return sequence, ops


# ----------------------------------------------------------------------- write-ahead log


@dataclass(frozen=True)
class LogRecord:
    offset: int
    data: bytes


@dataclass(frozen=True)
class LogCorruption:
    offset: int
    dropped_bytes: int
    error: OplakeError


def log_frames(data: bytes, at: int) -> bytes:
    """The bytes that append one record to a log that is ``at`` bytes long."""
    out, begin, rest = bytearray(), True, data
    while begin or rest:
        left = BLOCK - (at + len(out)) % BLOCK
        if left < FRAME:
            out += bytes(left)
            continue
        part, rest = rest[: left - FRAME], rest[left - FRAME :]
        kind = (FULL if begin else LAST) if not rest else (FIRST if begin else MIDDLE)
        crc = mask_crc(crc32c(bytes([kind]) + part))
        out += struct.pack("<IHB", crc, len(part), kind) + part
        begin = False
    return bytes(out)


def read_log(data: bytes) -> Iterator[LogRecord | LogCorruption]:
    """Whole records in order, and what had to be dropped.  A fault drops the rest of its block;
    a record cut off by the end of the file is no fault."""
    parts: list[bytes] = []
    begin = at = 0

    def lost(offset: int, count: int, why: str) -> LogCorruption:
        return LogCorruption(offset, count, Corruption(why))

    while at < len(data):
        left = BLOCK - at % BLOCK
        if left < FRAME:
            at += left
            continue
        if at + FRAME > len(data):
            return
        crc, size, kind = struct.unpack_from("<IHB", data, at)
        block_end = min(len(data), at + left)
        if FRAME + size > left:
            if at + left > len(data):
                return
            yield lost(at, block_end - at + sum(map(len, parts)), "a frame longer than its block")
            parts, at = [], block_end
            continue
        if at + FRAME + size > len(data):
            return
        if kind == 0 and size == 0:
            at, parts = block_end, []  # preallocated space
            continue
        part = data[at + FRAME : at + FRAME + size]
        if mask_crc(crc32c(bytes([kind]) + part)) != crc:
            yield lost(at, block_end - at + sum(map(len, parts)), "these bytes are not those that were written")
            parts, at = [], block_end
            continue
        here, at = at, at + FRAME + size
        if kind in (FULL, FIRST):
            if parts:
                yield lost(begin, sum(map(len, parts)), "a record broke off")
            parts, begin = [part], here
        elif kind in (MIDDLE, LAST):
            if not parts:
                yield lost(here, size, "a record goes on that never began")
                continue
            parts.append(part)
        else:
            yield lost(here, size + sum(map(len, parts)), "a frame of no known kind")
            parts = []
            continue
        if kind in (FULL, LAST):
            yield LogRecord(begin, b"".join(parts))
            parts = []


# --------------------------------------------------------------------------- sorted table


def _compress(raw: bytes, codec: int, level: int = 1) -> tuple[bytes, int]:
    if codec == SNAPPY:
        import pyarrow as pa

        packed = pa.compress(raw, codec="snappy", asbytes=True)
    elif codec == ZSTD:
        import zstandard

        packed = zstandard.ZstdCompressor(level=level).compress(raw)
    else:
        return raw, NO_COMPRESSION
    return (packed, codec) if len(packed) < len(raw) - len(raw) // 8 else (raw, NO_COMPRESSION)


def _uncompress(data: bytes, codec: int) -> bytes:
    try:
        if codec == NO_COMPRESSION:
            return data
        if codec == SNAPPY:
            import pyarrow as pa

            size, _ = get_varint(data, 0, 32)
            return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
        if codec == ZSTD:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(data)
    except OplakeError:
        raise
    except Exception as why:
        raise Corruption(f"block does not decompress: {why}") from None
    raise Corruption("unknown block type")


def read_block(data: bytes, offset: int, size: int, end: int) -> bytes:
    if offset + size + TRAILER > end:
        raise Corruption("block runs past the file's blocks")
    body, codec = data[offset : offset + size], data[offset + size]
    (crc,) = struct.unpack_from("<I", data, offset + size + 1)
    if mask_crc(crc32c(body + bytes([codec]))) != crc:
        raise Corruption(f"the block at {offset} is not as it was written")
    return _uncompress(body, codec)


def internal_order(key: bytes) -> tuple[bytes, int]:
    """What internal keys sort by: the user key, then the newest sequence."""
    user_key, sequence, kind = parse_internal_key(key)
    return user_key, -(sequence << 8 | kind)


Entries = list[tuple[bytes, bytes]]


class Block:
    """A block as runs of entries: a run starts at a restart, where a key is stored whole."""

    def __init__(self, data: bytes):
        words = len(data) // 4
        count = struct.unpack("<I", data[-4:])[0] if words else 0
        self.end = len(data) - 4 * (count + 1)
        if not words or self.end < 0:
            raise Corruption("a block has no room for its restarts")
        self.data = data
        self.starts = [n for (n,) in struct.iter_unpack("<I", data[self.end : -4])]
        if any(n > self.end for n in self.starts) or self.starts != sorted(self.starts):
            raise Corruption("restarts of a block point out of it")

    def __len__(self) -> int:
        return len(self.starts)

    def run(self, i: int) -> Entries:
        """The entries of the ``i``-th run."""
        at, end = self.starts[i], (*self.starts, self.end)[i + 1]
        out: Entries = []
        key = b""
        while at < end:
            shared, at = get_varint(self.data, at, 32)
            n, at = get_varint(self.data, at, 32)
            size, at = get_varint(self.data, at, 32)
            if shared > len(key) or at + n + size > end:
                raise Corruption("an entry runs out of its block")
            key = key[:shared] + self.data[at : at + n]
            out.append((key, self.data[at + n : at + n + size]))
            at += n + size
        return out

    def first(self, i: int) -> bytes:
        """The first key of the ``i``-th run, which is stored whole."""
        _, at = get_varint(self.data, self.starts[i], 32)
        n, at = get_varint(self.data, at, 32)
        _, at = get_varint(self.data, at, 32)
        return self.data[at : at + n]

    def run_of(self, bound) -> int:
        """The run that holds the first entry not below ``bound``, unless that one begins the next run."""
        return max(0, bisect.bisect_left(range(len(self)), bound, key=lambda i: internal_order(self.first(i))) - 1)


def block_entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    parts = Block(block)
    if parts.end and not parts.starts:
        raise Corruption("a block has entries and no restart")
    for i in range(len(parts)):
        yield from parts.run(i)


def build_block(entries: list[tuple[bytes, bytes]], interval: int = 16) -> bytes:
    out, restarts, last = bytearray(), [0], b""
    for i, (key, value) in enumerate(entries):
        shared = 0
        if i % interval == 0:
            restarts = [*restarts, len(out)] if i else restarts
        else:
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
        out += put_varint(shared) + put_varint(len(key) - shared) + put_varint(len(value)) + key[shared:] + value
        last = key
    return bytes(out) + b"".join(struct.pack("<I", r) for r in restarts) + struct.pack("<I", len(restarts))


def _handle(data: bytes, at: int = 0) -> tuple[int, int, int]:
    offset, at = get_varint(data, at)
    size, at = get_varint(data, at)
    return offset, size, at


@dataclass
class TableReader:
    """A sorted table held as bytes."""

    data: bytes
    index: list[tuple[bytes, int, int]] = field(default_factory=list)
    meta: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        if len(self.data) < FOOTER:
            raise Corruption("no table ends this early")
        self.end = len(self.data) - FOOTER
        footer = self.data[self.end :]
        if struct.unpack_from("<Q", footer, 40)[0] != TABLE_MAGIC:
            raise Corruption("this file does not end as a table does")
        m_off, m_size, at = _handle(footer)
        i_off, i_size, _ = _handle(footer, at)
        for key, value in block_entries(read_block(self.data, i_off, i_size, self.end)):
            self.index.append((key, *_handle(value)[:2]))
        for key, value in block_entries(read_block(self.data, m_off, m_size, self.end)):
            self.meta[key.decode("latin-1")] = _handle(value)[:2]

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for _, offset, size in self.index:
            yield from block_entries(read_block(self.data, offset, size, self.end))

    def may_match(self, user_key: bytes, block_offset: int = 0) -> bool:
        """By the full-table filter if there is one, else by the block-range filter."""
        full = next((h for k, h in self.meta.items() if k.startswith("filter.") and k.endswith(FULL_FILTER_SUFFIX)), None)
        if full is not None:
            return filters.full_may_match(user_key, read_block(self.data, *full, self.end))
        if BLOCK_FILTER_KEY in self.meta:
            return filters.BlockRangeFilters(read_block(self.data, *self.meta[BLOCK_FILTER_KEY], self.end)).may_match(block_offset, user_key)
        return True

    def block(self, i: int) -> Block:
        _, offset, size = self.index[i]
        return Block(read_block(self.data, offset, size, self.end))

    def cursor(self) -> TableCursor:
        return TableCursor(self)

    def get(self, user_key: bytes, sequence: int = MAX_SEQUENCE) -> tuple[int, bytes] | None:
        """(kind, value) of the newest version at ``sequence``."""
        at = self.cursor()
        if at.would_look(user_key, sequence) and at.seek(user_key, sequence) and at.entry[0] == user_key:
            return at.entry[2:]
        return None


class TableCursor:
    """Moves over a table's entries both ways: in the run it stands in, else to the next or previous
    run or block.  A seek reads the index, the restarts of one block and one run of it."""

    def __init__(self, table: TableReader):
        self.table = table
        self._block, self._run, self._at = -1, 0, 0
        self._open: Block | None = None
        self._entries: Entries = []

    @property
    def valid(self) -> bool:
        return 0 <= self._at < len(self._entries)

    @property
    def entry(self) -> tuple[bytes, int, int, bytes]:
        """(user key, sequence, kind, value)."""
        if not self.valid:
            raise InvalidArgument("the cursor is not on an entry")
        key, value = self._entries[self._at]
        user_key, sequence, kind = parse_internal_key(key)
        return user_key, sequence, kind, value

    def _enter(self, block: int, run: int | None, last: bool = False) -> bool:
        """Stands at the first or last entry of a run (None: the last one); steps over what is empty."""
        while 0 <= block < len(self.table.index):
            if block != self._block or self._open is None:
                self._block, self._open = block, self.table.block(block)
            run = len(self._open) - 1 if run is None else run
            while 0 <= run < len(self._open):
                self._run, self._entries = run, self._open.run(run)
                if self._entries:
                    self._at = len(self._entries) - 1 if last else 0
                    return True
                run += -1 if last else 1
            block, run = block + (-1 if last else 1), None if last else 0
        self._entries, self._at = [], 0
        return False

    def first(self) -> bool:
        return self._enter(0, 0)

    def last(self) -> bool:
        return self._enter(len(self.table.index) - 1, None, last=True)

    def next(self) -> bool:
        self._at += 1
        return self.valid or self._enter(self._block, self._run + 1)

    def prev(self) -> bool:
        self._at -= 1
        if self._at >= 0:
            return True
        return self._enter(self._block, self._run - 1, last=True) if self._run else self._enter(self._block - 1, None, last=True)

    def _place(self, user_key: bytes, sequence: int) -> tuple[tuple[bytes, int], int]:
        bound = (user_key, -(sequence << 8 | 1))
        return bound, bisect.bisect_left(self.table.index, bound, key=lambda e: internal_order(e[0]))

    def would_look(self, user_key: bytes, sequence: int = MAX_SEQUENCE) -> bool:
        """Whether the filters let the block that could hold the key do so."""
        _, block = self._place(user_key, sequence)
        return block < len(self.table.index) and self.table.may_match(user_key, self.table.index[block][1])

    def seek(self, user_key: bytes, sequence: int = MAX_SEQUENCE) -> bool:
        """The first entry at or after the key's version at ``sequence``."""
        bound, block = self._place(user_key, sequence)
        if block < len(self.table.index):
            if block != self._block or self._open is None:
                self._block, self._open = block, self.table.block(block)
            if self._enter(block, self._open.run_of(bound)):
                while internal_order(self._entries[self._at][0]) < bound:
                    if not self.next():
                        return False
                return True
        self._entries, self._at = [], 0
        return False

    def seek_for_prev(self, user_key: bytes, sequence: int = 0) -> bool:
        """The last entry at or before the key's version at ``sequence``, of all its versions by default."""
        bound = (user_key, -(sequence << 8))
        if not self.seek(user_key, sequence):
            return self.last()
        while internal_order(self._entries[self._at][0]) > bound:
            if not self.prev():
                return False
        return True



def build_table(rows: list[tuple[bytes, int, int, bytes]], block_size: int = 4096, interval: int = 16, codec: int = SNAPPY, level: int = 1, bits_per_key: int | None = 10, layout: str = "full_table") -> bytes:
    """A table of (user_key, sequence, kind, value) in internal order; out-of-order rows are refused."""
    out, index, waiting = bytearray(), [], []
    blocks: list[tuple[int, list[bytes]]] = []
    last: tuple[bytes, int] | None = None

    def put(raw: bytes, how: int) -> tuple[int, int]:
        body, used = _compress(raw, how, level)
        offset = len(out)
        out.extend(body + bytes([used]) + struct.pack("<I", mask_crc(crc32c(body + bytes([used])))))
        return offset, len(body)

    def close(following: bytes | None):
        if waiting:
            keys = [k[:-8] for k, _ in waiting]
            end = waiting[-1][0]
            short = short_successor(end[:-8]) if following is None else shortest_separator(end[:-8], following)
            at = put(build_block(waiting, interval), codec)
            index.append((internal_key(short, MAX_SEQUENCE, 1) if short != end[:-8] else end, put_varint(at[0]) + put_varint(at[1])))
            blocks.append((at[0], keys))
            waiting.clear()

    held = 0
    for key, sequence, kind, value in rows:
        if last is not None and (key, -sequence) <= last:
            raise InvalidArgument("table keys are out of order")
        if held >= block_size:
            close(key)
            held = 0
        last = key, -sequence
        waiting.append((internal_key(key, sequence, kind), value or b""))
        held += len(key) + 8 + len(value or b"") + 3
    close(None)
    meta = []
    if bits_per_key is not None and blocks:
        if layout == "block_based":
            name, body = BLOCK_FILTER_KEY, filters.BlockRangeFilters.build(blocks, bits_per_key)
        else:
            name, body = FULL_FILTER_KEY, filters.full_create([k for _, ks in blocks for k in dict.fromkeys(ks)], bits_per_key)
        at = put(body, NO_COMPRESSION)
        meta.append((name.encode(), put_varint(at[0]) + put_varint(at[1])))
    m = put(build_block(meta, interval), NO_COMPRESSION)
    i = put(build_block(index, 1), codec)
    handles = b"".join(put_varint(x) for x in (*m, *i))
    return bytes(out) + handles.ljust(40, b"\x00") + struct.pack("<Q", TABLE_MAGIC)


# -------------------------------------------------------------------------- version edits

#: Tags of the fields (fixed values).
COMPARATOR, LOG_NUMBER, NEXT_FILE, LAST_SEQUENCE, POINTER, DELETED, ADDED, PREV_LOG = 1, 2, 3, 4, 5, 6, 7, 9
#: Our own: the last micro-batch of a stream that this edit holds.  Other readers do not know it.
STREAM = 64
_SCALARS = {"log_number": LOG_NUMBER, "previous_log_number": PREV_LOG, "next_file_number": NEXT_FILE, "last_sequence": LAST_SEQUENCE}


@dataclass
class VersionEdit:
    comparator: str | None = None
    log_number: int | None = None
    previous_log_number: int | None = None
    next_file_number: int | None = None
    last_sequence: int | None = None
    compact_pointers: list[tuple[int, bytes]] = field(default_factory=list)  # level, internal key
    deleted_files: set[tuple[int, int]] = field(default_factory=set)
    new_files: list[tuple[int, int, int, bytes, bytes]] = field(default_factory=list)  # level, number, size, smallest, largest
    streams: dict[str, int] = field(default_factory=dict)

    def encode(self) -> bytes:
        out = [put_varint(COMPARATOR) + put_bytes(self.comparator.encode())] if self.comparator is not None else []
        for name, tag in _SCALARS.items():
            if getattr(self, name) is not None:
                out.append(put_varint(tag) + put_varint(getattr(self, name)))
        out += [put_varint(POINTER) + put_varint(level) + put_bytes(key) for level, key in self.compact_pointers]
        out += [put_varint(DELETED) + put_varint(level) + put_varint(number) for level, number in sorted(self.deleted_files)]
        out += [put_varint(ADDED) + b"".join(map(put_varint, (level, number, size))) + put_bytes(low) + put_bytes(high) for level, number, size, low, high in self.new_files]
        out += [put_varint(STREAM) + put_bytes(name.encode()) + put_varint(n) for name, n in sorted(self.streams.items())]
        return b"".join(out)

    @staticmethod
    def decode(data: bytes) -> VersionEdit:
        """Fields in any order; of repeated scalars the last counts; an unknown tag is a fault."""
        edit, at = VersionEdit(), 0
        by_tag = {tag: name for name, tag in _SCALARS.items()}

        def level(at: int) -> tuple[int, int]:
            n, at = get_varint(data, at, 32)
            if n >= 7:
                raise Corruption("malformed version edit level")
            return n, at

        def key(at: int) -> tuple[bytes, int]:
            k, at = get_bytes(data, at)
            parse_internal_key(k)
            return k, at

        while at < len(data):
            tag, at = get_varint(data, at, 32)
            if tag == COMPARATOR:
                name, at = get_bytes(data, at)
                edit.comparator = name.decode("utf-8", "surrogateescape")
            elif tag in by_tag:
                n, at = get_varint(data, at)
                setattr(edit, by_tag[tag], n)
            elif tag == POINTER:
                n, at = level(at)
                k, at = key(at)
                edit.compact_pointers.append((n, k))
            elif tag == DELETED:
                n, at = level(at)
                number, at = get_varint(data, at)
                edit.deleted_files.add((n, number))
            elif tag == ADDED:
                n, at = level(at)
                number, at = get_varint(data, at)
                size, at = get_varint(data, at)
                low, at = key(at)
                high, at = key(at)
                edit.new_files.append((n, number, size, low, high))
            elif tag == STREAM:
                name, at = get_bytes(data, at)
                n, at = get_varint(data, at)
                edit.streams[name.decode()] = n
            else:
                raise Corruption("unknown version edit tag")
        return edit


# ----------------------------------------------------------------------------- file names

_NUMBERED = {".log": "log", ".ldb": "table", ".dbtmp": "temp"}


def file_name(kind: str, number: int = 0) -> str:
    if kind in ("current", "lock"):
        return kind.upper()
    if kind == "manifest":
        return f"MANIFEST-{number:06d}"
    return f"{number:06d}" + next(s for s, k in _NUMBERED.items() if k == kind)


def parse_file_name(name: str) -> tuple[str, int] | None:
    """(kind, number) of canonical names; anything else is not a database file."""
    if name in ("CURRENT", "LOCK"):
        return name.lower(), 0
    m = re.fullmatch(r"MANIFEST-(\d+)|(\d+)(\.log|\.ldb|\.dbtmp)", name)
    if not m:
        return None
    kind, number = ("manifest", int(m[1])) if m[1] else (_NUMBERED[m[3]], int(m[2]))
    return (kind, number) if number and file_name(kind, number) == name else None
