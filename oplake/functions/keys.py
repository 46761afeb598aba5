"""Key order: unsigned bytewise by default, or any order given by a sort key.

Spark has no pluggable collation of BINARY, so an order is a name and a function to bytes whose
unsigned order is the order meant; keys with equal sort keys are one key.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyOrder:
    name: str
    column: Callable[[Column], Column]  # of DataFrames
    of: Callable[[bytes], bytes]  # of driver-side keys

    def __post_init__(self):
        if not self.name:
            raise ValueError("an order needs a name")


#: The name is persisted and must match on reopening (fixed value).
BYTEWISE = KeyOrder("leveldb.BytewiseComparator", lambda c: c, bytes)
REVERSE_BYTEWISE = KeyOrder("oplake.ReverseBytewise", lambda c: F.unhex(F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("FFFF"))), lambda k: bytes(255 - b for b in k) + b"\xff\xff")
ASCII_CASELESS = KeyOrder("oplake.AsciiCaseless", lambda c: F.encode(F.lower(F.decode(c, "ISO-8859-1")), "ISO-8859-1"), lambda k: k.lower())

_registry = {o.name: o for o in (BYTEWISE, REVERSE_BYTEWISE, ASCII_CASELESS)}


def register(order: KeyOrder) -> KeyOrder:
    _registry[order.name] = order
    return order


def order_named(name: str) -> KeyOrder | None:
    return _registry.get(name)


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short key k with start <= k < limit, or ``start`` where there is no shorter one."""
    same = next((i for i, (a, b) in enumerate(zip(start, limit)) if a != b), min(len(start), len(limit)))
    if same < min(len(start), len(limit)) and start[same] < 255 and start[same] + 1 < limit[same]:
        return start[:same] + bytes([start[same] + 1])
    return start


def short_successor(key: bytes) -> bytes:
    """A short key that is not below ``key``: its first byte under 255 is raised and ends it."""
    for i, b in enumerate(key):
        if b != 255:
            return key[:i] + bytes([b + 1])
    return key


def prefix_end(prefix: bytes) -> bytes | None:
    """The first key after all keys with the prefix; None where there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


# ------------------------------------------------------------ typed keys, order-preserving


def encode_unsigned(n: int) -> bytes:
    return struct.pack(">Q", n)


def encode_signed(n: int) -> bytes:
    return struct.pack(">Q", n + (1 << 63))


def decode_signed(b: bytes) -> int:
    return struct.unpack(">Q", b)[0] - (1 << 63)


def encode_tuple(parts: list[bytes]) -> bytes:
    """Concatenation whose order is that of the tuples: 00 is escaped as 00 FF, parts end with 00 01."""
    return b"".join(p.replace(b"\x00", b"\x00\xff") + b"\x00\x01" for p in parts)


def signed_key(c: Column) -> Column:
    """The signed encoding of a BIGINT column as BINARY."""
    flipped = c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))
