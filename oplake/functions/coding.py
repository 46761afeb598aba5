"""Byte codings of the native file formats: fixed and variable integers, checksums, hashes, escapes."""

from __future__ import annotations

import functools
import struct

import numpy as np

from oplake.errors import Corruption

_POLY = 0x82F63B78  # Castagnoli, reflected (fixed value)
_MASK_DELTA = 0xA282EAD8  # added to a rotated checksum that is stored (fixed value)


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLY if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


#: Longer data are taken in pieces of so many bytes, shorter ones than SHORT byte by byte.
_PIECE, SHORT = 4096, 48


@functools.lru_cache(maxsize=1)
def _behind() -> np.ndarray:
    """[k, byte]: what a byte adds to the checksum when k more bytes follow it."""
    out = np.empty((_PIECE, 256), dtype=np.uint32)
    out[0] = _CRC
    for k in range(1, _PIECE):
        out[k] = out[0][out[k - 1] & 0xFF] ^ (out[k - 1] >> 8)
    return out


def crc32c(data: bytes, crc: int = 0) -> int:
    """The checksum is linear: each byte adds its own part, by how many follow, and the checksum so far
    is the same as more bits set in the next four bytes."""
    crc ^= 0xFFFFFFFF
    at = 0
    while len(data) - at >= SHORT:
        piece = np.frombuffer(data, dtype=np.uint8, count=min(_PIECE, len(data) - at), offset=at).copy()
        piece[:4] ^= np.frombuffer(struct.pack("<I", crc), dtype=np.uint8)
        n = len(piece)
        crc = int(np.bitwise_xor.reduce(_behind()[np.arange(n - 1, -1, -1), piece]))
        at += n
    for b in data[at:]:
        crc = _CRC[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def mask_crc(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def varint_length(n: int) -> int:
    return max(1, (n.bit_length() + 6) // 7)


def get_varint(data: bytes, at: int, bits: int = 64) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift >= bits:
            raise Corruption("malformed varint")
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            if n >> bits:
                raise Corruption("varint out of range")
            return n, at


def put_bytes(b: bytes) -> bytes:
    return put_varint(len(b)) + b


def get_bytes(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = get_varint(data, at, 32)
    if at + n > len(data):
        raise Corruption("length runs past the end")
    return data[at : at + n], at + n


def hash32(data: bytes, seed: int) -> int:
    """The seeded word-at-a-time hash of the bloom filters."""
    m, mask = 0xC6A4A793, 0xFFFFFFFF
    h = seed ^ len(data) * m & mask
    whole = len(data) // 4 * 4
    for (word,) in struct.iter_unpack("<I", data[:whole]):
        h = (h + word) * m & mask
        h ^= h >> 16
    if len(data) > whole:
        h = (h + int.from_bytes(data[whole:], "little")) * m & mask
        h ^= h >> 24
    return h


_NAMED = {0x27: "\\'", 0x5C: "\\\\", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}


def escape_bytes(data: bytes) -> str:
    """Printable ASCII as it is, the rest escaped, for quoted diagnostic text."""
    return "".join(_NAMED.get(b) or (chr(b) if 32 <= b < 127 else f"\\x{b:02x}") for b in data)


def escaped(c):
    """``escape_bytes`` as a Column over BINARY, with built-in functions."""
    from pyspark.sql import functions as F

    def one(pair):
        n = F.conv(pair, 16, 10).cast("int")
        out = F.when((n >= 32) & (n < 127), F.char(n)).otherwise(F.concat(F.lit("\\x"), F.lower(pair)))
        for byte, text in _NAMED.items():
            out = F.when(n == byte, F.lit(text)).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(F.hex(c), F.lit(".."), F.lit(0)), one), "")
