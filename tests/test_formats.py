"""Codecs: round trips, known values, damage."""

import random

import pytest

from oplake.errors import Corruption, InvalidArgument
from oplake.functions import filters, keys
from oplake.functions.coding import crc32c, escape_bytes, get_varint, hash32, mask_crc, put_varint, varint_length
from oplake.sources import native

# A small closed database as another writer of the format leaves it (fixed values).
TABLE = bytes.fromhex(
    "d4023c00120662696e617279006b657901010005014476616c756500000f0064656c657465640004051714000708040103090b34676f6e65000c8002"
    "6b657074010209140078fe0100fe0100fe0100fa01001c000000000100000001edd14faa000000000100000000c0f2a1b00009026c01ffffffffffff"
    "ff005b0000000001000000007d55892d60086d1600000000000000000000000000000000000000000000000000000000000000000000000057fb808b"
    "247547db"
)
MANIFEST = bytes.fromhex(
    "56f9b8f81c0001011a6c6576656c64622e4279746577697365436f6d70617261746f72a49c8bbe08000102030900030404001fe040d92d0001020409"
    "0003060404070205b8011262696e617279006b657901010000000000000c6b6570740102000000000000"
)


def test_golden_image():
    table = native.TableReader(TABLE)
    rows = [(*native.parse_internal_key(k), v) for k, v in table.entries()]
    assert rows == [(b"binary\0key", 1, 1, b"value\0"), (b"deleted", 4, 0, b""), (b"deleted", 3, 1, b"gone"), (b"kept", 2, 1, b"x" * 256)]
    assert table.get(b"deleted") == (0, b"") and table.get(b"deleted", 3) == (1, b"gone") and table.get(b"nothing") is None
    edits = [native.VersionEdit.decode(r.data) for r in native.read_log(MANIFEST)]
    assert edits[0].comparator == "leveldb.BytewiseComparator"
    assert [(level, number, size) for e in edits for level, number, size, _, _ in e.new_files] == [(2, 5, 184)]
    assert edits[-1].last_sequence == 4 and b"".join(native.log_frames(e.encode(), 0) for e in edits[:1]) == MANIFEST[: len(native.log_frames(edits[0].encode(), 0))]


def test_checksum_and_hash():
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(bytes(32)) == 0x8A9136AA
    assert mask_crc(crc32c(b"foo")) != crc32c(b"foo")
    assert hash32(b"", 0xBC9F1D34) == 0xBC9F1D34
    assert hash32(bytes([0x62]), 0xBC9F1D34) == 0xEF1345C4
    assert hash32(bytes([0xE2, 0x99, 0xA5]), 0xBC9F1D34) == 0x323C078F


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 2**32 - 1, 2**63])
def test_varint(n):
    b = put_varint(n)
    assert get_varint(b, 0) == (n, len(b)) and len(b) == varint_length(n)
    with pytest.raises(Corruption):
        get_varint(b[:-1] if len(b) > 1 else b"", 0)


def test_escape():
    assert escape_bytes(b"a'\\\n\r\t\x00\xff~") == "a\\'\\\\\\n\\r\\t\\x00\\xff~"


def test_key_helpers():
    assert keys.shortest_separator(b"abc1", b"abc9") == b"abc2"
    assert keys.shortest_separator(b"abc", b"abcd") == b"abc"
    assert keys.short_successor(b"\xff\x01a") == b"\xff\x02"
    assert keys.prefix_end(b"a\xff") == b"b" and keys.prefix_end(b"\xff") is None and keys.prefix_end(b"") is None
    nums = [-(2**63), -5, -1, 0, 1, 9, 2**63 - 1]
    assert sorted(map(keys.encode_signed, nums)) == [keys.encode_signed(n) for n in nums]
    tuples = [[b"a", b""], [b"a", b"\x00"], [b"a\x00", b""], [b"ab", b""]]
    assert sorted(map(keys.encode_tuple, tuples)) == [keys.encode_tuple(t) for t in tuples]


@pytest.mark.parametrize("size", [0, 1, 32760, 32761, 40_000, 100_000])
def test_log_round_trip(size):
    data, records = b"", [b"x" * size, b"", b"tail"]
    for r in records:
        data += native.log_frames(r, len(data))
    assert [r.data for r in native.read_log(data)] == records
    assert [r.data for r in native.read_log(data[:-1])] == records[:-1]  # cut off: no fault


def test_log_damage_drops_the_block():
    data = b""
    for i in range(5):
        data += native.log_frames(bytes([i]) * 20_000, len(data))
    broken = bytearray(data)
    broken[100] ^= 1
    items = list(native.read_log(bytes(broken)))
    assert isinstance(items[0], native.LogCorruption)
    assert [r.data[0] for r in items if isinstance(r, native.LogRecord)] == [2, 3, 4]


def test_batch_codec():
    ops = [(1, b"k", b""), (0, b"", None), (1, b"\x00" * 200, b"v" * 20_000)]
    assert native.decode_batch(native.encode_batch(7, ops)) == (7, ops)
    good = native.encode_batch(7, ops)
    for bad in (good[:5], good[:-1], good + b"\x05", good[:8] + b"\x09" + good[9:]):
        with pytest.raises(Corruption):
            native.decode_batch(bad)


@pytest.mark.parametrize("codec", [native.NO_COMPRESSION, native.SNAPPY, native.ZSTD])
@pytest.mark.parametrize("layout", ["full_table", "block_based"])
def test_table_round_trip(codec, layout):
    rng = random.Random(3)
    rows = sorted({(rng.randbytes(rng.randrange(4)), rng.randrange(1000)) for _ in range(800)}, key=lambda r: (r[0], -r[1]))
    rows = [(k, s, rng.randrange(2), rng.randbytes(rng.randrange(60))) for k, s in rows]
    table = native.TableReader(native.build_table(rows, block_size=512, codec=codec, layout=layout))
    assert [(*native.parse_internal_key(k), v) for k, v in table.entries()] == rows
    for k in {r[0] for r in rows}:
        for at in (1000, 500):
            want = next(((kind, v) for key, s, kind, v in rows if key == k and s <= at), None)
            assert table.get(k, at) == want
    assert sum(table.may_match(b"none%d" % i) for i in range(200)) < (40 if layout == "full_table" else 201)
    with pytest.raises(InvalidArgument):
        native.build_table([(b"b", 1, 1, b""), (b"a", 1, 1, b"")])


def test_table_damage():
    data = bytearray(native.build_table([(b"a", 1, 1, b"x" * 100)]))
    data[3] ^= 1
    with pytest.raises(Corruption):
        list(native.TableReader(bytes(data)).entries())
    with pytest.raises(Corruption):
        native.TableReader(bytes(60))
    with pytest.raises(Corruption):
        native.TableReader(b"")


def test_version_edit_round_trip():
    key = native.internal_key(b"k", 5, 1)
    e = native.VersionEdit("order", 3, 0, 9, 77, [(1, key)], {(0, 4), (2, 1)}, [(1, 8, 100, key, key)], {"s": 3})
    assert native.VersionEdit.decode(e.encode()) == e
    twice = native.VersionEdit(log_number=1).encode() + native.VersionEdit(log_number=2).encode()
    assert native.VersionEdit.decode(twice).log_number == 2
    with pytest.raises(Corruption):
        native.VersionEdit.decode(put_varint(50))


def test_file_names():
    for kind, number in [("log", 5), ("table", 1234567), ("manifest", 2), ("temp", 9), ("current", 0), ("lock", 0)]:
        assert native.parse_file_name(native.file_name(kind, number)) == (kind, number)
    for name in ("5.log", "0000005.log", "000000.log", "MANIFEST-2", "x", "000005.sst"):
        assert native.parse_file_name(name) is None


def test_filters():
    known = [b"key%d" % i for i in range(500)]
    for make, ask in ((filters.bloom_create, filters.bloom_may_match), (filters.full_create, filters.full_may_match)):
        data = make(known, 10)
        assert all(ask(k, data) for k in known)
        assert sum(ask(b"no%d" % i, data) for i in range(2000)) < 80
    assert filters.probes_for(10) == 6 and filters.probes_for(0) == 1 and filters.probes_for(100) == 30
    assert not filters.bloom_may_match(b"a", b"") and filters.bloom_may_match(b"a", bytes(8) + b"\x1f")
    with pytest.raises(Corruption):
        filters.full_may_match(b"a", bytes(80))


@pytest.mark.parametrize("interval,block_size", [(1, 64), (3, 200), (16, 4096)])
def test_table_cursor_both_ways(interval, block_size):
    """Seeks and moves of a table cursor against the sorted list, at any size of block and run."""
    rng = random.Random(interval)
    rows = sorted({(bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(5))), rng.randrange(1, 40)) for _ in range(300)}, key=lambda r: (r[0], -r[1]))
    table = native.TableReader(native.build_table([(k, s, 1, b"%d" % s) for k, s in rows], block_size=block_size, interval=interval))
    c, seen = table.cursor(), []
    assert not c.valid and c.first()
    while c.valid:
        seen.append(c.entry[:2])
        c.next()
    assert seen == rows
    c.last()
    back = []
    while c.valid:
        back.append(c.entry[:2])
        c.prev()
    assert back == rows[::-1]
    at = lambda r: (r[0], -r[1])
    for _ in range(200):
        key, s = bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(5))), rng.randrange(0, 42)
        after = [r for r in rows if at(r) >= (key, -s)]
        assert c.seek(key, s) == bool(after) and (not after or c.entry[:2] == after[0])
        if after and rng.random() < 0.5:
            i = rows.index(after[0])
            assert c.prev() == (i > 0) and (i == 0 or c.entry[:2] == rows[i - 1])
        before = [r for r in rows if r[0] <= key]
        assert c.seek_for_prev(key) == bool(before) and (not before or c.entry[:2] == before[-1])
        own = [r for r in rows if r[0] == key and r[1] <= s]
        assert table.get(key, s) == ((1, b"%d" % own[0][1]) if own else None)


def test_checksum_of_any_length():
    """The checksum by pieces against the one byte by byte, whole and continued."""
    rng = random.Random(2)

    def plain(data, crc=0):
        crc ^= 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    for n in (0, 1, 3, 4, 47, 48, 49, 255, 4095, 4096, 4097, 4100, 9000):
        data = rng.randbytes(n)
        assert crc32c(data) == plain(data)
        cut = rng.randrange(n + 1)
        assert crc32c(data[cut:], crc32c(data[:cut])) == plain(data)
