"""Operators against plain models."""

import random

import pytest

from oplake.functions.keys import ASCII_CASELESS, REVERSE_BYTEWISE
from oplake.functions.sequence import dense_sequence
from oplake.operators import batch as bt
from oplake.operators import compaction as comp
from oplake.operators import visibility as vis
from oplake.operators.compaction import TableFile

SCHEMA = "user_key binary, sequence long, kind int, value binary"


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, kind, None if v is None else bytearray(v)) for k, s, kind, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def log():
    rng = random.Random(11)
    keys = [b"", b"\x00", b"\xff", b"\x80\x00", b"a", b"a\x00", b"ab", b"b", b"B"]
    out = []
    for s in range(1, 200):
        kind = int(rng.random() < 0.7)
        out.append((rng.choice(keys), s, kind, rng.randbytes(rng.randrange(3)) if kind else None))
    return out


def model(log, at=None):
    state = {}
    for k, s, kind, v in log:
        if at is None or s <= at:
            state[k] = v if kind else None
    return {k: v for k, v in state.items() if v is not None}


@pytest.mark.parametrize("at", [0, 5, 100, None])
def test_visible(spark, log, at):
    found = vis.visible(frame(spark, log), at).collect()
    assert {bytes(r.user_key): bytes(r.value) for r in found} == model(log, at) and len(found) == len(model(log, at))


def test_reads(spark, log):
    h, want = frame(spark, log), model(log, 150)
    order = sorted(want)
    asked = [b"a", b"zz", b"", b"a", b"\xff"]
    got = {r.pos: (r.found, r.value if r.value is None else bytes(r.value)) for r in vis.multi_get_list(h, asked, 150).collect()}
    assert got == {i: (k in want, want.get(k)) for i, k in enumerate(asked)}
    assert [bytes(r.user_key) for r in vis.seek(h, b"a", 3, 150).orderBy("pos").collect()] == [k for k in order if k >= b"a"][:3]
    assert [bytes(r.user_key) for r in vis.seek_for_prev(h, b"ab", 9, 150).orderBy("pos").collect()] == [k for k in order[::-1] if k <= b"ab"][:9]
    assert [bytes(r.user_key) for r in vis.numbered(vis.visible(h, 150), False).orderBy("pos").collect()] == order[::-1]
    assert {bytes(r.user_key) for r in vis.prefix_scan(h, b"a", 150).collect()} == {k for k in order if k.startswith(b"a")}
    assert {bytes(r.user_key) for r in vis.prefix_scan(h, b"\xff", 150).collect()} == {k for k in order if k.startswith(b"\xff")}
    assert {bytes(r.user_key) for r in vis.range_scan(h, b"\x00", b"b", 150).collect()} == {k for k in order if b"\x00" <= k < b"b"}
    for k in (b"a", b"", b"none"):
        assert [bytes(r.value) for r in vis.get(h, k, 150).collect()] == ([want[k]] if k in want else [])


def test_snapshot_diff(spark, log):
    a, b = model(log, 60), model(log, 180)
    want = {}
    for k in a.keys() | b.keys():
        if k not in a:
            want[k] = "added"
        elif k not in b:
            want[k] = "removed"
        elif a[k] != b[k]:
            want[k] = "changed"
    assert {bytes(r.user_key): r.change for r in vis.snapshot_diff(frame(spark, log), 60, 180).collect()} == want


def test_numbering_over_ranges(spark, monkeypatch):
    keys = [b"common" + random.Random(i).randbytes(i % 9) for i in range(300)]
    keys = sorted(set(keys))
    df = frame(spark, [(k, i, 1, b"") for i, k in enumerate(keys)]).repartition(4)
    monkeypatch.setattr(vis, "dense_sequence", lambda *a, **k: dense_sequence(*a, rows_per_range=40))
    for ascending in (True, False):
        got = [bytes(r.user_key) for r in vis.numbered(df, ascending).orderBy("pos").collect()]
        assert got == (keys if ascending else keys[::-1])
    assert vis.numbered(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", [REVERSE_BYTEWISE, ASCII_CASELESS])
def test_other_orders(spark, log, order):
    h = vis.keyed(frame(spark, log), order)
    state = {}
    for k, s, kind, v in log:
        state[order.of(k)] = (k, v)
    want = [k for _, (k, v) in sorted(state.items()) if v is not None]
    assert [bytes(r.user_key) for r in vis.numbered(vis.visible(h)).orderBy("pos").collect()] == want


def test_dense_sequence_over_ranges(spark):
    rows = [(i * 7 % 1000, i) for i in range(1000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    out = dense_sequence(df, ["a", "b"], rows_per_range=100).orderBy("sequence").collect()
    assert [r.sequence for r in out] == list(range(1, 1002))
    assert [(r.a, r.b) for r in out] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert dense_sequence(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("per_range", [1, 7, 100, 5000])
def test_dense_sequence_deals_ties(spark, per_range):
    """A value that half of the rows share, nulls, and numbers that one double stands for: any number of
    ranges numbers alike, and no range holds all rows of a heavy value."""
    rows = [(5 if i % 2 else i, i * 31 % 997) for i in range(997)] + [(None, 4), (None, 3), (1 << 60, 9), ((1 << 60) + 1, 1), ((1 << 60) + 2, 5)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(4)
    out = dense_sequence(df, ["a", "b"], rows_per_range=per_range)
    got = [(r.a, r.b) for r in out.orderBy("sequence").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r.sequence for r in out.select("sequence").collect()) == list(range(1, len(rows) + 1))


def test_group_commit_plan_has_no_edges(spark):
    """The plan of 3000 batches is the fold over all of them, beyond any window."""
    rng = random.Random(4)
    rows = [(no, 0, b"k", 1, "v" * rng.choice([1, 900, 40_000, 200_000])) for no in range(3000)]
    df = spark.createDataFrame([(a, b, bytearray(k), d, v) for a, b, k, d, v in rows], "batch_no long, pos long, user_key binary, kind int, value string").repartition(6)
    got = bt.group_commit_plan(df, sync_every=16).collect()
    want = bt.group_commits([(r.batch_bytes, r.batch_no % 16 == 15) for r in sorted(got, key=lambda r: r.batch_no)])
    assert [r.group_no for r in sorted(got, key=lambda r: r.batch_no)] == want and len(got) == 3000
    assert bt.group_commit_plan(df.limit(0)).count() == 0


#: A history, smallest snapshot 10, and what a compaction of it keeps (fixed values); D is a deletion.
HISTORY = "k0@12 k0@10 k0@8 k1@20 k1@15 k1@9 k1@8 k2@12D k2@5 k3@7D k3@4 k4@6D k4@2 k5@10D k6@9D k7@3D k9@2D"
KEPT = "k0@12 k0@10 k1@20 k1@15 k1@9 k2@12D k2@5 k4@6D k7@3D k9@2D"
DEEPER = [(b"k4", b"k4"), (b"k7", b"k8"), (b"k9", b"k9")]


def entries(text):
    out = []
    for item in text.split():
        k, s = item.split("@")
        out.append((k.encode(), int(s.rstrip("D")), int(not s.endswith("D")), None if s.endswith("D") else b"v"))
    return out


def test_retention(spark):
    deeper = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in DEEPER], "smallest_key binary, largest_key binary")
    kept = comp.retention(frame(spark, entries(HISTORY)), 10, deeper).collect()
    assert sorted((bytes(r.user_key), r.sequence) for r in kept) == sorted((k, s) for k, s, _, _ in entries(KEPT))
    gone = comp.retention(frame(spark, entries("a@3D a@2")), 10)
    assert gone.count() == 0


def test_retention_keeps_every_snapshot(spark, log):
    for s0 in (30, 120):
        kept = [(bytes(r.user_key), r.sequence, r.kind, r.value) for r in comp.retention(frame(spark, log), s0).collect()]
        for at in (s0, s0 + 20, 199):
            assert model(sorted(kept, key=lambda r: r[1]), at) == model(log, at)


def f(number, level, size, a, b, s=1, t=1):
    return TableFile(number, level, size, a, b, s, t)


def test_pick():
    mb = 1 << 20
    l0 = [f(i, 0, mb, b"a", b"c") for i in range(1, 4)] + [f(9, 0, mb, b"x", b"z")]
    assert comp.best_score(l0) == (0, 1.0) and comp.best_score([]) == (0, 0.0)
    c = comp.pick(l0, {}, 2 * mb)
    assert c.level == 0 and [x.number for x in c.inputs] == [1, 2, 3] and not c.is_trivial(2 * mb)
    assert comp.pick(l0[:3], {}, 2 * mb) is None
    worn = f(20, 1, mb, b"m", b"n")
    c = comp.pick([worn, f(21, 2, mb, b"a", b"b")], {}, 2 * mb, worn)
    assert c.inputs == [worn] and c.is_trivial(2 * mb)
    heavy = [f(30 + i, 3, 8 * mb, bytes([109, i]), bytes([109, i, 1])) for i in range(5)]
    wide = f(20, 1, mb, b"l", b"n")
    assert not comp.pick([wide, *heavy], {}, 2 * mb, wide).is_trivial(2 * mb)
    # round robin: the pointer moves past what was done
    big = [f(1, 1, 6 * mb, b"a", b"b"), f(2, 1, 6 * mb, b"c", b"d")]
    assert comp.pick(big, {}, 2 * mb).inputs[0].number == 1
    assert comp.pick(big, {1: big[0].high}, 2 * mb).inputs[0].number == 2
    assert comp.pick(big, {1: big[1].high}, 2 * mb).inputs[0].number == 1


def test_boundary_files_join():
    files = [f(1, 1, 1, b"a", b"k", 9, 8), f(2, 1, 1, b"k", b"m", 7, 3), f(3, 1, 1, b"m", b"z", 2, 1), f(4, 1, 1, b"zz", b"zzz")]
    assert [x.number for x in comp.with_boundaries(files, 1, files[:1])] == [1, 2, 3]


def test_flush_level_and_room():
    assert comp.flush_level([], b"a", b"b", 1) == 2
    assert comp.flush_level([f(1, 0, 1, b"a", b"b")], b"b", b"c", 1) == 0
    assert comp.flush_level([f(1, 1, 1, b"a", b"b")], b"b", b"c", 1) == 0
    assert comp.flush_level([f(1, 2, 1, b"a", b"b")], b"b", b"c", 1) == 1
    assert comp.flush_level([f(1, 3, 100, b"a", b"b")], b"b", b"c", 1) == 1
    assert comp.flush_level([f(1, 2, 100, b"a", b"b")], b"b", b"c", 1) == 0
    assert comp.room_for_write(8, 0, 10, False, False) == "delay" and comp.room_for_write(8, 0, 10, False, True) == "ok"
    assert comp.room_for_write(0, 11, 10, True, True) == "stall" and comp.room_for_write(12, 11, 10, False, True) == "stall"
    assert comp.room_for_write(0, 11, 10, False, True) == "rotate"
    assert comp.seek_budget(0) == 100 and comp.seek_budget(16384 * 500) == 500


def test_output_cuts():
    grand = [f(i, 3, 600, b"%d" % i, b"%d~" % i) for i in range(5)]
    assert comp.output_cuts(grand, 100) == [b"1~", b"3~"]
    assert comp.output_cuts([f(1, 3, 2000, b"b", b"c")], 100) == [b"c"] and comp.output_cuts(grand, 10_000) == []


def test_other_orders_place_and_pick():
    """Ranges compare by sort key: under the reverse order the largest bytes come first."""
    r = lambda n, level, a, b, size=1: TableFile(n, level, size, a, b, 1, 1, REVERSE_BYTEWISE)
    of = REVERSE_BYTEWISE.of
    files = [r(1, 2, b"z", b"p"), r(2, 2, b"m", b"a")]
    assert comp.flush_level(files, of(b"n"), of(b"n"), 1) == 2 and comp.flush_level(files, of(b"q"), of(b"b"), 1) == 1
    assert [x.number for x in comp.of_level(files, 2)] == [1, 2]
    l0 = [r(i, 0, b"z", b"a") for i in range(1, 5)]
    c = comp.pick(l0 + [r(9, 1, b"k", b"j")], {}, 1 << 20)
    assert [x.number for x in c.inputs] == [1, 2, 3, 4] and [x.number for x in c.next_inputs] == [9] and c.pointer[0] == b"a"


def test_retention_ranges_agree(spark):
    """A list of ranges, a frame of them and more bytes than a task is sent give the same rows; a key
    written without end costs one row a task and key in the shuffle."""
    history = entries(HISTORY) + [(b"hot", s, s % 2, b"v" if s % 2 else None) for s in range(100, 3000)] + [(b"old", s, 0, None) for s in range(1, 9)]
    df, ranges = frame(spark, history), [*DEEPER, (b"o", b"p"), (b"ok", b"q")]
    key = lambda rows: sorted((bytes(r.user_key), r.sequence) for r in rows)
    by_list = key(comp.retention(df, 2000, ranges).collect())
    by_frame = key(comp.retention(df, 2000, spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in ranges], "smallest_key binary, largest_key binary")).collect())
    assert by_list == by_frame and (b"old", 8) in by_list and sum(k == b"hot" for k, _ in by_list) == 999 + 1 - 1
    assert comp.merged_ranges(ranges) == ([b"k4", b"k7", b"k9", b"o"], [b"k4", b"k8", b"k9", b"q"])
    plan = comp.retention(df, 2000, ranges)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan


def test_group_commits():
    kb = 1 << 10
    assert bt.group_commits([(kb, False)] * 4) == [0, 0, 0, 0]
    assert bt.group_commits([(kb, False), (kb, True), (kb, False)]) == [0, 1, 1]
    assert bt.group_commits([(kb, True), (kb, False), (kb, True)]) == [0, 0, 0]
    assert bt.group_commits([(100 * kb, False), (100 * kb, False), (100 * kb, False)]) == [0, 0, 1]
    assert bt.group_commits([(200 * kb, False)] * 6) == [0, 0, 0, 0, 0, 1]
    assert bt.group_commits([]) == []


def test_write_batch():
    b = bt.WriteBatch().put(b"k", b"v").delete(b"k" * 200)
    assert b.approximate_size() == 12 + (1 + 2 + 2) + (1 + 2 + 200)
    c = b.copy().append(b)
    assert len(c) == 4 and len(b) == 2
    b.append(b)
    assert len(b) == 4
    b.clear()
    assert b.approximate_size() == 12
