"""Named queries of the engine and the SQL each is checked against.

Keys are BINARY inside and decoded on output; where order is the answer it is a ``pos`` column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oplake.functions.coding import escaped
from oplake.operators import batch, compaction
from oplake.operators import visibility as vis
from oplake.plans import relations as rel
from oplake.plans.relations import sql_with
from oplake.sources import export

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SNAPSHOT, EARLY, RETAIN_ALL, RETAIN_DEEP = 5000, 500, 30_000, 5000
ASKED = ["u00000003", "u00000001", "u00000003", "zzz", "u00000012", ""]
DEEPER = [("u00000020", "u00000040"), ("u00000100", "u00000100")]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def text(c: str):
    return F.decode(F.col(c), "UTF-8").alias(c)


def rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select(text("user_key"), "sequence", "value", *more)


def _visible(relation: str, at: int | None = None, where: str = "") -> str:
    """Visible state as a correlated maximum, a form of its own beside the engine's window."""
    seen = f"sequence <= {at}" if at is not None else "TRUE"
    return f"(SELECT r.user_key, r.sequence, r.value, r.kind FROM {relation} r JOIN (SELECT user_key, max(sequence) AS sequence FROM {relation} WHERE {seen} GROUP BY user_key) m ON r.user_key = m.user_key AND r.sequence = m.sequence WHERE r.kind = 1{where})"


@query("latest_state", f"{sql_with('events_ops')} SELECT user_key, sequence, value FROM {_visible('events_ops')}")
def latest_state(spark, d):
    return rows(vis.visible(rel.events_ops(spark, d)))


@query("snapshot_state", f"{sql_with('events_ops')} SELECT user_key, sequence, value FROM {_visible('events_ops', SNAPSHOT)}")
def snapshot_state(spark, d):
    return rows(vis.visible(rel.events_ops(spark, d), SNAPSHOT))


@query(
    "snapshot_diff",
    f"""{sql_with('events_ops')} SELECT coalesce(a.user_key, b.user_key) AS user_key,
  CASE WHEN a.user_key IS NULL THEN 'added' WHEN b.user_key IS NULL THEN 'removed' ELSE 'changed' END AS change, a.value AS before_value, b.value AS after_value
FROM {_visible('events_ops', EARLY)} a FULL JOIN {_visible('events_ops', SNAPSHOT)} b ON a.user_key = b.user_key WHERE a.value IS DISTINCT FROM b.value""",
)
def snapshot_diff(spark, d):
    return vis.snapshot_diff(rel.events_ops(spark, d), EARLY, SNAPSHOT).select(text("user_key"), "change", "before_value", "after_value")


@query(
    "multi_get_ordered",
    f"""{sql_with('events_ops')}, asked AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(ASKED))}) t(pos, user_key))
SELECT CAST(pos AS BIGINT) AS pos, asked.user_key, v.user_key IS NOT NULL AS found, v.value FROM asked LEFT JOIN {_visible('events_ops', SNAPSHOT)} v ON asked.user_key = v.user_key""",
)
def multi_get_ordered(spark, d):
    return vis.multi_get_list(rel.events_ops(spark, d), [k.encode() for k in ASKED], SNAPSHOT).select("pos", text("user_key"), "found", "value")


@query(
    "bulk_multi_get",
    f"""{sql_with('lineitem_ops')}, asked AS (SELECT range AS pos, 'p' || lpad(CAST(range * 7 % 25000 AS VARCHAR), 8, '0') AS user_key FROM range(10000))
SELECT pos, asked.user_key, v.user_key IS NOT NULL AS found, v.value FROM asked LEFT JOIN {_visible('lineitem_ops')} v ON asked.user_key = v.user_key""",
)
def bulk_multi_get(spark, d):
    """Ten thousand keys, repeats and missing ones among them, in one lookup."""
    key = F.concat(F.lit("p"), F.lpad((F.col("id") * 7 % 25000).cast("string"), 8, "0"))
    keys = spark.range(10_000).select(F.col("id").alias("pos"), F.encode(key, "UTF-8").alias("user_key"))
    return vis.multi_get(rel.lineitem_ops(spark, d), keys, small=True).select("pos", text("user_key"), "found", "value")


@query("range_scan", f"{sql_with('events_ops')} SELECT user_key, sequence, value FROM {_visible('events_ops')} WHERE user_key >= 'u00000010' AND user_key < 'u00000050'")
def range_scan(spark, d):
    return rows(vis.range_scan(rel.events_ops(spark, d), b"u00000010", b"u00000050"))


@query("seek_limit", f"{sql_with('events_ops')} SELECT user_key, value, row_number() OVER (ORDER BY user_key) - 1 AS pos FROM {_visible('events_ops')} WHERE user_key >= 'u00000040' ORDER BY user_key LIMIT 64")
def seek_limit(spark, d):
    return vis.seek(rel.events_ops(spark, d), b"u00000040", 64).select(text("user_key"), "value", "pos")


@query("seek_for_prev_limit", f"{sql_with('events_ops')} SELECT user_key, value, row_number() OVER (ORDER BY user_key DESC) - 1 AS pos FROM {_visible('events_ops')} WHERE user_key <= 'u00000100' ORDER BY user_key DESC LIMIT 64")
def seek_for_prev_limit(spark, d):
    return vis.seek_for_prev(rel.events_ops(spark, d), b"u00000100", 64).select(text("user_key"), "value", "pos")


@query("prefix_scan", f"{sql_with('orders_ops')} SELECT user_key, sequence, value FROM {_visible('orders_ops')} WHERE starts_with(user_key, 'o00000012')")
def prefix_scan(spark, d):
    return rows(vis.prefix_scan(rel.orders_ops(spark, d), b"o00000012"))


@query("forward_scan", f"{sql_with('events_ops')} SELECT user_key, value, row_number() OVER (ORDER BY user_key) - 1 AS pos FROM {_visible('events_ops')}")
def forward_scan(spark, d):
    return vis.numbered(vis.visible(rel.events_ops(spark, d))).select(text("user_key"), "value", "pos")


@query("reverse_scan", f"{sql_with('events_ops')} SELECT user_key, value, row_number() OVER (ORDER BY user_key DESC) - 1 AS pos FROM {_visible('events_ops')}")
def reverse_scan(spark, d):
    return vis.numbered(vis.visible(rel.events_ops(spark, d)), ascending=False).select(text("user_key"), "value", "pos")


@query("first_last", f"{sql_with('events_ops')} SELECT min(user_key) AS first_key, max(user_key) AS last_key FROM {_visible('events_ops')}")
def first_last(spark, d):
    return vis.first_last(rel.events_ops(spark, d)).select(text("first_key"), text("last_key"))


@query("lineitem_state", f"{sql_with('lineitem_ops')} SELECT user_key, sequence, value FROM {_visible('lineitem_ops')}")
def lineitem_state(spark, d):
    return rows(vis.visible(rel.lineitem_ops(spark, d)))


@query("merged_scan", f"{sql_with('events_ops', 'orders_ops')}, both_ops AS (SELECT * FROM events_ops UNION ALL SELECT * FROM orders_ops) SELECT user_key, sequence, value FROM {_visible('both_ops')} WHERE user_key >= 'o00001' AND user_key < 'u00000050'")
def merged_scan(spark, d):
    """Sources merged in key order, as memory and file levels are: the newest version of a key wins."""
    both = rel.events_ops(spark, d).unionByName(rel.orders_ops(spark, d))
    return rows(vis.range_scan(both, b"o00001", b"u00000050"))


_EXPAND = f"{sql_with('chat_batches')} SELECT batch_no, pos, user_key, kind, value, row_number() OVER (ORDER BY batch_no, pos) AS sequence FROM chat_batches"


@query("batch_expand", _EXPAND)
def batch_expand(spark, d):
    return batch.expand(rel.chat_batches(spark, d)).select("batch_no", "pos", text("user_key"), "kind", "value", "sequence")


@query("batch_last_wins", f"{sql_with('chat_batches')} SELECT c.batch_no, c.user_key, c.pos, c.value FROM chat_batches c JOIN (SELECT batch_no, user_key, max(pos) AS pos FROM chat_batches GROUP BY ALL) m USING (batch_no, user_key, pos) WHERE kind = 1")
def batch_last_wins(spark, d):
    return batch.last_wins(rel.chat_batches(spark, d)).select("batch_no", text("user_key"), "pos", "value")


_V = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
_BATCH_SIZE = f"""{sql_with('chat_batches')}, b AS (SELECT batch_no, kind, octet_length(encode(user_key)) AS k, octet_length(encode(value)) AS v FROM chat_batches)
SELECT batch_no, CAST(12 + sum(1 + {_V.format('k')} + k + CASE WHEN kind = 1 THEN {_V.format('v')} + v ELSE 0 END) AS BIGINT) AS batch_bytes, count(*) AS records FROM b GROUP BY batch_no"""


@query("batch_size", _BATCH_SIZE)
def batch_size(spark, d):
    return batch.sizes(rel.chat_batches(spark, d))


#: The fold as a recursion: the state of the group that each batch is in, one batch after the other.
_JOINS = "f.total + s.batch_bytes <= f.room AND (f.synced OR NOT s.sync)"
_ROOM = "CASE WHEN s.batch_bytes <= 131072 THEN s.batch_bytes + 131072 ELSE 1048576 END"
_GROUPS = f"""{_BATCH_SIZE.replace('WITH', 'WITH RECURSIVE', 1).replace('SELECT batch_no, CAST(12', ', sized AS (SELECT batch_no, CAST(12', 1)}), s AS (
  SELECT batch_no, batch_bytes, batch_no % 16 = 15 AS sync, row_number() OVER (ORDER BY batch_no) AS i FROM sized
), f AS (
  SELECT s.i, s.batch_no, s.batch_bytes, CAST(0 AS BIGINT) AS group_no, s.batch_bytes AS total, {_ROOM} AS room, s.sync AS synced FROM s WHERE s.i = 1
  UNION ALL
  SELECT s.i, s.batch_no, s.batch_bytes, CASE WHEN {_JOINS} THEN f.group_no ELSE f.group_no + 1 END, CASE WHEN {_JOINS} THEN f.total ELSE 0 END + s.batch_bytes,
    CASE WHEN {_JOINS} THEN f.room ELSE {_ROOM} END, CASE WHEN {_JOINS} THEN f.synced ELSE s.sync END
  FROM f JOIN s ON s.i = f.i + 1
) SELECT batch_no, batch_bytes, group_no FROM f"""


@query("group_commit_plan", _GROUPS)
def group_commit_plan(spark, d):
    return batch.group_commit_plan(rel.chat_batches(spark, d), sync_every=16)


@query("history_of_key", f"{sql_with('events_ops')} SELECT user_key, sequence, value, kind FROM events_ops WHERE user_key = 'u00000012'")
def history_of_key(spark, d):
    return rows(vis.history_of_key(rel.events_ops(spark, d), b"u00000012"), "kind")


@query("tombstone_count", f"{sql_with('lineitem_ops')} SELECT user_key, count(*) FILTER (kind = 0) AS deletes, count(*) AS versions FROM lineitem_ops GROUP BY user_key")
def tombstone_count(spark, d):
    return vis.tombstones(rel.lineitem_ops(spark, d)).select(text("user_key"), "deletes", "versions")


def _retained(relation: str, at: int, deeper: list[tuple[str, str]]) -> str:
    """Retention from its meaning: a row stays while some snapshot from ``at`` on can see it, and a
    deletion seen by all of them only while something older may lie below."""
    below = " OR ".join(f"r.user_key BETWEEN '{a}' AND '{b}'" for a, b in deeper) or "FALSE"
    return f"""{sql_with(relation)}, base AS (SELECT user_key, max(sequence) AS sequence FROM {relation} WHERE sequence <= {at} GROUP BY user_key)
SELECT r.user_key, r.sequence, r.kind FROM {relation} r LEFT JOIN base b ON r.user_key = b.user_key
WHERE r.sequence > {at} OR (r.sequence = b.sequence AND (r.kind = 1 OR {below}))"""


@query("retention", _retained("lineitem_ops", RETAIN_ALL, []))
def retention(spark, d):
    return compaction.retention(rel.lineitem_ops(spark, d), RETAIN_ALL).select(text("user_key"), "sequence", "kind")


@query("retention_with_deeper", _retained("events_ops", RETAIN_DEEP, DEEPER))
def retention_with_deeper(spark, d):
    deeper = spark.createDataFrame([(a.encode(), b.encode()) for a, b in DEEPER], "smallest_key binary, largest_key binary")
    return compaction.retention(rel.events_ops(spark, d), RETAIN_DEEP, deeper).select(text("user_key"), "sequence", "kind")


@query("level_scores", f"{sql_with('files_rel')} SELECT level, count(*) AS file_count, CAST(sum(file_size) AS BIGINT) AS file_bytes, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(file_size)::DOUBLE / (10485760.0::DOUBLE * pow(10.0::DOUBLE, level - 1)) END AS score FROM files_rel WHERE level < 6 GROUP BY level")
def level_scores(spark, d):
    return compaction.scores(rel.files_rel(spark, d))


@query("level_state", f"{sql_with('files_rel')} SELECT CAST(l.range AS INTEGER) AS level, count(number) AS file_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS file_bytes FROM range(7) l LEFT JOIN files_rel f ON f.level = l.range GROUP BY l.range")
def level_state(spark, d):
    return compaction.level_state(rel.files_rel(spark, d))


@query("version_fold", f"{sql_with('edits_rel')} SELECT level, number FROM edits_rel WHERE action = 'add' AND version <= 15 EXCEPT SELECT level, number FROM edits_rel WHERE action = 'delete' AND version <= 15")
def version_fold(spark, d):
    return compaction.fold_version(rel.edits_rel(spark, d), 15)


@query("overlap_files", f"{sql_with('files_rel')} SELECT level, number, file_size, smallest_key, largest_key FROM files_rel WHERE largest_key >= 'u00000120' AND smallest_key <= 'u00000130'")
def overlap_files(spark, d):
    return compaction.overlap_files(rel.files_rel(spark, d), b"u00000120", b"u00000130").select("level", "number", "file_size", text("smallest_key"), text("largest_key"))


@query("obsolete_files", f"{sql_with('edits_rel')} SELECT DISTINCT level, number FROM edits_rel WHERE action = 'delete' AND version <= 15")
def obsolete_files(spark, d):
    """Files that some edit added and no live version holds."""
    edits = rel.edits_rel(spark, d)
    live = compaction.fold_version(edits, 15)
    return edits.where("action = 'add' and version <= 15").select("level", "number").join(live, ["level", "number"], "left_anti")


FLUSHES = [("u00000000", "u00000001"), ("a", "b"), ("u00000120", "u00000130"), ("v", "w"), ("u0000014", "u0000015")]
_MET = "f.level = {0} AND f.largest_key >= r.low AND f.smallest_key <= r.high"
_FLUSH = f"""{sql_with('files_rel')}, r AS (SELECT * FROM (VALUES {', '.join(map(str, FLUSHES))}) t(low, high))
SELECT low, high, CASE WHEN EXISTS (SELECT 1 FROM files_rel f WHERE {_MET.format(0)}) OR EXISTS (SELECT 1 FROM files_rel f WHERE {_MET.format(1)})
  OR (SELECT coalesce(sum(file_size), 0) FROM files_rel f WHERE {_MET.format(2)}) > 20000 THEN 0
  WHEN EXISTS (SELECT 1 FROM files_rel f WHERE {_MET.format(2)}) OR (SELECT coalesce(sum(file_size), 0) FROM files_rel f WHERE {_MET.format(3)}) > 20000 THEN 1 ELSE 2 END AS flush_level FROM r"""


@query("flush_level", _FLUSH)
def flush_level(spark, d):
    ranges = spark.createDataFrame([(a.encode(), b.encode()) for a, b in FLUSHES], "low binary, high binary")
    return compaction.flush_levels(ranges, rel.files_rel(spark, d), 2000).select(text("low"), text("high"), "flush_level")


_PAIR = "CASE p WHEN '27' THEN chr(92) || chr(39) WHEN '5C' THEN chr(92) || chr(92) WHEN '0A' THEN chr(92) || 'n' WHEN '0D' THEN chr(92) || 'r' WHEN '09' THEN chr(92) || 't' ELSE CASE WHEN CAST('0x' || p AS INTEGER) BETWEEN 32 AND 126 THEN chr(CAST('0x' || p AS INTEGER)) ELSE chr(92) || 'x' || lower(p) END END"


@query("dump_escape", f"{sql_with('chat_batches')} SELECT batch_no, pos, array_to_string(list_transform(regexp_extract_all(hex(encode(value)), '..'), lambda p: {_PAIR}), '') AS escaped FROM chat_batches WHERE kind = 1")
def dump_escape(spark, d):
    return rel.chat_batches(spark, d).where("kind = 1").select("batch_no", "pos", escaped(F.encode("value", "UTF-8")).alias("escaped"))


@query("sst_dump", f"{sql_with('events_ops')} SELECT (sequence - 1) // 500 + 1 AS number, user_key, sequence, kind, value FROM events_ops")
def sst_dump(spark, d):
    """The op-log written as sorted tables of 500 ops and read back."""
    ops = rel.events_ops(spark, d).withColumn("number", F.floor((F.col("sequence") - 1) / 500) + 1)
    return export.read_table_files(export.table_files(ops, "number")).select("number", text("user_key"), "sequence", "kind", text("value"))


@query("wal_dump", f"{sql_with('chat_batches')}, s AS (SELECT *, row_number() OVER (ORDER BY batch_no, pos) AS sequence FROM chat_batches) SELECT batch_no // 10 AS number, min(sequence) OVER (PARTITION BY batch_no) AS first_sequence, user_key, sequence, kind, value FROM s")
def wal_dump(spark, d):
    """Batches written as logs of ten batches and read back."""
    ops = batch.expand(rel.chat_batches(spark, d)).withColumn("log", F.floor(F.col("batch_no") / 10))
    return export.read_log_files(export.log_files(ops, "log")).where("error is null").select("number", "first_sequence", text("user_key"), "sequence", "kind", text("value"))


@query("manifest_dump", f"{sql_with('edits_rel')} SELECT version, number, level, action FROM edits_rel")
def manifest_dump(spark, d):
    """File edits written as a manifest and read back."""
    edits = rel.edits_rel(spark, d).join(rel.files_rel(spark, d).drop("level"), "number")
    return spark.createDataFrame(export.read_manifest(export.manifest_file(edits)), "version long, number long, level int, action string")


def _point(name: str, key: str) -> None:
    @query(name, f"{sql_with('events_ops')} SELECT user_key, sequence, value FROM {_visible('events_ops')} WHERE user_key = '{key}'")
    def point(spark, d):
        return rows(vis.get(rel.events_ops(spark, d), key.encode()))


_point("point_get_hit", "u00000012")
_point("point_get_deleted", "u00000007")
_point("point_get_missing", "nobody")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
