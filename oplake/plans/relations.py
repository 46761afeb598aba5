"""Op-logs derived from the test tables.  ``user_key`` is BINARY as in the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oplake.functions.sequence import dense_sequence


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(letter: str, number: str, width: int) -> Column:
    return F.encode(F.concat(F.lit(letter), F.lpad(F.col(number).cast("string"), width, "0")), "UTF-8")


def events_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("event_type") == "error"
    return _read(spark, sf_dir, "events").select(_key("u", "user_id", 8).alias("user_key"), (F.col("event_id") + 1).alias("sequence"), F.when(gone, 0).otherwise(1).alias("kind"), F.when(~gone, F.col("event_type")).alias("value"))


def orders_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense_sequence(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    return rows.select(_key("o", "o_orderkey", 10).alias("user_key"), "sequence", F.lit(1).alias("kind"), F.col("o_orderstatus").alias("value"))


LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount"]


def lineitem_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense_sequence(_read(spark, sf_dir, "lineitem").select(*LINEITEM_ORDER, "l_returnflag", "l_linestatus"), LINEITEM_ORDER)
    gone = F.col("l_returnflag") == "R"
    return rows.select(_key("p", "l_partkey", 8).alias("user_key"), "sequence", F.when(gone, 0).otherwise(1).alias("kind"), F.when(~gone, F.col("l_linestatus")).alias("value"))


def chat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("turn") % 5 == 4
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_no"), F.col("turn").alias("pos"), F.encode(F.col("role"), "UTF-8").alias("user_key"), F.when(gone, 0).otherwise(1).alias("kind"), F.when(~gone, F.col("text")).alias("value"))


def files_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events_ops`` cut every 500 sequences into files of levels 0 to 3."""
    rows = events_ops(spark, sf_dir).withColumn("number", F.floor((F.col("sequence") - 1) / 500) + 1)
    size = F.sum(F.octet_length("user_key") + 8 + F.coalesce(F.octet_length(F.encode("value", "UTF-8")), F.lit(0)))
    return rows.groupBy("number").agg(size.alias("file_size"), F.min("user_key").alias("smallest_key"), F.max("user_key").alias("largest_key")).select((F.col("number") % 4).cast("int").alias("level"), "number", "file_size", "smallest_key", "largest_key")


def edits_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_rel(spark, sf_dir).select("number", "level")
    added = files.select(F.col("number").alias("version"), "number", "level", F.lit("add").alias("action"))
    return added.unionByName(files.where("number % 3 = 0").select((F.col("number") + 2).alias("version"), "number", "level", F.lit("delete").alias("action")))


#: The same relations in DuckDB SQL.
SQL = {
    "events_ops": "SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS user_key, event_id + 1 AS sequence, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events",
    "orders_ops": "SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS user_key, row_number() OVER (ORDER BY o_orderkey) AS sequence, 1 AS kind, o_orderstatus AS value FROM orders",
    "lineitem_ops": f"SELECT 'p' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS user_key, row_number() OVER (ORDER BY {', '.join(LINEITEM_ORDER)}) AS sequence, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS kind, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS value FROM lineitem",
    "chat_batches": "SELECT conv_id AS batch_no, turn AS pos, role AS user_key, CASE WHEN turn % 5 = 4 THEN 0 ELSE 1 END AS kind, CASE WHEN turn % 5 <> 4 THEN text END AS value FROM conversations",
    "files_rel": "SELECT CAST(number % 4 AS INTEGER) AS level, number, file_size, smallest_key, largest_key FROM (SELECT (sequence - 1) // 500 + 1 AS number, CAST(sum(octet_length(encode(user_key)) + 8 + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS file_size, min(user_key) AS smallest_key, max(user_key) AS largest_key FROM events_ops GROUP BY 1)",
    "edits_rel": "SELECT number AS version, number, level, 'add' AS action FROM files_rel UNION ALL SELECT number + 2, number, level, 'delete' FROM files_rel WHERE number % 3 = 0",
}
_NEEDS = {"files_rel": ["events_ops"], "edits_rel": ["events_ops", "files_rel"]}


def sql_with(*names: str) -> str:
    """A WITH clause that defines the relations ``names`` in DuckDB."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
