"""The ``events`` table as a partitioned log with batches, objects, transactions and commits.

The table has no null keys, tombstones, duplicates or transactions; fixed
rules derive them, so that every operator has something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import assign_offsets

N_PARTITIONS, BATCH, OBJECT, TXN = 4, 16, 512, 32
HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, props, part and ts_ms."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "props",
        (F.col("user_id") % N_PARTITIONS).cast("int").alias("part"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, part, off, ts_ms, k, v, producer_id."""
    rows = assign_offsets(events(spark, sf_dir), ["part"], ["ts_ms", "event_id"], F.lit(1), F.floor(F.col("ts_ms") / HOUR_MS))
    return rows.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "part",
        F.col("base_offset").alias("off"),
        "ts_ms",
        F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("k"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("v"),
        (F.col("user_id") % 8).cast("long").alias("producer_id"),
    )


def batches(log: DataFrame) -> DataFrame:
    """A row per batch of 16 offsets: bounds, times and bytes."""
    no = F.floor(F.col("off") / BATCH).cast("long")
    size = F.lit(8) + F.coalesce(F.length("k"), F.lit(0)) + F.coalesce(F.length("v"), F.lit(0))
    return (
        log.groupBy("part", no.alias("batch_no"))
        .agg(F.max("off").alias("last_offset"), F.count(F.lit(1)).alias("num_records"), F.min("ts_ms").alias("base_ts"), F.max("ts_ms").alias("max_ts"), (F.sum(size) + 61).cast("long").alias("batch_length"))
        .withColumn("base_offset", F.col("batch_no") * BATCH)
    )


def objects(batches_: DataFrame) -> DataFrame:
    """A row per object of 512 offsets, from its batches' footer entries."""
    per = OBJECT // BATCH
    no = F.floor(F.col("batch_no") / per).cast("long")
    return batches_.groupBy("part", no.alias("object_no")).agg(
        F.min("base_offset").alias("base_offset"),
        F.max_by("last_offset", "base_offset").alias("last_offset"),
        F.max("max_ts").alias("max_ts"),
        F.sum("batch_length").alias("data_size"),
        F.sum("num_records").alias("record_count"),
        F.count(F.lit(1)).alias("batch_count"),
    )


def transactions(log: DataFrame) -> DataFrame:
    """part, producer_id, txn_no, first_offset, last_offset, first_ts, n, outcome: 32 records of a producer and partition each."""
    rank = F.row_number().over(Window.partitionBy("part", "producer_id").orderBy("off")) - 1
    txns = (
        log.withColumn("txn_no", F.floor(rank / TXN).cast("long"))
        .groupBy("part", "producer_id", "txn_no")
        .agg(F.min("off").alias("first_offset"), F.max("off").alias("last_offset"), F.min("ts_ms").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    )
    last = F.max("txn_no").over(Window.partitionBy("part", "producer_id"))
    open_ = (F.col("txn_no") == last) & (F.col("producer_id") == 7)
    outcome = F.when(open_, "open").when((F.col("producer_id") + F.col("txn_no")) % 5 == 0, "abort").otherwise("commit")
    return txns.withColumn("outcome", outcome)


def commits(log: DataFrame) -> DataFrame:
    """grp, part, committed, commit_seq, ts_ms: offset commits of three groups."""
    return log.where(F.col("off") % 100 == 0).select(F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("grp"), "part", F.col("off").alias("committed"), F.col("event_id").alias("commit_seq"), "ts_ms")


def sends(log: DataFrame) -> DataFrame:
    """What producers sent: each record with its sequence, a tenth of them twice; in order of arrival."""
    seq = (F.row_number().over(Window.partitionBy("part", "producer_id").orderBy("off")) - 1).cast("long")
    first = log.withColumn("seq", seq)
    again = first.where(F.col("event_id") % 10 == 0)
    return first.withColumn("arrival", F.col("event_id") * 2).unionByName(again.withColumn("arrival", F.col("event_id") * 2 + 1)).select("part", "producer_id", "seq", "arrival", "off", "event_id")


#: The same, for DuckDB: CTEs that the SQL of the queries begins with.
LOG_SQL = """log AS (
  SELECT event_id, user_id, event_type, value, CAST(user_id % 4 AS INT) AS part,
    CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS off, epoch_us(ts) // 1000 AS ts_ms,
    CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS k, CASE WHEN event_type <> 'error' THEN props END AS v,
    CAST(user_id % 8 AS BIGINT) AS producer_id
  FROM events
)"""
BATCH_SQL = (
    LOG_SQL
    + """, batches AS (
  SELECT part, off // 16 AS batch_no, off // 16 * 16 AS base_offset, max(off) AS last_offset, count(*) AS num_records, min(ts_ms) AS base_ts, max(ts_ms) AS max_ts,
    CAST(61 + sum(8 + coalesce(length(k), 0) + coalesce(length(v), 0)) AS BIGINT) AS batch_length
  FROM log GROUP BY ALL
)"""
)
OBJECT_SQL = (
    BATCH_SQL
    + """, objects AS (
  SELECT part, batch_no // 32 AS object_no, min(base_offset) AS base_offset, max_by(last_offset, base_offset) AS last_offset, max(max_ts) AS max_ts,
    CAST(sum(batch_length) AS BIGINT) AS data_size, CAST(sum(num_records) AS BIGINT) AS record_count, count(*) AS batch_count
  FROM batches GROUP BY ALL
)"""
)
TXN_SQL = (
    BATCH_SQL
    + """, ranked AS (SELECT *, (row_number() OVER (PARTITION BY part, producer_id ORDER BY off) - 1) // 32 AS txn_no FROM log
), grouped AS (
  SELECT part, producer_id, txn_no, min(off) AS first_offset, max(off) AS last_offset, min(ts_ms) AS first_ts, count(*) AS n FROM ranked GROUP BY ALL
), txns AS (
  SELECT *, CASE WHEN txn_no = max(txn_no) OVER (PARTITION BY part, producer_id) AND producer_id = 7 THEN 'open' WHEN (producer_id + txn_no) % 5 = 0 THEN 'abort' ELSE 'commit' END AS outcome FROM grouped
)"""
)
COMMIT_SQL = (
    BATCH_SQL
    + """, commits AS (SELECT 'g' || CAST(event_id % 3 AS VARCHAR) AS grp, part, off AS committed, event_id AS commit_seq, ts_ms FROM log WHERE off % 100 = 0)"""
)
