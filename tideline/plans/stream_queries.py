"""Streaming queries; the SQL is that of the batch operator they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import event_log as L
from ..sources.event_log import LOG_SQL
from ..streaming import jobs
from .registry import query
from .txn_queries import SEND_SQL, beats, sequenced


def staged(spark, rows, name: str):
    """Rows as a stream, from a table of four files in the shared folder."""
    folder = jobs.shared_dir(spark)
    rows.repartition(4).write.parquet(f"{folder}/{name}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/{name}")


@query("stream_dedup", f"WITH {SEND_SQL} SELECT part, producer_id, CAST(seq AS BIGINT) AS seq, arrival, 0 AS error_code, min(off) OVER (PARTITION BY part, producer_id, seq) AS result_offset, arrival % 2 = 1 AS duplicate FROM sends")
def stream_dedup(spark, d):
    sends = sequenced(L.records(spark, d))
    folder = jobs.shared_dir(spark)
    sends.repartitionByRange(4, "arrival").write.parquet(f"{folder}/sends")
    stream = spark.readStream.schema(sends.schema).parquet(f"{folder}/sends")
    return jobs.run(jobs.dedup(stream), spark, "append")


@query(
    "stream_txn",
    f"""WITH {LOG_SQL}, c AS (SELECT part, producer_id, off, CASE WHEN event_id % 40 = 7 THEN CASE WHEN event_id % 3 = 0 THEN 'abort' ELSE 'commit' END END AS control FROM log),
t AS (SELECT *, coalesce(sum(CASE WHEN control IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY part, producer_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn FROM c)
SELECT part, producer_id, min(off) FILTER (WHERE control IS NULL) AS first_offset, max(off) AS last_offset, max(control) AS outcome FROM t GROUP BY part, producer_id, txn HAVING min(off) FILTER (WHERE control IS NULL) IS NOT NULL AND max(control) IS NOT NULL""",
)
def stream_txn(spark, d):
    control = F.when(F.col("event_id") % 40 == 7, F.when(F.col("event_id") % 3 == 0, "abort").otherwise("commit"))
    log = L.records(spark, d).select("part", "producer_id", "off", control.alias("control"))
    folder = jobs.shared_dir(spark)
    log.write.parquet(f"{folder}/log")
    return jobs.run(jobs.transactions(spark.readStream.schema(log.schema).parquet(f"{folder}/log")), spark, "append")


@query("stream_group", f"WITH {LOG_SQL} SELECT 'g' || (user_id % 5) AS grp, user_id AS member_id, max(ts_ms) AS last_seen, count(*) AS n FROM log GROUP BY user_id")
def stream_group(spark, d):
    rows = jobs.run(jobs.members(staged(spark, beats(L.records(spark, d)), "beats")), spark, "update")
    return rows.groupBy("grp", "member_id").agg(F.max("last_seen").alias("last_seen"), F.max("n").alias("n"))


@query("stream_window_stats", "SELECT epoch_us(ts) // 3600000000 * 3600000 AS window_ms, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_stats(spark, d):
    rows = L.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    folder = jobs.shared_dir(spark)
    rows.write.parquet(f"{folder}/events")
    out = jobs.run(jobs.window_stats(spark.readStream.schema(rows.schema).parquet(f"{folder}/events")), spark, "update")
    return out.groupBy("window_ms").agg(F.max_by("n", "n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("stream_compact", f"WITH {LOG_SQL} SELECT part, k, off FROM log QUALIFY k IS NULL OR row_number() OVER (PARTITION BY part, k ORDER BY off DESC) = 1")
def stream_compact(spark, d):
    return jobs.compact(staged(spark, L.records(spark, d), "log"), spark).select("part", "k", "off")
