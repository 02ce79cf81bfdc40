"""Queries on the log: scans, lookups, compaction, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, ingest, lookup, retention, scan
from ..sources import event_log as L
from ..sources import object_files
from ..sources.event_log import BATCH_SQL, LOG_SQL, OBJECT_SQL, TXN_SQL
from .registry import query


def now_of(log: DataFrame) -> DataFrame:
    """One row: the largest time stamp of the table, which stands for the present."""
    return log.agg(F.max("ts_ms").alias("now_ms"))


def with_now(rows: DataFrame, log: DataFrame) -> tuple[DataFrame, Column]:
    return rows.join(F.broadcast(now_of(log))), F.col("now_ms")


def state_of(batches: DataFrame) -> DataFrame:
    return lookup.part_state(batches)


@query("log_view", f"WITH {LOG_SQL} SELECT part, off, ts_ms, k, v, producer_id FROM log")
def log_view(spark: SparkSession, d: str) -> DataFrame:
    return L.records(spark, d).select("part", "off", "ts_ms", "k", "v", "producer_id")


@query("compact_latest", f"WITH {LOG_SQL} SELECT part, k, max(off) AS off FROM log WHERE k IS NOT NULL GROUP BY part, k")
def compact_latest(spark, d):
    return compaction.latest_per_key(L.records(spark, d), keep_null=False).select("part", "k", "off")


@query("compact_nullkey", f"WITH {LOG_SQL} SELECT part, k, off FROM log QUALIFY k IS NULL OR row_number() OVER (PARTITION BY part, k ORDER BY off DESC) = 1")
def compact_nullkey(spark, d):
    return compaction.latest_per_key(L.records(spark, d)).select("part", "k", "off")


@query(
    "compact_tombstone",
    f"""WITH {LOG_SQL}, kept AS (SELECT * FROM log QUALIFY k IS NULL OR row_number() OVER (PARTITION BY part, k ORDER BY off DESC) = 1)
SELECT part, k, v, off FROM kept WHERE NOT (k IS NOT NULL AND v IS NULL AND ts_ms > 0 AND (SELECT max(ts_ms) FROM log) - ts_ms > 21600000)""",
)
def compact_tombstone(spark, d):
    log = L.records(spark, d)
    kept, now = with_now(compaction.latest_per_key(log), log)
    return compaction.expire_tombstones(kept, now, 21_600_000).select("part", "k", "v", "off")


@query(
    "compact_tombstone_append",
    f"""WITH {BATCH_SQL}, kept AS (SELECT * FROM log QUALIFY k IS NULL OR row_number() OVER (PARTITION BY part, k ORDER BY off DESC) = 1),
timed AS (SELECT kept.*, CASE WHEN kept.part % 2 = 1 THEN max_ts ELSE ts_ms END AS aged FROM kept JOIN batches b ON b.part = kept.part AND b.batch_no = kept.off // 16)
SELECT part, k, v, off FROM timed WHERE NOT (k IS NOT NULL AND v IS NULL AND aged > 0 AND (SELECT max(ts_ms) FROM log) - aged > 21600000)""",
)
def compact_tombstone_append(spark, d):
    """Odd partitions age by the time that the broker stamped on the whole batch."""
    log = L.records(spark, d)
    rows = log.withColumn("batch_no", F.floor(F.col("off") / L.BATCH).cast("long")).join(L.batches(log).select("part", "batch_no", "max_ts"), ["part", "batch_no"])
    kept, now = with_now(compaction.latest_per_key(rows.withColumn("aged", compaction.record_time(F.col("part") % 2 == 1))), log)
    return compaction.expire_tombstones(kept, now, 21_600_000, ts="aged").select("part", "k", "v", "off")


@query(
    "compact_watermarks",
    f"""WITH {OBJECT_SQL}, kept AS (SELECT part, off // 512 AS window_id, max(off) AS off FROM log WHERE k IS NOT NULL AND off IN (SELECT max(off) FROM log l WHERE l.part = log.part AND l.k = log.k) GROUP BY ALL)
SELECT o.part, object_no AS window_id, coalesce(off, last_offset) AS watermark FROM objects o LEFT JOIN kept k ON k.part = o.part AND k.window_id = o.object_no""".replace("off IN (SELECT max(off) FROM log l WHERE l.part = log.part AND l.k = log.k)", "(part, k, off) IN (SELECT part, k, max(off) FROM log GROUP BY part, k)"),
)
def compact_watermarks(spark, d):
    """Windows of one object; of most nothing is left, and the end that they had counts."""
    log = L.records(spark, d)
    kept = compaction.latest_per_key(log, keep_null=False).select("part", F.floor(F.col("off") / L.OBJECT).cast("long").alias("window_id"), "off")
    return compaction.cleaned_up_to(L.objects(L.batches(log)).withColumnRenamed("object_no", "window_id"), kept)


@query("object_sizing", f"WITH {BATCH_SQL} SELECT part, base_offset, coalesce(sum(batch_length) OVER (PARTITION BY part ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096 AS object_no FROM batches".replace("coalesce(sum", "CAST(coalesce(sum").replace("// 4096", "// 4096 AS BIGINT)"))
def object_sizing(spark, d):
    """Batches of each partition into objects of about 4 kB."""
    return ingest.object_numbers(L.batches(L.records(spark, d)), 4096, 256).select("part", "base_offset", "object_no")


@query("flush_due", f"WITH {BATCH_SQL}, p AS (SELECT part, sum(batch_length) AS sealed_bytes, min(base_ts) AS oldest_ms FROM batches WHERE batch_no % 8 = part GROUP BY part) SELECT part, CAST(sealed_bytes AS BIGINT) AS sealed_bytes, oldest_ms, sealed_bytes < (SELECT avg(sealed_bytes) FROM p) AS whole FROM p")
def flush_due(spark, d):
    """Partitions with more sealed bytes than the mean flush these; the others are old enough to flush all."""
    rows = L.batches(L.records(spark, d)).where("batch_no % 8 = part").groupBy("part").agg(F.sum("batch_length").cast("long").alias("sealed_bytes"), F.min("base_ts").alias("oldest_ms"))
    mean = rows.agg(F.avg("sealed_bytes")).first()[0]
    return ingest.flush_due(rows, mean, 1000, 1 << 60)


@query("compact_windowed", f"WITH {LOG_SQL} SELECT part, off // 1024 AS window_id, k, off FROM log QUALIFY k IS NULL OR row_number() OVER (PARTITION BY part, off // 1024, k ORDER BY off DESC) = 1")
def compact_windowed(spark, d):
    log = L.records(spark, d).withColumn("window_id", F.floor(F.col("off") / 1024).cast("long"))
    return compaction.latest_per_key(log, window="window_id").select("part", "window_id", "k", "off")


@query("compact_two_pass", f"WITH {LOG_SQL}, m AS (SELECT part, k, max(off) AS last FROM log WHERE k IS NOT NULL GROUP BY part, k) SELECT part, k, off FROM log LEFT JOIN m USING (part, k) WHERE last IS NULL OR off = last")
def compact_two_pass(spark, d):
    return compaction.two_pass(L.records(spark, d)).select("part", "k", "off")


@query("compact_control", f"WITH {LOG_SQL} SELECT part, k, off, event_id % 50 = 0 AS control FROM log QUALIFY k IS NULL OR event_id % 50 = 0 OR row_number() OVER (PARTITION BY part, k, event_id % 50 = 0 ORDER BY off DESC) = 1")
def compact_control(spark, d):
    log = L.records(spark, d).withColumn("control", F.col("event_id") % 50 == 0)
    return compaction.latest_per_key(log, control="control").select("part", "k", "off", "control")


#: Some objects again as leftovers of a compaction: they end where others already do.
LEFTOVER = "part, object_no, base_offset, last_offset, data_size"
LEFTOVER_SQL = f"{OBJECT_SQL}, stored AS (SELECT {LEFTOVER} FROM objects UNION ALL SELECT part, object_no + 1000, base_offset + 16, last_offset, data_size FROM objects WHERE object_no % 3 = 1)"


def leftovers(objects: DataFrame) -> DataFrame:
    objects = objects.select(*LEFTOVER.split(", "))
    again = objects.where("object_no % 3 = 1").withColumns({"object_no": F.col("object_no") + 1000, "base_offset": F.col("base_offset") + 16})
    return objects.unionByName(again)


@query(
    "compact_orphans",
    f"""WITH {LEFTOVER_SQL} SELECT part, object_no, base_offset, last_offset FROM stored
QUALIFY max(last_offset) OVER (PARTITION BY part ORDER BY base_offset, last_offset DESC, object_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= last_offset""",
)
def compact_orphans(spark, d):
    return compaction.orphans(leftovers(L.objects(L.batches(L.records(spark, d))))).select("part", "object_no", "base_offset", "last_offset")


CLEANED_SQL = f"{OBJECT_SQL}, cleaned AS (SELECT part, CAST(quantile_disc(base_offset, 0.3) - 5 AS BIGINT) AS cleaned_up_to FROM objects GROUP BY part)"


def cleaned_of(objects: DataFrame) -> DataFrame:
    """A compaction watermark: a little before the object at three tenths."""
    return objects.groupBy("part").agg((F.expr("percentile_disc(0.3) WITHIN GROUP (ORDER BY base_offset)") - 5).cast("long").alias("cleaned_up_to"))


@query("dirty_rehydrate", f"WITH {CLEANED_SQL} SELECT part, CAST(count(*) FILTER (WHERE base_offset > cleaned_up_to) AS BIGINT) AS dirty FROM objects JOIN cleaned USING (part) GROUP BY part")
def dirty_rehydrate(spark, d):
    objects = L.objects(L.batches(L.records(spark, d)))
    return compaction.dirty_counts(objects, cleaned_of(objects))


@query(
    "compact_dirtiest",
    f"""WITH {CLEANED_SQL}, c AS (SELECT part, count(*) FILTER (WHERE base_offset > cleaned_up_to) AS dirty FROM objects JOIN cleaned USING (part) GROUP BY part)
SELECT part, CAST(dirty AS BIGINT) AS dirty FROM c WHERE part % 2 = 0 AND (dirty >= 4 OR dirty > 0 AND part <> 2) ORDER BY dirty DESC, part LIMIT 1""",
)
def compact_dirtiest(spark, d):
    objects = L.objects(L.batches(L.records(spark, d)))
    rows = compaction.dirty_counts(objects, cleaned_of(objects)).select(
        "part",
        "dirty",
        F.when(F.col("part") % 2 == 0, "compact,delete").otherwise("delete").alias("policy"),
        (F.col("part") == 2).alias("ever_compacted"),
        F.lit(0).cast("long").alias("last_compacted_ms"),
        F.lit(None).cast("long").alias("max_lag_ms"),
    )
    return compaction.dirtiest(rows, 0, 4).select("part", "dirty")


@query("compact_backoff", "SELECT CAST(i AS BIGINT) AS failures, CAST(CASE WHEN i <= 0 THEN 0 ELSE least(120000.0 * pow(2.0, i - 1), 3600000.0) END AS BIGINT) AS wait_ms FROM range(0, 20) t(i)")
def compact_backoff(spark, d):
    return spark.range(20).select(F.col("id").alias("failures"), compaction.backoff(F.col("id"), 120_000).alias("wait_ms"))


@query(
    "compact_pack",
    f"""WITH RECURSIVE {CLEANED_SQL}, a AS (SELECT part, max(base_offset) AS anchor FROM objects JOIN cleaned USING (part) WHERE base_offset <= cleaned_up_to GROUP BY part),
o AS (SELECT part, base_offset, data_size, row_number() OVER (PARTITION BY part ORDER BY base_offset) AS rn FROM objects LEFT JOIN a USING (part) WHERE anchor IS NULL OR base_offset >= anchor),
p AS (SELECT part, rn, base_offset, CAST(0 AS BIGINT) AS window_id, data_size AS used FROM o WHERE rn = 1
  UNION ALL SELECT o.part, o.rn, o.base_offset, p.window_id + CASE WHEN p.used + o.data_size > 60000 THEN 1 ELSE 0 END, CASE WHEN p.used + o.data_size > 60000 THEN o.data_size ELSE p.used + o.data_size END FROM p JOIN o ON o.part = p.part AND o.rn = p.rn + 1)
SELECT part, base_offset, window_id FROM p QUALIFY count(*) OVER (PARTITION BY part, window_id) > 1""",
)
def compact_pack(spark, d):
    """Windows of at most 60 kB from each anchor on."""
    objects = L.objects(L.batches(L.records(spark, d)))
    return compaction.windows(objects.withColumn("modified_ms", F.col("max_ts")), cleaned_of(objects), 60_000, 1 << 60).select("part", "base_offset", "window_id")


#: Requests for every sixth of each partition, by rule.
REQUEST_SQL = "requests AS (SELECT part * 10 + i AS request_id, part, CAST(hw * i // 6 AS BIGINT) AS off FROM (SELECT part, max(off) + 1 AS hw FROM log GROUP BY part), range(0, 8) t(i))"


def requests_of(spark: SparkSession, batches: DataFrame) -> DataFrame:
    hw = state_of(batches).select("part", "hw")
    return hw.join(F.broadcast(spark.range(8).select(F.col("id").alias("i")))).select((F.col("part") * 10 + F.col("i")).cast("long").alias("request_id"), "part", F.floor(F.col("hw") * F.col("i") / 6).cast("long").alias("off"))


@query(
    "fetch_range",
    f"""WITH {LOG_SQL}, {REQUEST_SQL}, state AS (SELECT part, max(off) + 1 AS hw FROM log GROUP BY part)
SELECT request_id, part, off, CASE WHEN off < 3 OR off > hw THEN 1 ELSE 0 END AS error_code FROM requests JOIN state USING (part)""",
)
def fetch_range(spark, d):
    batches = L.batches(L.records(spark, d))
    state = state_of(batches).withColumn("log_start", F.lit(3).cast("long"))
    return scan.range_check(requests_of(spark, batches), state).select("request_id", "part", "off", "error_code")


@query(
    "fetch_maxbytes",
    f"""WITH {BATCH_SQL}, {REQUEST_SQL}, found AS (
  SELECT request_id, part, base_offset, row_number() OVER w AS rn, sum(batch_length) OVER w AS running FROM requests JOIN batches USING (part) WHERE last_offset >= off
  WINDOW w AS (PARTITION BY request_id ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(request_id AS BIGINT) AS request_id, part, base_offset, CAST(running AS BIGINT) AS running_bytes FROM found WHERE rn = 1 OR running <= 2000""",
)
def fetch_maxbytes(spark, d):
    batches = L.batches(L.records(spark, d))
    wanted = requests_of(spark, batches).withColumn("max_bytes", F.lit(2000))
    return scan.fetch(batches, wanted).select("request_id", "part", "base_offset", "running_bytes")


@query(
    "fetch_response_trim",
    f"""WITH RECURSIVE {BATCH_SQL}, n AS (SELECT batch_no * 4 + part AS n, batch_length AS size FROM batches),
s AS (SELECT n // 8 AS response_id, n % 8 AS seq, size, row_number() OVER (PARTITION BY n // 8 ORDER BY n % 8) AS rn FROM n),
t AS (SELECT response_id, rn, seq, size, size > 0 AS kept, size AS used FROM s WHERE rn = 1
  UNION ALL SELECT s.response_id, s.rn, s.seq, s.size, s.size > 0 AND (t.used = 0 OR t.used + s.size <= 1500), t.used + CASE WHEN s.size > 0 AND (t.used = 0 OR t.used + s.size <= 1500) THEN s.size ELSE 0 END FROM t JOIN s ON s.response_id = t.response_id AND s.rn = t.rn + 1)
SELECT response_id, seq, size FROM t WHERE kept""",
)
def fetch_response_trim(spark, d):
    """Greedy trimming of answers of eight parts each."""
    batches = L.batches(L.records(spark, d))
    sized = batches.select((F.col("batch_no") * 4 + F.col("part")).alias("n"), F.col("batch_length").alias("size")).select(F.floor(F.col("n") / 8).cast("long").alias("response_id"), (F.col("n") % 8).alias("seq"), "size")
    return scan.trim_response(sized, 1500)


RESPONSE_SQL = f"""{BATCH_SQL}, {REQUEST_SQL}, state AS (SELECT part, max(off) + 1 AS hw FROM log GROUP BY part),
wanted AS (SELECT request_id % 10 AS response_id, part AS seq, request_id, part, off FROM requests UNION ALL SELECT i, 9, 90 + i, 9, 0 FROM range(0, 8) t(i)),
coded AS (SELECT w.*, hw, CASE WHEN hw IS NULL THEN 3 WHEN off < 3 OR off > hw THEN 1 ELSE 0 END AS error_code FROM wanted w LEFT JOIN state USING (part)),
found AS (SELECT request_id, batch_length, row_number() OVER w AS rn, sum(batch_length) OVER w AS running FROM coded c JOIN batches b ON b.part = c.part AND last_offset >= off WHERE error_code = 0
  WINDOW w AS (PARTITION BY request_id ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sized AS (SELECT request_id, count(*) AS n, sum(batch_length) AS bytes FROM found WHERE rn = 1 OR running <= 2000 GROUP BY request_id),
s AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes, row_number() OVER (PARTITION BY response_id ORDER BY seq) AS rn FROM coded c LEFT JOIN sized USING (request_id)),
t AS (SELECT response_id, rn, bytes > 0 AS kept, bytes AS used FROM s WHERE rn = 1
  UNION ALL SELECT s.response_id, s.rn, s.bytes > 0 AND (t.used = 0 OR t.used + s.bytes <= 4000), t.used + CASE WHEN s.bytes > 0 AND (t.used = 0 OR t.used + s.bytes <= 4000) THEN s.bytes ELSE 0 END FROM t JOIN s ON s.response_id = t.response_id AND s.rn = t.rn + 1)"""


@query(
    "fetch_response",
    f"""WITH RECURSIVE {RESPONSE_SQL} SELECT CAST(request_id AS BIGINT) AS request_id, part, error_code, coalesce(hw, -1) AS hw, coalesce(hw, -1) AS lso, CAST(CASE WHEN kept THEN n ELSE 0 END AS BIGINT) AS n_batches, CAST(CASE WHEN kept THEN bytes ELSE 0 END AS BIGINT) AS bytes, kept
FROM s JOIN t USING (response_id, rn)""",
)
def fetch_response(spark, d):
    """Requests for five partitions each, one of them unknown, at 2000 bytes a partition and 4000 a response."""
    batches = L.batches(L.records(spark, d))
    state = state_of(batches).withColumns({"log_start": F.lit(3).cast("long"), "lso": F.col("hw")}).select("part", "log_start", "hw", "lso")
    known = requests_of(spark, batches).select((F.col("request_id") % 10).alias("response_id"), F.col("part").alias("seq"), "request_id", "part", "off")
    i = F.col("id")
    unknown = spark.range(8).select(i.alias("response_id"), F.lit(9).alias("seq"), (i + 90).alias("request_id"), F.lit(9).alias("part"), F.lit(0).cast("long").alias("off"))
    return scan.fetch_response(batches, known.unionByName(unknown).withColumn("max_bytes", F.lit(2000)), state, 4000)


GAP = "batch_no % 60 <> 37"


@query(
    "fetch_contiguous",
    f"""WITH {BATCH_SQL}, b AS (SELECT * FROM batches WHERE {GAP}), g AS (SELECT *, CASE WHEN base_offset <> lag(last_offset) OVER (PARTITION BY part ORDER BY base_offset) + 1 THEN 1 ELSE 0 END AS gap FROM b),
i AS (SELECT *, sum(gap) OVER (PARTITION BY part ORDER BY base_offset) AS island FROM g) SELECT part, base_offset, last_offset FROM i WHERE island = 0""",
)
def fetch_contiguous(spark, d):
    return scan.contiguous(L.batches(L.records(spark, d)).where(GAP)).select("part", "base_offset", "last_offset")


@query("hw_contiguous", f"WITH {BATCH_SQL}, b AS (SELECT * FROM batches WHERE {GAP}), g AS (SELECT *, coalesce(max(last_offset + 1) OVER (PARTITION BY part ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM b) SELECT part, coalesce(min(CASE WHEN base_offset > upto THEN upto END), max(last_offset + 1)) AS hw FROM g GROUP BY part")
def hw_contiguous(spark, d):
    return ingest.contiguous_hw(L.batches(L.records(spark, d)).where(GAP))


@query("hw_visible", f"WITH {BATCH_SQL}, s AS (SELECT part, max(last_offset) + 1 - 20 AS hw FROM batches GROUP BY part) SELECT part, base_offset, last_offset FROM batches JOIN s USING (part) WHERE last_offset + 1 <= hw")
def hw_visible(spark, d):
    batches = L.batches(L.records(spark, d))
    return scan.hw_visible(batches, state_of(batches).withColumn("hw", F.col("hw") - 20)).select("part", "base_offset", "last_offset")


@query(
    "tier_union",
    f"""WITH {BATCH_SQL}, t AS (SELECT part, base_offset, last_offset, 0 AS tier FROM batches WHERE batch_no % 4 = 3 UNION ALL SELECT part, base_offset, last_offset, 1 FROM batches WHERE batch_no % 2 = 1 UNION ALL SELECT part, base_offset, last_offset, 2 FROM batches)
SELECT part, base_offset, last_offset, tier FROM t QUALIFY row_number() OVER (PARTITION BY part, base_offset ORDER BY tier) = 1""",
)
def tier_union(spark, d):
    b = L.batches(L.records(spark, d)).select("part", "base_offset", "last_offset", "batch_no")
    return scan.tier_union(b.where("batch_no % 4 = 3"), b.where("batch_no % 2 = 1"), b).select("part", "base_offset", "last_offset", "tier")


@query(
    "object_locate",
    f"""WITH {OBJECT_SQL}, {REQUEST_SQL}, s AS (SELECT part, base_offset, lead(base_offset) OVER w AS next_base, row_number() OVER w = 1 AS f FROM objects WINDOW w AS (PARTITION BY part ORDER BY base_offset))
SELECT CAST(request_id AS BIGINT) AS request_id, part, off, base_offset, next_base FROM requests JOIN s USING (part) WHERE (off >= base_offset OR f) AND (next_base IS NULL OR off < next_base)""",
)
def object_locate(spark, d):
    batches = L.batches(L.records(spark, d))
    return scan.locate_object(L.objects(batches), requests_of(spark, batches)).select("request_id", "part", "off", "base_offset", "next_base")


@query("batch_locate", f"WITH {BATCH_SQL}, {REQUEST_SQL} SELECT CAST(r.request_id AS BIGINT) AS request_id, r.part, r.off, min(b.base_offset) AS base_offset FROM requests r LEFT JOIN batches b ON b.part = r.part AND b.last_offset >= r.off AND {GAP} GROUP BY ALL")
def batch_locate(spark, d):
    batches = L.batches(L.records(spark, d))
    return scan.locate_batch(batches.where(GAP), requests_of(spark, batches)).select("request_id", "part", "off", "base_offset")


@query("latest", f"WITH {BATCH_SQL} SELECT part, max(last_offset) + 1 AS off, CAST(-1 AS BIGINT) AS ts_ms FROM batches GROUP BY part")
def latest(spark, d):
    return state_of(L.batches(L.records(spark, d))).select("part", F.col("hw").alias("off"), F.lit(-1).cast("long").alias("ts_ms"))


@query("earliest", f"WITH {BATCH_SQL} SELECT part, min(base_offset) AS off FROM batches GROUP BY part")
def earliest(spark, d):
    return state_of(L.batches(L.records(spark, d))).select("part", F.col("log_start").alias("off"))


@query("max_timestamp", f"WITH {BATCH_SQL} SELECT part, last_offset AS off, max_ts AS ts_ms FROM batches QUALIFY row_number() OVER (PARTITION BY part ORDER BY max_ts DESC, base_offset DESC) = 1")
def max_timestamp(spark, d):
    return state_of(L.batches(L.records(spark, d))).select("part", F.col("max_ts_offset").alias("off"), F.col("max_ts").alias("ts_ms"))


TIMES_SQL = "times AS (SELECT part, lo + (hi - lo) * i // 10 + 1 AS t FROM (SELECT part, min(ts_ms) AS lo, max(ts_ms) AS hi FROM log GROUP BY part), range(0, 11) r(i))"


@query(
    "ts_lookup",
    f"""WITH {BATCH_SQL}, {TIMES_SQL}, hits AS (SELECT part, t, min_by(base_offset, base_offset) AS o, min_by(max_ts, base_offset) AS m FROM times JOIN batches USING (part) WHERE max_ts >= t GROUP BY ALL)
SELECT part, t, coalesce(o, -1) AS found_offset, coalesce(m, -1) AS found_ts FROM times LEFT JOIN hits USING (part, t)""",
)
def ts_lookup(spark, d):
    batches = L.batches(L.records(spark, d))
    span = batches.groupBy("part").agg(F.min("base_ts").alias("lo"), F.max("max_ts").alias("hi"))
    t = F.floor((F.col("hi") - F.col("lo")) * F.col("id") / 10) + F.col("lo") + 1
    return lookup.offset_for_time(batches, span.join(F.broadcast(spark.range(11))).select("part", t.cast("long").alias("t")))


@query(
    "list_offsets",
    f"""WITH {BATCH_SQL}, {TIMES_SQL}, state AS (SELECT part, min(base_offset) AS log_start, max(last_offset) + 1 AS hw, max(max_ts) AS max_ts, max_by(last_offset, (max_ts, base_offset)) AS max_off FROM batches GROUP BY part),
r AS (SELECT CAST(p AS INT) AS part, t, c AS committed FROM range(0, 6) a(p), (VALUES (-1), (-2), (-3)) b(t), (VALUES (true), (false)) x(c) UNION ALL SELECT part, t, false FROM times),
hits AS (SELECT part, t, min_by(base_offset, base_offset) AS o, min_by(max_ts, base_offset) AS m FROM times JOIN batches USING (part) WHERE max_ts >= t GROUP BY ALL)
SELECT r.part, CAST(r.t AS BIGINT) AS t, committed, CASE WHEN hw IS NULL THEN 3 ELSE 0 END AS error_code,
  CAST(CASE WHEN hw IS NULL THEN -1 WHEN r.t = -1 THEN CASE WHEN committed THEN hw - 7 ELSE hw END WHEN r.t = -2 THEN log_start WHEN r.t = -3 THEN max_off ELSE coalesce(o, -1) END AS BIGINT) AS off,
  CAST(CASE WHEN hw IS NULL THEN -1 WHEN r.t = -3 THEN state.max_ts WHEN r.t >= 0 THEN coalesce(m, -1) ELSE -1 END AS BIGINT) AS ts_ms
FROM r LEFT JOIN state USING (part) LEFT JOIN hits h ON h.part = r.part AND h.t = r.t""",
)
def list_offsets(spark, d):
    batches = L.batches(L.records(spark, d))
    state = state_of(batches).withColumn("lso", F.col("hw") - 7)
    span = batches.groupBy("part").agg(F.min("base_ts").alias("lo"), F.max("max_ts").alias("hi"))
    t = F.floor((F.col("hi") - F.col("lo")) * F.col("id") / 10) + F.col("lo") + 1
    timed = span.join(F.broadcast(spark.range(11))).select("part", t.cast("long").alias("t"), F.lit(False).alias("committed"))
    special = spark.createDataFrame([(p, t, c) for p in range(6) for t in (-1, -2, -3) for c in (True, False)], "part int, t long, committed boolean")
    return lookup.list_offsets(batches, state, special.unionByName(timed))


@query("footer_stats", f"WITH {OBJECT_SQL} SELECT part, object_no, base_offset, last_offset, max_ts, data_size, record_count, batch_count FROM objects")
def footer_stats(spark, d):
    return L.objects(L.batches(L.records(spark, d))).select("part", "object_no", "base_offset", "last_offset", "max_ts", "data_size", "record_count", "batch_count")


@query("batch_count", f"WITH {BATCH_SQL} SELECT part, CAST(count(*) FILTER (WHERE last_offset >= 100) AS BIGINT) AS n FROM batches GROUP BY part")
def batch_count(spark, d):
    return L.batches(L.records(spark, d)).groupBy("part").agg(F.count_if(F.col("last_offset") >= 100).alias("n"))


@query("log_size", f"WITH {BATCH_SQL} SELECT part, CAST(sum(batch_length) AS BIGINT) AS total_bytes FROM batches GROUP BY part")
def log_size(spark, d):
    return state_of(L.batches(L.records(spark, d))).select("part", "total_bytes")


@query(
    "epoch_end",
    f"""WITH {BATCH_SQL}, s AS (SELECT part, max(last_offset) + 1 AS hw FROM batches GROUP BY part), r AS (SELECT CAST(p AS INT) AS part, CAST(e AS INT) AS epoch, CAST(c AS INT) AS current_epoch FROM range(0, 6) a(p), range(-1, 2) b(e), range(-1, 2) x(c))
SELECT part, epoch, current_epoch, CASE WHEN hw IS NULL THEN 3 WHEN current_epoch > 0 THEN 75 ELSE 0 END AS error_code,
  CASE WHEN hw IS NOT NULL AND current_epoch <= 0 AND epoch <= 0 THEN 0 ELSE -1 END AS end_epoch, CASE WHEN hw IS NOT NULL AND current_epoch <= 0 AND epoch <= 0 THEN hw ELSE -1 END AS end_offset FROM r LEFT JOIN s USING (part)""",
)
def epoch_end(spark, d):
    rows = [(p, e, c) for p in range(6) for e in (-1, 0, 1) for c in (-1, 0, 1)]
    return lookup.epoch_end(state_of(L.batches(L.records(spark, d))), spark.createDataFrame(rows, "part int, epoch int, current_epoch int"))


@query("object_counts", f"WITH {OBJECT_SQL} SELECT part, CAST(sum(record_count) AS BIGINT) AS n FROM objects GROUP BY ROLLUP (part)")
def object_counts(spark, d):
    return L.objects(L.batches(L.records(spark, d))).rollup("part").agg(F.sum("record_count").alias("n"))


@query("hw_discovery", f"WITH {OBJECT_SQL}, p AS (SELECT CAST(i AS INT) AS part FROM range(0, 6) t(i)) SELECT p.part, coalesce(max(last_offset) + 1, 0) AS hw FROM p LEFT JOIN objects USING (part) GROUP BY p.part")
def hw_discovery(spark, d):
    objects = L.objects(L.batches(L.records(spark, d)))
    return spark.range(6).select(F.col("id").cast("int").alias("part")).join(objects, "part", "left").groupBy("part").agg(F.coalesce(F.max("last_offset") + 1, F.lit(0)).alias("hw"))


UNFLUSHED_SQL = f"{BATCH_SQL}, m AS (SELECT part, max(last_offset) - 100 * (part + 1) AS wm FROM batches GROUP BY part), u AS (SELECT part, CAST(sum(batch_length) AS BIGINT) AS bytes, min(batch_no) AS first_seq, max(last_offset) AS max_offset FROM batches JOIN m USING (part) WHERE last_offset >= wm GROUP BY part)"


def pending(spark, d):
    batches = L.batches(L.records(spark, d))
    marks = state_of(batches).select("part", (F.col("hw") - 1 - 100 * (F.col("part") + 1)).alias("wm"))
    return lookup.unflushed(batches, marks)


@query("unflushed", f"WITH {UNFLUSHED_SQL} SELECT * FROM u")
def unflushed(spark, d):
    return pending(spark, d)


@query("flush_watermark", f"WITH {UNFLUSHED_SQL} SELECT CAST(coalesce(min(first_seq), 0) AS BIGINT) AS watermark FROM u")
def flush_watermark(spark, d):
    return lookup.global_watermark(pending(spark, d), 0)


#: Limits by which about half of the objects go.
MARKED_SQL = f"""{OBJECT_SQL}, present AS (SELECT max(ts_ms) AS now_ms FROM log), marked AS (
  SELECT o.*, max_ts >= 0 AND max_ts < now_ms - 1209600000 AS by_time,
    sum(data_size) OVER (PARTITION BY part ORDER BY base_offset DESC) > 35000 AND base_offset <> max(base_offset) OVER (PARTITION BY part) AS by_size, count(*) OVER (PARTITION BY part) AS n
  FROM objects o, present
), done AS (
  SELECT *, (by_time OR by_size) AND sum(CASE WHEN by_time OR by_size THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY base_offset) <= n - 1 AS expired FROM marked
)"""


def marked(spark, d):
    log = L.records(spark, d)
    objects, now = with_now(L.objects(L.batches(log)), log)
    return retention.mark_expired(objects, now, 1_209_600_000, 35_000)


@query("ret_time", f"WITH {MARKED_SQL} SELECT part, object_no FROM done WHERE by_time")
def ret_time(spark, d):
    return marked(spark, d).where("by_time").select("part", "object_no")


@query("ret_size", f"WITH {MARKED_SQL} SELECT part, object_no FROM done WHERE by_size")
def ret_size(spark, d):
    return marked(spark, d).where("by_size").select("part", "object_no")


@query("ret_union", f"WITH {MARKED_SQL} SELECT part, object_no, by_time, by_size, expired FROM done")
def ret_union(spark, d):
    return marked(spark, d).select("part", "object_no", "by_time", "by_size", "expired")


@query("log_start", f"WITH {MARKED_SQL} SELECT part, min(base_offset) AS log_start FROM done WHERE NOT expired GROUP BY part")
def log_start(spark, d):
    return retention.new_log_start(marked(spark, d))


@query("ret_configs", "SELECT CAST(i AS BIGINT) AS id, CASE i % 4 WHEN 0 THEN 604800000 WHEN 1 THEN 1000 * i WHEN 2 THEN 604800000 ELSE -1 END AS retention_ms FROM range(0, 12) t(i)")
def ret_configs(spark, d):
    value = F.when(F.col("id") % 4 == 1, (F.col("id") * 1000).cast("string")).when(F.col("id") % 4 == 2, "a week").when(F.col("id") % 4 == 3, "-1")
    configs = F.when(value.isNull(), F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("retention.ms"), value))
    return spark.range(12).select("id", retention.config_long(configs, "retention.ms", retention.WEEK_MS).cast("long").alias("retention_ms"))


@query(
    "delete_records",
    f"""WITH {BATCH_SQL}, s AS (SELECT part, 10 AS log_start, max(last_offset) + 1 AS hw FROM batches GROUP BY part), r AS (SELECT CAST(p AS INT) AS part, CAST(o AS BIGINT) AS off FROM range(0, 5) a(p), (VALUES (-1), (5), (50), (100000000)) b(o)),
t AS (SELECT part, off, log_start, hw, CASE WHEN off = -1 THEN hw ELSE off END AS target FROM r LEFT JOIN s USING (part))
SELECT part, off, CASE WHEN hw IS NULL THEN 3 WHEN target < log_start OR target > hw THEN 1 ELSE 0 END AS error_code,
  CAST(CASE WHEN hw IS NULL THEN NULL WHEN target < log_start OR target > hw THEN log_start ELSE greatest(log_start, target) END AS BIGINT) AS new_log_start FROM t""",
)
def delete_records(spark, d):
    state = state_of(L.batches(L.records(spark, d))).withColumn("log_start", F.lit(10).cast("long"))
    rows = [(p, o) for p in range(5) for o in (-1, 5, 50, 100_000_000)]
    return retention.delete_records(state, spark.createDataFrame(rows, "part int, off long"))


@query(
    "topic_gc",
    """WITH t AS (SELECT DISTINCT event_type AS name, md5(event_type) AS topic_id FROM events), live AS (SELECT * FROM t WHERE name <> 'view'), gone AS (SELECT name, md5(name || '0') AS topic_id FROM t)
SELECT name, topic_id FROM (SELECT * FROM gone WHERE name < 'e' UNION SELECT * FROM t UNION SELECT * FROM gone) EXCEPT SELECT * FROM live""",
)
def topic_gc(spark, d):
    topics = L.table(spark, d, "events").select(F.col("event_type").alias("name")).distinct().withColumn("topic_id", F.md5("name"))
    gone = topics.withColumn("topic_id", F.md5(F.concat("name", F.lit("0"))))
    return retention.garbage(gone.where("name < 'e'"), topics.union(gone), topics.where("name <> 'view'"))


@query(
    "orders_latest",
    """SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, any_value(c_mktsegment) AS segment, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey""",
)
def orders_latest(spark, d):
    """A second topic: the latest order of each customer, with the customer's segment."""
    latest_ = L.table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count(F.lit(1)).alias("n"))
    who = L.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return latest_.join(who, "o_custkey").select("o_custkey", "o_orderkey", "segment", "n")


@query("lineitem_compact", "SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) // 1000 AS ts_ms FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) = 1")
def lineitem_compact(spark, d):
    """The volume topic compacted by order: one aggregation."""
    rows = L.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"))
    last = rows.groupBy("l_orderkey").agg(F.max(F.struct("ts_ms", "l_linenumber", "l_partkey")).alias("x"))
    return last.select("l_orderkey", "x.l_linenumber", "x.l_partkey", "x.ts_ms")


@query("lso", f"WITH {TXN_SQL}, s AS (SELECT part, max(last_offset) + 1 AS hw FROM batches GROUP BY part), o AS (SELECT part, min(first_offset) AS f FROM txns WHERE outcome = 'open' GROUP BY part) SELECT part, hw, least(hw, coalesce(f, hw)) AS lso FROM s LEFT JOIN o USING (part)")
def lso(spark, d):
    log = L.records(spark, d)
    return lookup.stable_offsets(state_of(L.batches(log)), L.transactions(log)).select("part", "hw", "lso")


STABLE_SQL = f"{TXN_SQL}, state AS (SELECT b.part, least(max(b.last_offset) + 1, coalesce((SELECT min(first_offset) FROM txns t WHERE t.part = b.part AND outcome = 'open'), 1152921504606846976)) AS lso FROM batches b GROUP BY b.part)"


@query("latest_committed", f"WITH {STABLE_SQL} SELECT part, CAST(lso AS BIGINT) AS off FROM state")
def latest_committed(spark, d):
    log = L.records(spark, d)
    return lookup.stable_offsets(state_of(L.batches(log)), L.transactions(log)).select("part", F.col("lso").alias("off"))


@query("fetch_below_lso", f"WITH {STABLE_SQL} SELECT part, base_offset FROM batches JOIN state USING (part) WHERE base_offset < lso")
def fetch_below_lso(spark, d):
    log = L.records(spark, d)
    batches = L.batches(log)
    return scan.below_lso(batches, lookup.stable_offsets(state_of(batches), L.transactions(log))).select("part", "base_offset")


@query(
    "read_committed",
    f"""WITH {STABLE_SQL} SELECT l.part, l.off, l.producer_id FROM log l JOIN state s USING (part) WHERE l.off < s.lso
AND NOT EXISTS (SELECT 1 FROM txns t WHERE t.outcome = 'abort' AND t.part = l.part AND t.producer_id = l.producer_id AND l.off BETWEEN t.first_offset AND t.last_offset)""",
)
def read_committed(spark, d):
    log = L.records(spark, d)
    txns = L.transactions(log)
    return scan.read_committed(log, txns, lookup.stable_offsets(state_of(L.batches(log)), txns)).select("part", "off", "producer_id")


@query("aborted_overlap", f"WITH {TXN_SQL}, {REQUEST_SQL} SELECT CAST(request_id AS BIGINT) AS request_id, part, producer_id, first_offset, last_offset FROM requests JOIN txns USING (part) WHERE outcome = 'abort' AND last_offset >= off AND first_offset < off + 200")
def aborted_overlap(spark, d):
    log = L.records(spark, d)
    wanted = requests_of(spark, L.batches(log)).withColumn("until", F.col("off") + 200)
    return scan.aborted_overlap(L.transactions(log), wanted).select("request_id", "part", "producer_id", "first_offset", "last_offset")


def as_objects(spark, d, codec: int) -> DataFrame:
    return object_files.encoded(L.records(spark, d), "events", "0" * 32, codec=codec)


@query("object_records", f"WITH {LOG_SQL} SELECT part, off, ts_ms, k, v, off // 16 * 16 AS base_offset, 'zstd' AS codec, CAST(NULL AS VARCHAR) AS error FROM log")
def object_records(spark, d):
    """The log written as object files of compressed batches, and read back."""
    back = object_files.decoded(as_objects(spark, d, 4))
    return back.select("part", "off", "ts_ms", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), "base_offset", "codec", "error")


@query("object_footers", f"WITH {BATCH_SQL} SELECT part, base_offset, last_offset, max_ts, CAST(num_records AS INT) AS num_records FROM batches")
def object_footers(spark, d):
    return object_files.footers(as_objects(spark, d, 1)).select("part", "base_offset", "last_offset", "max_ts", "num_records")


@query(
    "object_damage",
    f"""WITH {LOG_SQL}, d AS (SELECT *, off // 512 % 2 = 1 AND off % 512 < 16 AS bad FROM log)
SELECT part, off, off // 16 * 16 AS base_offset, false AS bad FROM d WHERE NOT bad UNION ALL SELECT part, NULL, off // 16 * 16, true FROM d WHERE bad GROUP BY part, off // 16""",
)
def object_damage(spark, d):
    """Every other object with a damaged first batch: that one is told, the rest is read."""
    files = as_objects(spark, d, 1)
    odd = F.floor(F.regexp_extract("path", r"(\d+)\.obj$", 1).cast("long") / L.OBJECT) % 2 == 1
    hurt = F.overlay("content", F.lit(b"\xde\xad\xbe\xef\xde\xad\xbe\xef"), F.lit(66))
    back = object_files.decoded(files.withColumn("content", F.when(odd, hurt).otherwise(F.col("content"))))
    return back.select("part", "off", "base_offset", F.col("error").isNotNull().alias("bad"))
