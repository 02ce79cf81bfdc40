"""Queries on ingest, transactions, consumer groups, the catalog and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes_ as B
from ..operators import catalog, groups, ingest, lookup, membership, retention, telemetry, txn
from ..sources import event_log as L
from ..sources.event_log import BATCH_SQL, COMMIT_SQL, LOG_SQL, TXN_SQL
from .log_queries import state_of, with_now
from .registry import query

# Ingest


def raw_batches(spark, d) -> DataFrame:
    """Batches as sent, some damaged by rule."""
    b = L.batches(L.records(spark, d))
    raw = F.when(F.col("batch_no") % 17 == 4, 40).otherwise(F.col("batch_length"))
    return b.select(
        F.when(F.col("batch_no") % 13 == 7, F.col("part") + 10).otherwise(F.col("part")).alias("part"),
        "batch_no",
        F.lit(4).alias("n_parts"),
        raw.alias("raw_length"),
        (raw - 12 + F.when(F.col("batch_no") % 7 == 3, 1).otherwise(0)).alias("declared_length"),
        F.when(F.col("batch_no") % 11 == 5, 1).otherwise(2).alias("magic"),
    )


@query(
    "validate",
    f"""WITH {BATCH_SQL}, raw AS (SELECT CASE WHEN batch_no % 13 = 7 THEN part + 10 ELSE part END AS part, batch_no, CASE WHEN batch_no % 17 = 4 THEN 40 ELSE batch_length END AS n FROM batches)
SELECT part, batch_no, CASE WHEN part >= 4 THEN 3 WHEN n < 61 THEN 2 WHEN batch_no % 7 = 3 THEN 2 WHEN batch_no % 11 = 5 THEN 43 WHEN n > 300 THEN 10 ELSE 0 END AS error_code FROM raw""",
)
def validate(spark: SparkSession, d: str) -> DataFrame:
    return ingest.validate(raw_batches(spark, d), 300).select("part", "batch_no", "error_code")


@query("append_time", f"WITH {LOG_SQL} SELECT part, off, CASE WHEN part % 2 = 1 THEN (SELECT max(ts_ms) FROM log) ELSE ts_ms END AS ts_ms FROM log")
def append_time(spark, d):
    log = L.records(spark, d)
    rows, now = with_now(log, log)
    return ingest.append_time(rows, now, F.col("part") % 2 == 1).select("part", "off", "ts_ms")


@query("offsets_after", f"WITH {BATCH_SQL} SELECT part, batch_no, CAST(coalesce(sum(num_records) OVER (PARTITION BY part ORDER BY batch_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN part < 2 THEN 1000 ELSE 0 END AS BIGINT) AS new_base FROM batches")
def offsets_after(spark, d):
    """Batches appended in reverse to partitions that partly hold a log already."""
    b = L.batches(L.records(spark, d)).withColumn("arrival", -F.col("batch_no"))
    prior = spark.createDataFrame([(0, 1000), (1, 1000)], "part int, hw long")
    out = ingest.assign_offsets(b.drop("base_offset"), ["part"], ["arrival"], F.col("num_records"), F.floor(F.col("arrival") / 64), prior)
    return out.select("part", "batch_no", F.col("base_offset").alias("new_base"))


SEND_SQL = f"""{LOG_SQL}, seqs AS (SELECT *, row_number() OVER (PARTITION BY part, producer_id ORDER BY off) - 1 AS seq FROM log),
sends AS (SELECT part, producer_id, seq, event_id * 2 AS arrival, off, event_id FROM seqs UNION ALL SELECT part, producer_id, seq, event_id * 2 + 1, off, event_id FROM seqs WHERE event_id % 10 = 0)"""


@query("dedup_simple", f"WITH {SEND_SQL} SELECT part, producer_id, CAST(seq AS BIGINT) AS seq, min_by(off, arrival) AS off, count(*) AS n_sends FROM sends GROUP BY part, producer_id, seq")
def dedup_simple(spark, d):
    return ingest.first_sends(L.sends(L.records(spark, d)))


@query(
    "dedup_status",
    f"""WITH {SEND_SQL}, lost AS (SELECT * FROM sends WHERE event_id % 97 <> 5), e AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY part, producer_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS expected FROM lost)
SELECT part, CASE WHEN seq = expected THEN 'accepted' WHEN seq < expected THEN 'duplicate' ELSE 'gap' END AS status, count(*) AS n FROM e GROUP BY ALL""",
)
def dedup_status(spark, d):
    sent = L.sends(L.records(spark, d)).where("event_id % 97 <> 5")
    return ingest.classify_sends(sent).groupBy("part", "status").agg(F.count(F.lit(1)).alias("n"))


def sequenced(log: DataFrame) -> DataFrame:
    return L.sends(log).select("part", "producer_id", F.lit(0).alias("epoch"), "seq", F.lit(1).alias("n"), "arrival", "off")


@query("dedup_exact", f"WITH {SEND_SQL} SELECT part, producer_id, CAST(seq AS BIGINT) AS seq, arrival, 0 AS error_code, min(off) OVER (PARTITION BY part, producer_id, seq) AS result_offset, arrival % 2 = 1 AS duplicate FROM sends")
def dedup_exact(spark, d):
    """The sequence window; the resends of this log come right behind the first sends, so all are in the window."""
    return ingest.dedup_exact(sequenced(L.records(spark, d))).select("part", "producer_id", "seq", "arrival", "error_code", "result_offset", "duplicate")


EPOCH_SQL = f"""{LOG_SQL}, half AS (SELECT max(event_id) // 2 AS h FROM log), e AS (SELECT part, producer_id // 4 AS producer_id, CASE WHEN event_id >= h THEN 1 ELSE 0 END AS epoch, event_id, off FROM log, half),
q AS (SELECT *, row_number() OVER (PARTITION BY part, producer_id, epoch ORDER BY event_id) - 1 AS seq FROM e)"""


def epoch_sends(log: DataFrame) -> DataFrame:
    """Two producers over all partitions, whose epoch rises halfway; with resends, stale epochs and gaps behind some batches."""
    half = log.agg(F.floor(F.max("event_id") / 2).alias("h"))  # one row
    rows = log.join(F.broadcast(half)).select("part", F.floor(F.col("producer_id") / 4).alias("producer_id"), F.when(F.col("event_id") >= F.col("h"), 1).otherwise(0).alias("epoch"), "event_id", "off")
    seq = F.row_number().over(Window.partitionBy("part", "producer_id", "epoch").orderBy("event_id")) - 1
    rows = rows.withColumns({"seq": seq.cast("long"), "n": F.lit(1), "arrival": F.col("event_id") * 4})
    id_ = F.col("event_id")
    again = rows.where(id_ % 10 == 0).withColumn("arrival", id_ * 4 + 1)
    stale = rows.where((id_ % 20 == 0) & (F.col("epoch") == 1)).withColumns({"arrival": id_ * 4 + 2, "epoch": F.lit(0), "seq": F.lit(0).cast("long")})
    gap = rows.where(id_ % 33 == 0).withColumns({"arrival": id_ * 4 + 3, "seq": F.col("seq") + 7})
    return rows.unionByName(again).unionByName(stale).unionByName(gap).select("part", "producer_id", "epoch", "seq", "n", "arrival", "off")


@query(
    "dedup_epochs",
    f"""WITH {EPOCH_SQL} SELECT part, producer_id, epoch, event_id * 4 AS arrival, 0 AS error_code, off AS result_offset, false AS duplicate FROM q
UNION ALL SELECT part, producer_id, epoch, event_id * 4 + 1, 0, off, true FROM q WHERE event_id % 10 = 0
UNION ALL SELECT part, producer_id, 0, event_id * 4 + 2, 90, -1, false FROM q WHERE event_id % 20 = 0 AND epoch = 1
UNION ALL SELECT part, producer_id, epoch, event_id * 4 + 3, 45, -1, false FROM q WHERE event_id % 33 = 0""",
)
def dedup_epochs(spark, d):
    return ingest.dedup_exact(epoch_sends(L.records(spark, d))).select("part", "producer_id", "epoch", "arrival", "error_code", "result_offset", "duplicate")


@query(
    "produce",
    f"""WITH {SEND_SQL}, good AS (SELECT part, arrival * 2 AS arrival, arrival AS sent FROM sends WHERE arrival % 2 = 0 UNION ALL SELECT part, event_id * 4 + 3, NULL FROM log WHERE event_id % 15 = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY arrival) - 1 + CASE WHEN part < 2 THEN 1000 ELSE 0 END AS base_offset FROM good)
SELECT part, CAST(arrival AS BIGINT) AS arrival, 0 AS error_code, CAST(base_offset AS BIGINT) AS base_offset, false AS duplicate FROM placed
UNION ALL SELECT s.part, s.arrival * 2, 0, p.base_offset, true FROM sends s JOIN placed p ON p.part = s.part AND p.sent = s.arrival - 1 WHERE s.arrival % 2 = 1
UNION ALL SELECT part, event_id * 4 + 1, 2, -1, false FROM log WHERE event_id % 9 = 4""",
)
def produce(spark, d):
    """Batches of one record: sends and resends, batches without a producer, and damaged ones, appended to logs that partly exist."""
    log = L.records(spark, d)
    size = {"n_parts": F.lit(4), "raw_length": F.lit(100), "declared_length": F.lit(88), "magic": F.lit(2), "epoch": F.lit(0), "n": F.lit(1)}
    sent = L.sends(log).withColumn("arrival", F.col("arrival") * 2)
    none = {"producer_id": F.lit(-1).cast("long"), "seq": F.lit(-1).cast("long")}
    plain = log.where("event_id % 15 = 1").withColumns({**none, "arrival": F.col("event_id") * 4 + 3})
    hurt = log.where("event_id % 9 = 4").withColumns({**none, "arrival": F.col("event_id") * 4 + 1})
    columns = ["part", "producer_id", "seq", "arrival"]
    batches = sent.select(*columns).unionByName(plain.select(*columns)).withColumns(size).unionByName(hurt.select(*columns).withColumns({**size, "raw_length": F.lit(40)}))
    prior = spark.createDataFrame([(0, 1000), (1, 1000)], "part int, hw long")
    return ingest.append(batches, 300, prior)


@query("append_batches", f"WITH {BATCH_SQL}, n AS (SELECT max(ts_ms) AS now_ms FROM log) SELECT part, batch_no, CASE WHEN part % 2 = 1 THEN now_ms ELSE base_ts END AS base_ts, CASE WHEN part % 2 = 1 THEN now_ms ELSE max_ts END AS max_ts, CASE WHEN part % 2 = 1 THEN 12 ELSE 4 END AS attributes FROM batches, n")
def append_batches(spark, d):
    """Odd partitions take the broker's time: both times of a batch, and the bit that says so."""
    log = L.records(spark, d)
    rows, now = with_now(L.batches(log).withColumn("attributes", F.lit(4)), log)
    return ingest.stamp_batches(rows, now, F.col("part") % 2 == 1).select("part", "batch_no", "base_ts", "max_ts", "attributes")


@query("new_topics", "SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN ('view', 'click')")
def new_topics(spark, d):
    return ingest.new_topics(L.table(spark, d, "events").select(F.col("event_type").alias("name")), spark.createDataFrame([("view",), ("click",)], "name string"))


@query("partition_spread", f"WITH {LOG_SQL} SELECT CAST(CAST('0x' || left(md5(k), 8) AS BIGINT) % 8 AS INT) AS target, count(DISTINCT k) AS n_keys FROM log WHERE k IS NOT NULL GROUP BY ALL")
def partition_spread(spark, d):
    """Keys over partitions by hash."""
    return L.records(spark, d).where("k IS NOT NULL").groupBy(ingest.partition_of(F.col("k"), 8).alias("target")).agg(F.count_distinct("k").alias("n_keys"))


# Transactions


@query("txn_ranges", f"WITH {TXN_SQL} SELECT part, producer_id, first_offset, last_offset, outcome FROM txns")
def txn_ranges(spark, d):
    return L.transactions(L.records(spark, d)).select("part", "producer_id", "first_offset", "last_offset", "outcome")


@query(
    "txn_from_markers",
    f"""WITH {LOG_SQL}, c AS (SELECT part, producer_id, off, CASE WHEN event_id % 40 = 7 THEN CASE WHEN event_id % 3 = 0 THEN 'abort' ELSE 'commit' END END AS control FROM log),
t AS (SELECT *, coalesce(sum(CASE WHEN control IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY part, producer_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn FROM c)
SELECT part, producer_id, min(off) FILTER (WHERE control IS NULL) AS first_offset, max(off) AS last_offset, coalesce(max(control), 'open') AS outcome FROM t GROUP BY part, producer_id, txn HAVING min(off) FILTER (WHERE control IS NULL) IS NOT NULL""",
)
def txn_from_markers(spark, d):
    control = F.when(F.col("event_id") % 40 == 7, F.when(F.col("event_id") % 3 == 0, "abort").otherwise("commit"))
    return txn.ranges_from_markers(L.records(spark, d).select("part", "producer_id", "off", control.alias("control")))


@query("txn_recovered", f"WITH {TXN_SQL} SELECT part, producer_id, txn_no, CASE outcome WHEN 'open' THEN 'abort' ELSE outcome END AS outcome FROM txns")
def txn_recovered(spark, d):
    return txn.recovered(L.transactions(L.records(spark, d))).select("part", "producer_id", "txn_no", "outcome")


@query("txn_timeout", f"WITH {TXN_SQL} SELECT part, producer_id, txn_no FROM txns WHERE outcome = 'open' AND (SELECT max(ts_ms) FROM log) > first_ts + 3600000 * (part + 1)")
def txn_timeout(spark, d):
    log = L.records(spark, d)
    txns, now = with_now(L.transactions(log).withColumns({"start_ms": F.col("first_ts"), "timeout_ms": (F.col("part") + 1) * 3_600_000}), log)
    return txn.timed_out(txns, now).select("part", "producer_id", "txn_no")


def named_txns(log: DataFrame) -> DataFrame:
    state = F.when(F.col("outcome") == "open", "Ongoing").when(F.col("outcome") == "abort", "Empty").otherwise("CompleteCommit")
    return L.transactions(log).select(F.concat(F.lit("t"), F.col("producer_id").cast("string"), F.lit("-"), F.col("txn_no").cast("string")).alias("txn_id"), "producer_id", "part", state.alias("state"))


NAMED_SQL = f"{TXN_SQL}, named AS (SELECT 't' || producer_id || '-' || txn_no AS txn_id, producer_id, part, CASE outcome WHEN 'open' THEN 'Ongoing' WHEN 'abort' THEN 'Empty' ELSE 'CompleteCommit' END AS state FROM txns)"


@query("list_txn", f"WITH {NAMED_SQL} SELECT DISTINCT txn_id, producer_id, state FROM named WHERE state IN ('Ongoing', 'Empty') AND producer_id IN (1, 2, 7)")
def list_txn(spark, d):
    return txn.list_transactions(named_txns(L.records(spark, d)), ["Ongoing", "Empty"], [1, 2, 7]).select("txn_id", "producer_id", "state").distinct()


@query(
    "describe_txn",
    f"""WITH {NAMED_SQL}, last AS (SELECT txn_id, producer_id, max(state) AS state FROM named GROUP BY ALL), wanted AS (SELECT DISTINCT txn_id FROM named WHERE producer_id >= 6 UNION SELECT 'none')
SELECT txn_id, CASE WHEN l.state IS NULL THEN 105 ELSE 0 END AS error_code, producer_id, l.state, CASE WHEN l.state = 'Ongoing' THEN (SELECT string_agg(DISTINCT CAST(part AS VARCHAR), ',' ORDER BY CAST(part AS VARCHAR)) FROM named n WHERE n.txn_id = wanted.txn_id) END AS parts
FROM wanted LEFT JOIN last l USING (txn_id)""",
)
def describe_txn(spark, d):
    named = named_txns(L.records(spark, d))
    last = named.groupBy("txn_id", "producer_id").agg(F.max("state").alias("state"))
    wanted = named.where("producer_id >= 6").select("txn_id").distinct().union(spark.createDataFrame([("none",)], "txn_id string"))
    return txn.describe_transactions(wanted, last, named).withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


@query("describe_producers", f"WITH {TXN_SQL}, s AS (SELECT part, producer_id, count(*) - 1 AS last_seq FROM log GROUP BY ALL), o AS (SELECT part, producer_id, min(first_offset) AS f FROM txns WHERE outcome = 'open' GROUP BY ALL) SELECT part, producer_id, last_seq, coalesce(f, -1) AS txn_start FROM s LEFT JOIN o USING (part, producer_id)")
def describe_producers(spark, d):
    log = L.records(spark, d)
    return txn.describe_producers(L.sends(log), L.transactions(log))


STAGED_SQL = f"{TXN_SQL}, staged AS (SELECT producer_id, txn_no, 'g' || (event_id % 3) AS grp, part, off AS committed, event_id AS commit_seq FROM ranked)"


@query("txn_offsets", f"WITH {STAGED_SQL} SELECT grp, part, max_by(committed, commit_seq) AS committed FROM staged SEMI JOIN (SELECT producer_id, txn_no FROM txns WHERE outcome = 'commit') USING (producer_id, txn_no) GROUP BY grp, part")
def txn_offsets(spark, d):
    log = L.records(spark, d)
    txns = L.transactions(log)
    member = log.join(txns.select("part", "producer_id", "txn_no", "first_offset", "last_offset"), ["part", "producer_id"]).where(F.col("off").between(F.col("first_offset"), F.col("last_offset")))
    staged = member.select("producer_id", "txn_no", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("grp"), "part", F.col("off").alias("committed"), F.col("event_id").alias("commit_seq"))
    return txn.visible_txn_offsets(staged, txns)


INIT_SQL = "req AS (SELECT event_id AS seq, CASE WHEN event_type <> 'view' THEN 'txn-' || (user_id % 50) END AS txn_id FROM events)"


@query(
    "init_producers",
    f"""WITH {INIT_SQL}, n AS (SELECT *, coalesce(txn_id, '#' || seq) AS who, CASE WHEN txn_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY txn_id ORDER BY seq) - 1 END AS nth FROM req),
f AS (SELECT who, nth // 32768 AS era, row_number() OVER (ORDER BY seq) - 1 AS pid FROM n WHERE nth % 32768 = 0)
SELECT n.seq, n.txn_id, CAST(f.pid AS BIGINT) AS producer_id, CAST(n.nth % 32768 AS INT) AS epoch FROM n JOIN f ON f.who = n.who AND f.era = n.nth // 32768""",
)
def init_producers(spark, d):
    e = L.table(spark, d, "events")
    return txn.init_producers(e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.concat(F.lit("txn-"), (F.col("user_id") % 50).cast("string"))).alias("txn_id")))


#: Producers 0 to 49 of epoch 2 in all three states; requests of every event.
END_SQL = """p AS (SELECT i AS producer_id, 2 AS epoch, CASE i % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'Ongoing' ELSE 'Ending' END AS state, i % 2 = 0 AS ending, i % 4 < 2 AS last FROM range(0, 50) t(i)),
r AS (SELECT event_id, user_id % 60 AS producer_id, event_id % 4 AS epoch, event_id % 3 = 0 AS commit, event_id % 5 <> 0 AS success FROM events)"""


def ends(spark, d) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    known = spark.range(50).select(i.alias("producer_id"), F.lit(2).cast("long").alias("epoch"), F.when(i % 3 == 0, "None").when(i % 3 == 1, "Ongoing").otherwise("Ending").alias("state"), (i % 2 == 0).alias("ending"), (i % 4 < 2).alias("last"))
    id_ = F.col("event_id")
    return L.table(spark, d, "events").select("event_id", (F.col("user_id") % 60).alias("producer_id"), (id_ % 4).alias("epoch"), (id_ % 3 == 0).alias("commit"), (id_ % 5 != 0).alias("success")), known


@query(
    "end_txn",
    f"""WITH {END_SQL}, c AS (SELECT r.*, p.state AS was, CASE WHEN p.epoch IS NULL THEN 3 WHEN r.epoch < p.epoch THEN 90 WHEN r.epoch > p.epoch THEN 47 WHEN p.state = 'Ongoing' THEN 0 WHEN p.state = 'Ending' AND ending = commit THEN 0 WHEN p.state = 'None' AND last = commit THEN 0 ELSE 53 END AS error_code FROM r LEFT JOIN p USING (producer_id))
SELECT event_id, error_code, CASE WHEN error_code = 0 AND was = 'Ongoing' THEN 'Ending' ELSE was END AS state FROM c""",
)
def end_txn(spark, d):
    return txn.prepare_end(*ends(spark, d)).select("event_id", "error_code", "state")


@query(
    "end_txn_finish",
    f"""WITH {END_SQL}, c AS (SELECT r.*, p.state AS was, last, p.state = 'Ending' AND ending = commit AS moves, CASE WHEN p.epoch IS NULL THEN 3 WHEN r.epoch < p.epoch THEN 90 WHEN r.epoch > p.epoch THEN 47 WHEN p.state = 'Ending' AND ending = commit THEN 0 WHEN p.state = 'None' AND last = commit THEN 0 ELSE 53 END AS error_code FROM r LEFT JOIN p USING (producer_id))
SELECT event_id, error_code, CASE WHEN error_code = 0 AND moves THEN CASE WHEN success THEN 'None' ELSE 'Ongoing' END ELSE was END AS state, CASE WHEN error_code = 0 AND moves AND success THEN commit ELSE last END AS last FROM c""",
)
def end_txn_finish(spark, d):
    return txn.finish_end(*ends(spark, d)).select("event_id", "error_code", "state", "last")


@query(
    "txn_markers",
    f"WITH {TXN_SQL}, s AS (SELECT part, max(last_offset) + 1 AS hw FROM batches GROUP BY part), e AS (SELECT DISTINCT part, producer_id FROM log) SELECT part, producer_id, hw + row_number() OVER (PARTITION BY part ORDER BY producer_id) - 1 AS off, 48 AS attributes, -1 AS seq, CASE WHEN producer_id % 3 = 0 THEN '00000001' ELSE '00000000' END AS key FROM e JOIN s USING (part)",
)
def txn_markers(spark, d):
    """A control record for each producer and partition behind the log."""
    log = L.records(spark, d)
    ended = log.select("part", "producer_id").distinct().withColumns({"epoch": F.lit(0), "commit": F.col("producer_id") % 3 == 0})
    return txn.markers(ended, state_of(L.batches(log))).select("part", "producer_id", "off", "attributes", "seq", F.hex("key").alias("key"))


@query("txn_groups", "SELECT DISTINCT 't' || (user_id % 6) AS txn_id, 'g' || (event_id % 4) AS grp FROM events WHERE user_id % 6 < 4 AND event_id % 5 <> 0")
def txn_groups(spark, d):
    """Requests of every event to add a group: one id unknown, one in a state that can't take it, a fifth with an old epoch."""
    i, u = F.col("id"), F.col("user_id") % 6
    rows = L.table(spark, d, "events").select(F.concat(F.lit("t"), u.cast("string")).alias("txn_id"), u.alias("producer_id"), F.when(F.col("event_id") % 5 == 0, 0).otherwise(1).alias("epoch"), F.concat(F.lit("g"), (F.col("event_id") % 4).cast("string")).alias("grp"))
    known = spark.range(5).select(F.concat(F.lit("t"), i.cast("string")).alias("txn_id"), i.alias("producer_id"), F.lit(1).alias("epoch"), F.when(i == 4, "PrepareCommit").otherwise("Ongoing").alias("state"))
    return txn.add_groups(rows, known)


@query(
    "txn_gate",
    """WITH r AS (SELECT i AS id, 't' || (i % 6) AS txn_id, i % 6 + CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS pid, CASE WHEN i % 5 = 0 THEN 0 ELSE 1 END AS epoch FROM range(0, 60) t(i))
SELECT id, txn_id, CASE WHEN txn_id = 't5' THEN 3 WHEN id % 7 = 0 THEN 49 WHEN epoch <> 1 THEN 47 WHEN txn_id = 't4' THEN 53 ELSE 0 END AS error_code FROM r""",
)
def txn_gate(spark, d):
    i = F.col("id")
    rows = spark.range(60).select("id", F.concat(F.lit("t"), (i % 6).cast("string")).alias("txn_id"), (i % 6 + F.when(i % 7 == 0, 1).otherwise(0)).alias("producer_id"), F.when(i % 5 == 0, 0).otherwise(1).alias("epoch"))
    known = spark.range(5).select(F.concat(F.lit("t"), i.cast("string")).alias("txn_id"), i.alias("producer_id"), F.lit(1).alias("epoch"), F.when(i == 4, "PrepareCommit").otherwise("Ongoing").alias("state"))
    return txn.gate(rows, known).select("id", "txn_id", "error_code")


# Consumer groups


@query("committed", f"WITH {COMMIT_SQL} SELECT grp, part, max_by(committed, commit_seq) AS committed FROM commits GROUP BY grp, part")
def committed(spark, d):
    return groups.committed(L.commits(L.records(spark, d)))


@query("offset_fetch", f"WITH {COMMIT_SQL}, w AS (SELECT 'g' || i AS grp, CAST(p AS INT) AS part FROM range(0, 4) a(i), range(0, 5) b(p)), c AS (SELECT grp, part, max_by(committed, commit_seq) AS committed FROM commits GROUP BY grp, part) SELECT grp, part, coalesce(committed, -1) AS committed FROM w LEFT JOIN c USING (grp, part)")
def offset_fetch(spark, d):
    wanted = spark.range(20).select(F.concat(F.lit("g"), F.floor(F.col("id") / 5).cast("string")).alias("grp"), (F.col("id") % 5).cast("int").alias("part"))
    return groups.offset_fetch(wanted, L.commits(L.records(spark, d)))


@query("lag", f"WITH {COMMIT_SQL}, c AS (SELECT grp, part, max_by(committed, commit_seq) AS committed FROM commits GROUP BY grp, part), s AS (SELECT part, max(last_offset) + 1 AS hw FROM batches GROUP BY part), g AS (SELECT DISTINCT grp FROM c) SELECT grp, part, hw, committed, hw - coalesce(committed, 0) AS lag FROM g CROSS JOIN s LEFT JOIN c USING (grp, part)")
def lag(spark, d):
    log = L.records(spark, d)
    return lookup.lag(state_of(L.batches(log)), groups.committed(L.commits(log)))


@query("offset_delete", f"WITH {COMMIT_SQL}, c AS (SELECT grp, part, max_by(committed, commit_seq) AS committed FROM commits GROUP BY grp, part) SELECT grp, part, committed FROM c WHERE NOT (part % 2 = 0 AND NOT (grp = 'g1' AND part = 0))")
def offset_delete(spark, d):
    offsets = groups.committed(L.commits(L.records(spark, d)))
    return groups.offset_delete(offsets, offsets.where("part % 2 = 0").select("grp", "part"), spark.createDataFrame([("g1", 0)], "grp string, part int"))


#: Users as members of five groups, listing protocols by rule.
MEMBER_SQL = "members AS (SELECT DISTINCT 'g' || (user_id % 5) AS grp, user_id AS member_id, CASE user_id % 3 WHEN 0 THEN ['range', 'roundrobin'] WHEN 1 THEN ['roundrobin', 'sticky', 'range'] ELSE ['sticky', 'range', 'roundrobin'] END AS protocols FROM events)"


def members(spark, d) -> DataFrame:
    lists = [("range", "roundrobin"), ("roundrobin", "sticky", "range"), ("sticky", "range", "roundrobin")]
    lists = [F.array(*map(F.lit, x)) for x in lists]
    u = F.col("user_id")
    return L.table(spark, d, "events").select("user_id").distinct().select(F.concat(F.lit("g"), (u % 5).cast("string")).alias("grp"), u.alias("member_id"), F.when(u % 3 == 0, lists[0]).when(u % 3 == 1, lists[1]).otherwise(lists[2]).alias("protocols"))


@query(
    "elect_protocol",
    f"""WITH {MEMBER_SQL}, listed AS (SELECT grp, member_id, unnest(protocols) AS protocol, generate_subscripts(protocols, 1) AS pos FROM members), n AS (SELECT grp, count(*) AS n FROM members GROUP BY grp),
common AS (SELECT grp, protocol FROM listed JOIN n USING (grp) GROUP BY grp, protocol, n HAVING count(*) = n), votes AS (SELECT grp, member_id, min_by(protocol, pos) AS protocol FROM listed JOIN common USING (grp, protocol) GROUP BY grp, member_id),
counts AS (SELECT grp, protocol, count(*) AS votes FROM votes GROUP BY ALL) SELECT grp, protocol, votes FROM counts QUALIFY row_number() OVER (PARTITION BY grp ORDER BY votes DESC, protocol) = 1""",
)
def elect_protocol(spark, d):
    return groups.elect_protocol(members(spark, d))


@query("subscribed", f"WITH {MEMBER_SQL} SELECT DISTINCT grp, unnest(protocols) AS topic FROM members")
def subscribed(spark, d):
    return groups.subscribed_topics(members(spark, d).withColumnRenamed("protocols", "topics"))


BEAT_SQL = f"{LOG_SQL}, beats AS (SELECT 'g' || (user_id % 5) AS grp, user_id AS member_id, ts_ms FROM log), live AS (SELECT grp, member_id, max(ts_ms) AS last_seen, (SELECT max(ts_ms) FROM log) - max(ts_ms) >= 7200000 AS expired FROM beats GROUP BY grp, member_id)"


def beats(log: DataFrame) -> DataFrame:
    return log.select(F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("grp"), F.col("user_id").alias("member_id"), "ts_ms")


def live(log: DataFrame) -> DataFrame:
    return groups.live_members(beats(log), log.agg(F.max("ts_ms").alias("now_ms")), 7_200_000)


@query("session_members", f"WITH {BEAT_SQL} SELECT * FROM live")
def session_members(spark, d):
    return live(L.records(spark, d))


@query(
    "sessions",
    f"""WITH {BEAT_SQL}, n AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY grp, member_id ORDER BY ts_ms) >= 21600000 THEN 1 ELSE 0 END AS new FROM beats), s AS (SELECT *, sum(new) OVER (PARTITION BY grp, member_id ORDER BY ts_ms) AS session FROM n)
SELECT grp, member_id, CAST(session AS BIGINT) AS session, min(ts_ms) AS began, max(ts_ms) AS ended, count(*) AS n FROM s GROUP BY grp, member_id, session""",
)
def sessions(spark, d):
    return groups.sessions(beats(L.records(spark, d)), 21_600_000)


@query("list_groups", f"WITH {BEAT_SQL}, k AS (SELECT grp FROM live UNION SELECT 'g9'), c AS (SELECT grp, count(*) AS n FROM live WHERE NOT expired GROUP BY grp) SELECT grp, CASE WHEN n IS NULL THEN 'Empty' ELSE 'Stable' END AS state, coalesce(n, 0) AS n_members FROM k LEFT JOIN c USING (grp)")
def list_groups(spark, d):
    return groups.list_groups(live(L.records(spark, d)), spark.createDataFrame([("g9",)], "grp string"))


def wanted_groups(spark) -> DataFrame:
    return spark.createDataFrame([("g0",), ("g9",), ("none",)], "grp string")


@query("describe_groups", f"WITH {BEAT_SQL}, k AS (SELECT grp FROM live UNION SELECT 'g9'), c AS (SELECT grp, count(*) AS n FROM live WHERE NOT expired GROUP BY grp), w AS (SELECT unnest(['g0', 'g9', 'none']) AS grp) SELECT w.grp, CASE WHEN k.grp IS NULL THEN 'Dead' WHEN n IS NULL THEN 'Empty' ELSE 'Stable' END AS state, coalesce(n, 0) AS n_members FROM w LEFT JOIN k ON k.grp = w.grp LEFT JOIN c ON c.grp = w.grp")
def describe_groups(spark, d):
    return groups.describe_groups(wanted_groups(spark), list_groups(spark, d))


@query("delete_groups", f"WITH {BEAT_SQL}, k AS (SELECT grp FROM live UNION SELECT 'g9'), c AS (SELECT grp, count(*) AS n FROM live WHERE NOT expired GROUP BY grp), w AS (SELECT unnest(['g0', 'g9', 'none']) AS grp) SELECT w.grp, CASE WHEN k.grp IS NULL THEN 69 WHEN n IS NULL THEN 0 ELSE 68 END AS error_code FROM w LEFT JOIN k ON k.grp = w.grp LEFT JOIN c ON c.grp = w.grp")
def delete_groups(spark, d):
    return groups.delete_groups(wanted_groups(spark), list_groups(spark, d))


@query("assign", f"WITH {MEMBER_SQL}, r AS (SELECT grp, member_id, row_number() OVER (PARTITION BY grp ORDER BY member_id) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM members) SELECT grp, member_id, p AS part FROM r, range(0, 64) t(p) WHERE p % n = r")
def assign(spark, d):
    m = members(spark, d)
    parts = m.select("grp").distinct().join(F.broadcast(spark.range(64).select(F.col("id").alias("part"))))
    return groups.range_assign(m, parts)


@query("sync_group", f"WITH {MEMBER_SQL} SELECT grp, member_id, CASE WHEN member_id % 4 <> 0 THEN 'a' || member_id END AS assignment FROM members")
def sync_group(spark, d):
    m = members(spark, d).select("grp", "member_id")
    given = m.where("member_id % 4 <> 0").withColumn("assignment", F.concat(F.lit("a"), F.col("member_id").cast("string")))
    return groups.sync(m, given)


@query("commit_errors", "SELECT i AS id, CASE WHEN i % 5 = 0 THEN 0 WHEN i % 5 = 4 THEN 25 WHEN i % 3 = 1 THEN 22 ELSE 0 END AS error_code FROM range(0, 60) t(i)")
def commit_errors(spark, d):
    i = F.col("id")
    rows = spark.range(60).select("id", F.lit("g").alias("grp"), F.when(i % 5 != 0, F.concat(F.lit("m"), (i % 5).cast("string"))).alias("member_id"), F.when(i % 3 == 1, 8).otherwise(7).alias("generation"))
    known = spark.createDataFrame([("g", f"m{k}", 7) for k in (1, 2, 3)], "grp string, member_id string, generation int")
    return groups.commit_errors(rows, known).select("id", "error_code")


# Catalog

NAMES = ["orders", "a.b", "a_b", "", ".", "..", "x" * 249, "x" * 250, "white space", "Ünïcode", "UPPER-case_1.2", "tab\tname"]


@query("topic_names", "SELECT p_name AS name, regexp_full_match(p_name, '[A-Za-z0-9._-]+') AND p_name NOT IN ('.', '..') AND strlen(p_name) <= 249 AS valid FROM part")
def topic_names(spark, d):
    return L.table(spark, d, "part").select(F.col("p_name").alias("name"), catalog.valid_name(F.col("p_name")).alias("valid"))


COLLIDE_SQL = "names AS (SELECT DISTINCT event_type || CASE WHEN user_id % 7 < 2 THEN '.' ELSE '_' END || (user_id % 3) || CASE WHEN user_id % 11 = 0 THEN 'x' ELSE '' END AS name FROM events)"


def dotted(spark, d) -> DataFrame:
    u = F.col("user_id")
    return L.table(spark, d, "events").select(F.concat("event_type", F.when(u % 7 < 2, ".").otherwise("_"), (u % 3).cast("string"), F.when(u % 11 == 0, "x").otherwise("")).alias("name"))


@query("collisions", f"WITH {COLLIDE_SQL}, n AS (SELECT name, replace(name, '.', '_') AS normal FROM names) SELECT name, normal FROM n QUALIFY count(*) OVER (PARTITION BY normal) > 1")
def collisions(spark, d):
    return catalog.collisions(dotted(spark, d))


@query(
    "create_topics",
    r"""WITH r(seq, name, n_parts, config_name) AS (VALUES (0, 'a.b', 3, NULL), (1, 'a_b', 1, NULL), (2, 'old', 1, NULL), (3, 'old.x', 1, NULL), (4, 'bad name', 1, NULL), (5, 'zero', 0, NULL), (6, 'standard', -1, 'retention.ms'), (7, 'odd', 2, 'nonsense'))
SELECT CAST(seq AS BIGINT) AS seq, name, CASE seq WHEN 1 THEN 17 WHEN 2 THEN 36 WHEN 3 THEN 17 WHEN 4 THEN 17 WHEN 5 THEN 37 WHEN 7 THEN 40 ELSE 0 END AS error_code, CASE seq WHEN 0 THEN 3 WHEN 6 THEN 1 ELSE -1 END AS partitions FROM r""",
)
def create_topics(spark, d):
    rows = [(0, "a.b", 3, None), (1, "a_b", 1, None), (2, "old", 1, None), (3, "old.x", 1, None), (4, "bad name", 1, None), (5, "zero", 0, None), (6, "standard", -1, "retention.ms"), (7, "odd", 2, "nonsense")]
    return catalog.create_topics(spark.createDataFrame(rows, "seq long, name string, n_parts int, config_name string"), spark.createDataFrame([("old",), ("old_x",)], "name string"))


def topics_of(spark, d) -> DataFrame:
    """Customers' market segments as topics with ids, partitions and configs."""
    s = L.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg((F.count(F.lit(1)) % 7 + 1).alias("partition_count"))
    configs = F.when(F.col("partition_count") % 2 == 0, F.create_map(F.lit("retention.ms"), (F.col("partition_count") * 1000).cast("string"), F.lit("cleanup.policy"), F.lit("compact")))
    return s.withColumns({"topic_id": F.md5("name"), "configs": configs})


TOPIC_SQL = "topics AS (SELECT c_mktsegment AS name, md5(c_mktsegment) AS topic_id, count(*) % 7 + 1 AS partition_count FROM customer GROUP BY c_mktsegment)"


@query("delete_topics", f"WITH {TOPIC_SQL} SELECT name, partition_count FROM topics WHERE name <> 'BUILDING' AND topic_id <> md5('MACHINERY')")
def delete_topics(spark, d):
    gone = spark.createDataFrame([("BUILDING", None)], "name string, topic_id string").union(spark.range(1).select(F.lit(None).cast("string"), F.md5(F.lit("MACHINERY"))))
    return catalog.delete_topics(topics_of(spark, d), gone).select("name", "partition_count")


@query("create_partitions", f"WITH {TOPIC_SQL}, r AS (SELECT name, 4 AS n FROM topics UNION ALL SELECT 'none', 4) SELECT r.name, CASE WHEN t.name IS NULL THEN 3 WHEN n <= partition_count THEN 37 ELSE 0 END AS error_code, CASE WHEN n > partition_count THEN n ELSE partition_count END AS partition_count FROM r LEFT JOIN topics t USING (name)")
def create_partitions(spark, d):
    topics = topics_of(spark, d)
    wanted = topics.select("name").union(spark.createDataFrame([("none",)], "name string")).withColumn("count", F.lit(4).cast("long"))
    return catalog.create_partitions(topics, wanted)


DEFAULT_SQL = "defaults(config, value) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in catalog.DEFAULTS.items()) + ")"


@query(
    "configs",
    f"WITH {TOPIC_SQL}, {DEFAULT_SQL}, own AS (SELECT name, 'retention.ms' AS config, CAST(partition_count * 1000 AS VARCHAR) AS value FROM topics WHERE partition_count % 2 = 0 UNION ALL SELECT name, 'cleanup.policy', 'compact' FROM topics WHERE partition_count % 2 = 0) SELECT t.name, d.config, coalesce(o.value, d.value) AS value, o.value IS NULL AS is_default FROM topics t CROSS JOIN defaults d LEFT JOIN own o ON o.name = t.name AND o.config = d.config",
)
def configs(spark, d):
    return catalog.describe_configs(topics_of(spark, d))


@query("broker_configs", "SELECT '7' AS name, 'broker.id' AS config, '7' AS value, false AS is_default, true AS read_only")
def broker_configs(spark, d):
    return catalog.describe_broker(spark, 7)


VERSION_SQL = "v(api_key, name, min_version, max_version) AS (VALUES " + ", ".join(f"({k}, '{n}', {a}, {b})" for k, n, a, b in catalog.API_VERSIONS) + ")"


@query("api_versions", f"WITH {VERSION_SQL} SELECT *, 35 AS error_code, 0 AS version FROM v")
def api_versions(spark, d):
    """Asked in a version that isn't known, which is answered all the same."""
    return catalog.api_versions(spark, 99)


@query("describe_cluster", "SELECT 'c' AS cluster_id, 7 AS controller_id, 7 AS node_id, 'localhost' AS host, 9092 AS port")
def describe_cluster(spark, d):
    return catalog.describe_cluster(spark, "c", 7, "localhost", 9092)


@query("find_coordinator", "SELECT DISTINCT event_type AS key, CAST(user_id % 3 AS INT) AS kind, CASE WHEN user_id % 3 < 2 THEN 0 ELSE 42 END AS error_code, CASE WHEN user_id % 3 < 2 THEN 7 END AS node_id, CASE WHEN user_id % 3 < 2 THEN 'localhost' END AS host, CASE WHEN user_id % 3 < 2 THEN 9092 END AS port FROM events")
def find_coordinator(spark, d):
    wanted = L.table(spark, d, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 3).cast("int").alias("kind")).distinct()
    return groups.find_coordinator(wanted, 7, "localhost", 9092)


@query(
    "retention_work",
    """WITH p AS (SELECT DISTINCT event_type AS topic, CAST(user_id % 4 AS INT) AS part FROM events), e AS (SELECT *, part = 2 AS dirty, row_number() OVER (ORDER BY topic, part) - 1 AS place, count(*) OVER () AS n FROM p WHERE topic <> 'view'),
t AS (SELECT *, row_number() OVER (ORDER BY NOT dirty, CASE WHEN dirty THEN place ELSE (place - 3 % n + n) % n END) - 1 AS turn FROM e) SELECT topic, part, dirty, CAST(turn AS INT) AS turn FROM t WHERE turn < 7""",
)
def retention_work(spark, d):
    rows = L.table(spark, d, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part")).distinct()
    limit = F.when(F.col("topic") == "view", -1).otherwise(1000)
    rows = rows.withColumns({"retention_ms": limit, "retention_bytes": F.lit(-1), "dirty": F.col("part") == 2})
    return retention.select_work(rows, 7, 3).select("topic", "part", "dirty", "turn")


CHANGE_SQL = f"{TOPIC_SQL}, c AS (SELECT name, 'retention.ms' AS config, '1' AS value FROM topics UNION ALL SELECT name, 'segment.bytes', '2' FROM topics)"


def own_configs(spark, d) -> DataFrame:
    names = topics_of(spark, d).select("name")
    return names.select("name", F.explode(F.create_map(F.lit("retention.ms"), F.lit("1"), F.lit("segment.bytes"), F.lit("2"))).alias("config", "value"))


@query("alter_configs", f"WITH {CHANGE_SQL} SELECT name, config, CASE WHEN config = 'retention.ms' THEN '9' ELSE value END AS value FROM c WHERE NOT (name < 'C' AND config = 'segment.bytes')")
def alter_configs(spark, d):
    names = topics_of(spark, d).select("name")
    changes = [names.select("name", F.lit(c).alias("config"), F.lit(op).alias("op"), F.lit(v).alias("value"), F.lit(s).alias("seq")) for c, op, v, s in (("retention.ms", "DELETE", "", 1), ("retention.ms", "SET", "9", 2), ("segment.bytes", "APPEND", "7", 3))]
    changes = changes[0].union(changes[1]).union(changes[2]).union(names.where("name < 'C'").select("name", F.lit("segment.bytes"), F.lit("DELETE"), F.lit(""), F.lit(4)))
    return catalog.alter_configs(own_configs(spark, d), changes)


@query("replace_configs", f"WITH {CHANGE_SQL} SELECT name, config, value FROM c WHERE name >= 'C' UNION ALL SELECT DISTINCT name, 'cleanup.policy', 'compact' FROM c WHERE name < 'C'")
def replace_configs(spark, d):
    own = own_configs(spark, d)
    return catalog.replace_configs(own, own.where("name < 'C'").select("name").distinct().select("name", F.lit("cleanup.policy").alias("config"), F.lit("compact").alias("value")))


META_SQL = """meta AS (SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'PartitionCount' ELSE event_type END AS kind, user_id AS entity,
  CASE WHEN event_type = 'view' THEN CAST(event_id % 9 AS VARCHAR) WHEN event_type <> 'error' THEN props END AS value, length(props) AS bytes, event_id % 7919 <> 7000 AS good FROM events)"""


def meta_entries(spark, d) -> DataFrame:
    e = L.table(spark, d, "events")
    view = F.col("event_type") == "view"
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(view, "PartitionCount").otherwise(F.col("event_type")).alias("kind"),
        F.col("user_id").alias("entity"),
        F.when(view, (F.col("event_id") % 9).cast("string")).when(F.col("event_type") != "error", F.col("props")).alias("value"),
        F.length("props").alias("bytes"),
        (F.col("event_id") % 7919 != 7000).alias("good"),
    )


@query(
    "meta_fold",
    f"WITH {META_SQL}, last AS (SELECT kind, entity, value FROM meta WHERE kind <> 'PartitionCount' QUALIFY row_number() OVER (PARTITION BY kind, entity ORDER BY seq DESC) = 1) SELECT kind, entity, value FROM last WHERE value IS NOT NULL UNION ALL SELECT kind, entity, CAST(max(CAST(value AS BIGINT)) AS VARCHAR) FROM meta WHERE kind = 'PartitionCount' GROUP BY kind, entity",
)
def meta_fold(spark, d):
    return catalog.fold_metadata(meta_entries(spark, d))


@query("meta_prefix", f"WITH {META_SQL} SELECT seq, kind FROM meta WHERE seq < coalesce((SELECT min(seq) FROM meta WHERE NOT good), 1152921504606846976)")
def meta_prefix(spark, d):
    return catalog.readable_prefix(meta_entries(spark, d)).select("seq", "kind")


@query("meta_stale", f"WITH {META_SQL}, g AS (SELECT max_by(bytes, seq) AS live, sum(bytes) AS total FROM meta GROUP BY kind, entity) SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(live) AS BIGINT) AS live, CAST(floor((sum(total) - sum(live)) * 1000000 / sum(total)) AS BIGINT) AS stale_ppm FROM g")
def meta_stale(spark, d):
    return catalog.stale_share(meta_entries(spark, d))


@query("infer_topics", f"WITH {LOG_SQL} SELECT event_type AS name, md5(event_type) AS topic_id, max(part) + 1 AS partition_count FROM log WHERE event_id % 3 <> 0 GROUP BY event_type")
def infer_topics(spark, d):
    log = L.records(spark, d)
    path = B.object_key(F.lit("cluster"), F.col("event_type"), F.md5("event_type"), F.col("part"), F.col("off"))
    return catalog.infer_topics(log.select(F.when(F.col("event_id") % 3 == 0, F.concat(path, F.lit(".tmp"))).otherwise(path).alias("path")))


@query(
    "replay_skips",
    f"""WITH {BATCH_SQL}, r AS (SELECT CASE WHEN batch_no % 9 = 8 THEN 'gone' ELSE 'events' END AS topic, CASE WHEN batch_no % 7 = 6 THEN 9 ELSE part END AS part, batch_no % 5 <> 4 AS good, last_offset FROM batches)
SELECT CASE WHEN topic = 'gone' THEN 'unknown topic' WHEN part >= 4 THEN 'partition out of range' WHEN NOT good THEN 'bad header' WHEN last_offset < 100 THEN 'below log start' ELSE 'applied' END AS reason, count(*) AS n FROM r GROUP BY ALL""",
)
def replay_skips(spark, d):
    no = F.col("batch_no")
    rows = L.batches(L.records(spark, d)).select(F.when(no % 9 == 8, "gone").otherwise("events").alias("topic"), F.when(no % 7 == 6, 9).otherwise(F.col("part")).alias("part"), (no % 5 != 4).alias("good"), "last_offset")
    return catalog.replay_reasons(rows, spark.createDataFrame([("events", 4, 100)], "name string, partition_count int, log_start long"))


@query("probe_watermarks", f"WITH {BATCH_SQL} SELECT part, greatest(1000, max(last_offset) + 1) AS hw FROM batches GROUP BY part")
def probe_watermarks(spark, d):
    found = state_of(L.batches(L.records(spark, d))).select("part", "hw")
    return catalog.raise_watermarks(found.withColumn("hw", F.lit(1000).cast("long")), found)


@query("replay_log_starts", f"WITH {BATCH_SQL}, s AS (SELECT part, max(last_offset) + 1 AS hw FROM batches GROUP BY part), r AS (SELECT part, max(base_offset) + CASE WHEN part = 1 THEN 1000 ELSE 0 END AS log_start FROM batches WHERE part < 3 AND batch_no % 9 = 1 GROUP BY part) SELECT part, coalesce(r.log_start, 0) AS log_start, greatest(hw, coalesce(r.log_start, 0)) AS hw FROM s LEFT JOIN r USING (part)")
def replay_log_starts(spark, d):
    batches = L.batches(L.records(spark, d))
    starts = batches.where("part < 3 AND batch_no % 9 = 1").select("part", (F.col("base_offset") + F.when(F.col("part") == 1, 1000).otherwise(0)).alias("log_start"))
    return catalog.replay_log_starts(state_of(batches).select("part", F.lit(0).cast("long").alias("log_start"), "hw"), starts)


@query("promoted", f"WITH {BATCH_SQL}, m AS (SELECT part, max(last_offset) - 100 * (part + 1) AS wm FROM batches GROUP BY part) SELECT part, base_offset, last_offset FROM batches JOIN m USING (part) WHERE last_offset >= wm")
def promoted(spark, d):
    """The batches that a promoted broker takes back into memory."""
    batches = L.batches(L.records(spark, d))
    state = state_of(batches)
    marks = state.select("part", (F.col("hw") - 1 - 100 * (F.col("part") + 1)).alias("wm"))
    return catalog.promoted(batches, state.select("part", "hw"), marks)[1].select("part", "base_offset", "last_offset")


# Telemetry

SIZE_SQL = f"{LOG_SQL}, sized AS (SELECT *, coalesce(length(k), 0) + coalesce(length(v), 0) AS bytes FROM log)"


@query(
    "window_stats",
    f"""WITH {SIZE_SQL}, w AS (SELECT ts_ms // 3600000 * 3600000 AS window_ms, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM sized GROUP BY ALL)
SELECT window_ms, n, bytes, n * 1000.0 / 3600000.0 AS per_s, bytes * 1000.0 / 3600000.0 / 1048576.0 AS mib_per_s, CAST(sum(n) OVER (ORDER BY window_ms) AS BIGINT) AS c_n, CAST(sum(bytes) OVER (ORDER BY window_ms) AS BIGINT) AS c_bytes FROM w""".replace("n * 1000.0", "CAST(n AS DOUBLE) * 1000").replace("bytes * 1000.0 / 3600000.0 / 1048576.0", "CAST(bytes AS DOUBLE) * 1000 / 3600000 / 1048576").replace("1000 / 3600000.0 AS per_s", "1000 / 3600000 AS per_s"),
)
def window_stats(spark, d):
    size = F.coalesce(F.length("k"), F.lit(0)) + F.coalesce(F.length("v"), F.lit(0))
    return telemetry.window_stats(L.records(spark, d).withColumn("bytes", size), 3_600_000)


LATENCY_SQL = f"{LOG_SQL}, l AS (SELECT ts_ms // 3600000 * 3600000 AS window_ms, (event_id * 7919) % 997 AS x FROM log)"


@query(
    "window_latency",
    f"""WITH {LATENCY_SQL}, w AS (SELECT window_ms, sum(x) AS s, count(*) AS n, max(x) AS max_ms, list_sort(list(x)) AS xs FROM l GROUP BY window_ms)
SELECT window_ms, CAST(s AS DOUBLE) / n AS avg_ms, xs[CAST(least(floor(n * 0.5), n - 1) AS BIGINT) + 1] AS p50_ms, xs[CAST(least(floor(n * 0.95), n - 1) AS BIGINT) + 1] AS p95_ms, xs[CAST(least(floor(n * 0.99), n - 1) AS BIGINT) + 1] AS p99_ms, xs[CAST(least(floor(n * 0.999), n - 1) AS BIGINT) + 1] AS p999_ms, max_ms,
  CAST(sum(s) OVER o AS DOUBLE) / sum(n) OVER o AS c_avg_ms, max(max_ms) OVER o AS c_max_ms FROM w WINDOW o AS (ORDER BY window_ms)""",
)
def window_latency(spark, d):
    rows = L.records(spark, d).withColumn("latency_ms", (F.col("event_id") * 7919) % 997)
    return telemetry.window_latency(rows, 3_600_000)


POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def point_sql(x: str) -> str:
    return ", ".join(f"list_sort(list({x}))[CAST(least(floor(count(*) * {p}), count(*) - 1) AS BIGINT) + 1] AS {k}" for k, p in POINTS.items())


@query("percentiles", f"WITH {LOG_SQL} SELECT event_type, {point_sql('value')} FROM log WHERE value IS NOT NULL GROUP BY event_type")
def percentiles(spark, d):
    return telemetry.percentiles(L.records(spark, d), ["event_type"], "value", POINTS)


@query("final_percentiles", f"WITH {LOG_SQL}, w AS (SELECT event_type, ts_ms // 86400000 AS day, {point_sql('value')} FROM log GROUP BY ALL) SELECT event_type, " + ", ".join(f"list_sort(list({k}))[count(*) // 2 + 1] AS {k}" for k in POINTS) + " FROM w GROUP BY event_type")
def final_percentiles(spark, d):
    """The upper median over days of each day's percentiles."""
    days = L.records(spark, d).withColumn("day", F.floor(F.col("ts_ms") / 86_400_000))
    daily = telemetry.percentiles(days, ["event_type", "day"], "value", POINTS)
    return daily.groupBy("event_type").agg(*[telemetry.rank_percentile(F.sort_array(F.collect_list(k)), 0.5).alias(k) for k in POINTS])


@query("e2e_latency", f"WITH {LOG_SQL} SELECT part, off, greatest(0, CAST(floor((event_id % 50 - 3) * 1000000 / 1000000.0) AS BIGINT)) AS latency_ms FROM log WHERE event_id % 10 <> 0")
def e2e_latency(spark, d):
    log = L.records(spark, d)
    sent = F.col("ts_ms") * 1_000_000
    keyed = log.withColumn("key", telemetry.encode_key(F.col("event_id") % 10 != 0, sent)).withColumn("received", sent + (F.col("event_id") % 50 - 3) * 1_000_000)
    measured, at = telemetry.decode_key(F.col("key"))
    return keyed.where(measured).select("part", "off", telemetry.latency_ms(at, F.col("received")).alias("latency_ms"))


@query("completeness", f"WITH {LOG_SQL}, p AS (SELECT part, count(*) AS produced FROM log GROUP BY part), c AS (SELECT part, count(*) AS consumed FROM log WHERE NOT (part = 1 AND off % 500 = 3) AND part <> 3 GROUP BY part) SELECT part, produced, coalesce(consumed, 0) AS consumed, consumed IS NOT DISTINCT FROM produced AS complete FROM p LEFT JOIN c USING (part)")
def completeness(spark, d):
    log = L.records(spark, d)
    return telemetry.completeness(log, log.where("NOT (part = 1 AND off % 500 = 3) AND part <> 3"), ["part"])


@query("consume_bytes", f"WITH {LOG_SQL} SELECT part, count(*) AS n, CAST(sum(coalesce(strlen(k), 0) + coalesce(strlen(v), 0)) AS BIGINT) AS bytes FROM log GROUP BY part")
def consume_bytes(spark, d):
    return telemetry.consumed_bytes(L.records(spark, d), ["part"])


@query(
    "cost_model",
    """WITH p(provider, put, get, list, gib_price) AS (VALUES ('standard', 0.005::DOUBLE, 0.0004::DOUBLE, 0.005::DOUBLE, 0.023::DOUBLE), ('archive', 0.02::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.004::DOUBLE)), u AS (SELECT count(*) AS puts, count(*) * 3 AS gets, count(*) // 10 AS lists, CAST(sum(length(props)) AS DOUBLE) / 1024 AS gib FROM events),
c AS (SELECT provider, puts / 1000.0::DOUBLE * put AS put_cost, gets / 1000.0::DOUBLE * get AS get_cost, lists / 1000.0::DOUBLE * list AS list_cost, gib * gib_price AS storage_cost FROM p, u) SELECT *, put_cost + get_cost + list_cost + storage_cost AS total FROM c""",
)
def cost_model(spark, d):
    n = F.count(F.lit(1))
    usage = L.table(spark, d, "events").agg(n.alias("puts"), (n * 3).alias("gets"), F.floor(n / 10).alias("lists"), (F.sum(F.length("props")) / F.lit(1024.0)).alias("gib"))
    prices = spark.createDataFrame([("standard", 0.005, 0.0004, 0.005, 0.023), ("archive", 0.02, 0.01, 0.02, 0.004)], "provider string, put double, get double, list double, gib_price double")
    return telemetry.storage_cost(usage, prices)


@query("metadata", f"WITH {TOPIC_SQL}, w AS (SELECT unnest(['BUILDING', 'new', 'bad name']) AS name) SELECT w.name, CASE w.name WHEN 'new' THEN md5('new') ELSE topic_id END AS topic_id, CASE w.name WHEN 'new' THEN 1 ELSE partition_count END AS partition_count, CASE w.name WHEN 'bad name' THEN 17 ELSE 0 END AS error_code FROM w LEFT JOIN topics t USING (name)")
def metadata(spark, d):
    wanted = spark.createDataFrame([("BUILDING",), ("new",), ("bad name",)], "name string")
    return catalog.metadata(wanted, topics_of(spark, d), create=True)


@query("work_share", "SELECT i AS worker, 1003 // 16 + CASE WHEN i < 1003 % 16 THEN 1 ELSE 0 END AS n FROM range(0, 16) t(i)")
def work_share(spark, d):
    return spark.range(16).select(F.col("id").alias("worker"), telemetry.work_share(F.lit(1003), F.lit(16), F.col("id")).alias("n"))


@query("payloads", "SELECT i AS id, 1024 AS n, true AS fields FROM range(0, 500) t(i)")
def payloads(spark, d):
    """Generated events: exact size, and fields that parse."""
    made = telemetry.payloads(spark.range(500), 1024)
    parsed = F.from_json("value", "status int, meta struct<cart_items:int>, tags array<string>")
    good = parsed["status"].isNotNull() & parsed["meta"]["cart_items"].between(1, 20) & (F.size(parsed["tags"]) == 3)
    return made.select("id", F.length("value").alias("n"), good.alias("fields"))


@query("group_replay")
def group_replay(spark, d):
    """Users join one of five groups, send heartbeats and leave: a state machine, tested by vectors."""
    log = L.records(spark, d)
    kind = F.when(F.col("event_type") == "error", "leave").when(F.col("event_type") == "view", "heartbeat").otherwise("join")
    events = log.select(
        F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("grp"),
        F.col("event_id").alias("seq"),
        "ts_ms",
        kind.alias("kind"),
        F.col("user_id").cast("string").alias("member_id"),
        F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string"))).alias("instance_id"),
        F.array(F.lit("range")).alias("protocols"),
        F.lit(3_600_000).cast("long").alias("timeout_ms"),
        F.lit(1).alias("generation"),
        F.lit(None).cast("map<string,string>").alias("assignments"),
    )
    return membership.replay(events)
