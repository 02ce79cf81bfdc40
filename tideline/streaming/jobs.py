"""Streams over log tables, run to the end of what is there.

Each job takes a streaming DataFrame, keeps its state in Spark's state store,
and leaves its result as a table in the shared folder; a batch that runs again
overwrites its own output only.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.compaction import latest_per_key
from ..operators.ingest import Producer


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tideline-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run(stream: DataFrame, spark: SparkSession, mode: str, folder: str | None = None) -> DataFrame:
    """Runs the stream over all that is there; the rows of every batch."""
    folder = folder or shared_dir(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").drop("batch")


def timeout(idle_ms: int | None) -> str:
    """For a stream that never ends, state that was silent for ``idle_ms`` goes.

    Spark runs batches for such timeouts without end, so a query that is to
    stop at the end of what is there takes none.
    """
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def dedup(sends: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """What each producer has sent before (part, producer_id, epoch, seq, n, arrival, off), kept between batches across its partitions."""
    out = "part int, producer_id long, seq long, arrival long, error_code int, result_offset long, duplicate boolean"

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        producer = pickle.loads(state.get[0]) if state.exists else Producer()
        rows = pd.concat(list(chunks)).sort_values("arrival")
        found = [producer.accept(r.part, r.epoch, r.seq, r.n, r.off) for r in rows.itertuples()]
        state.update((pickle.dumps(producer),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"part": rows["part"], "producer_id": rows["producer_id"], "seq": rows["seq"], "arrival": rows["arrival"], "error_code": [x[0] for x in found], "result_offset": [x[1] for x in found], "duplicate": [x[2] for x in found]})

    return sends.groupBy("producer_id").applyInPandasWithState(step, out, "producer binary", "append", timeout(idle_ms))


def transactions(log: DataFrame) -> DataFrame:
    """Ranges (part, producer_id, first_offset, last_offset, outcome) as their markers arrive; open ones stay in the state."""
    out = "part int, producer_id long, first_offset long, last_offset long, outcome string"

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        done = []
        for r in pd.concat(list(chunks)).sort_values("off").itertuples():
            if r.control is None or r.control != r.control:
                first = r.off if first is None else first
            elif first is not None:
                done.append((*key, first, r.off, r.control))
                first = None
        if first is None:  # nothing is open
            if state.exists:
                state.remove()
        else:
            state.update((first,))
        yield pd.DataFrame(done, columns=["part", "producer_id", "first_offset", "last_offset", "outcome"])

    return log.groupBy("part", "producer_id").applyInPandasWithState(step, out, "first long", "append", GroupStateTimeout.NoTimeout)


def members(beats: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """grp, member_id, last_seen, n after each batch that holds a member's heartbeat."""
    out = "grp string, member_id long, last_seen long, n long"

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (-1, 0)
        for c in chunks:
            last, n = max(last, int(c["ts_ms"].max())), n + len(c)
        state.update((last, n))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"grp": [key[0]], "member_id": [key[1]], "last_seen": [last], "n": [n]})

    return beats.groupBy("grp", "member_id").applyInPandasWithState(step, out, "last long, n long", "update", timeout(idle_ms))


def window_stats(rows: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Aligned tumbling windows of ts: n and sum of value, updated as rows arrive; windows behind the watermark are final."""
    grouped = rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.unix_millis("w.start").alias("window_ms"), "n", "total")


def snapshots(spark: SparkSession, folder: str) -> dict[int, str]:
    """Whole snapshots in ``folder`` by the number of their batch: those that were written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot=*/_SUCCESS")) or []
    names = [f.getPath().getParent() for f in found]
    return {int(p.getName().split("=")[1]): p.toString() for p in names}


def compact(log: DataFrame, spark: SparkSession, folder: str | None = None, buckets: int = 16, kept: int = 2) -> DataFrame:
    """Keep-latest-per-key snapshots: each batch is merged into the snapshot before it.

    The snapshot to merge into is looked up in ``folder``, so a query that
    starts again from its checkpoint goes on where it was; a batch that runs
    again writes its own snapshot anew from the same one before. A new
    snapshot is whole before older ones than the last ``kept`` go. Snapshots
    are partitioned by a hash of the key, and only buckets that the batch
    touches are merged; the others are copied.
    """
    folder = folder or shared_dir(spark)
    bucket = F.pmod(F.xxhash64("part", "k"), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        before = {n: p for n, p in snapshots(spark, folder).items() if n < number}
        batch = batch.withColumn("bucket", bucket)
        out = latest_per_key(batch)
        if before:
            old = spark.read.schema(batch.schema).parquet(before[max(before)])
            touched = F.broadcast(batch.select("bucket").distinct())  # one row a bucket
            out = latest_per_key(batch.unionByName(old.join(touched, "bucket", "left_semi"))).unionByName(old.join(touched, "bucket", "left_anti"))
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/snapshot={number}")
        for n in sorted(before)[: -(kept - 1) or None]:
            old_path = spark._jvm.org.apache.hadoop.fs.Path(before[n])
            old_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old_path, True)

    q = log.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = snapshots(spark, folder)
    if not last:
        return spark.createDataFrame([], log.schema)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in log.schema)}, bucket int").parquet(last[max(last)]).drop("bucket")
