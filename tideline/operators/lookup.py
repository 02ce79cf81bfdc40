"""Offset and time lookups, and summaries of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import as_of, running


def part_state(batches: DataFrame) -> DataFrame:
    """part, log_start, hw, total_bytes, n_batches, max_ts, max_ts_offset of each partition, in one aggregation."""
    return batches.groupBy("part").agg(
        F.min("base_offset").alias("log_start"),
        (F.max("last_offset") + 1).alias("hw"),
        F.sum("batch_length").cast("long").alias("total_bytes"),
        F.count(F.lit(1)).alias("n_batches"),
        F.max("max_ts").alias("max_ts"),
        F.max_by("last_offset", F.struct("max_ts", "base_offset")).alias("max_ts_offset"),
    )


def stable_offsets(state: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds lso: hw, or the first offset of any open transaction before it."""
    open_ = ranges.where("outcome = 'open'").groupBy("part").agg(F.min("first_offset").alias("__open"))
    return state.join(open_, "part", "left").withColumn("lso", F.least("hw", F.coalesce("__open", "hw"))).drop("__open")


def offset_for_time(batches: DataFrame, times: DataFrame, width: int = 65_536, width_ms: int = 3_600_000) -> DataFrame:
    """For each (part, t) the first batch in offset order whose largest time stamp reaches t: found_offset, found_ts; -1, -1 where none does.

    Only batches whose time exceeds all before them can be first; their times
    rise with their offsets, so a lookup by time finds the one.
    """
    rows = running(batches, ["part"], ["base_offset"], F.floor(F.col("base_offset") / width), F.col("max_ts"), "__before", "max")
    records = rows.where("__before IS NULL OR max_ts > __before")
    found = as_of(times, records, ["part"], -F.col("t"), -F.col("max_ts"), width_ms, F.struct("base_offset", "max_ts"), "__x")
    return found.select("part", "t", F.coalesce("__x.base_offset", F.lit(-1)).alias("found_offset"), F.coalesce("__x.max_ts", F.lit(-1)).alias("found_ts"))


LATEST, EARLIEST, MAX_TIME = -1, -2, -3


def list_offsets(batches: DataFrame, state: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers (part, t, committed): error_code, off and ts_ms.

    t: -1 the end (the last stable offset if ``committed``), -2 the start, -3
    the largest time stamp, else the first batch that reaches it. state: part,
    log_start, hw, lso, max_ts, max_ts_offset. Unknown partitions: 3, -1, -1.
    """
    rows = requests.join(state.select("part", "log_start", "hw", "lso", "max_ts", "max_ts_offset"), "part", "left")
    timed = offset_for_time(batches, requests.where("t >= 0").select("part", "t").distinct())
    rows = rows.join(timed, ["part", "t"], "left")
    t, none = F.col("t"), F.lit(-1).cast("long")
    off = F.when(t == LATEST, F.when(F.col("committed"), F.col("lso")).otherwise(F.col("hw"))).when(t == EARLIEST, F.col("log_start")).when(t == MAX_TIME, F.col("max_ts_offset")).otherwise(F.col("found_offset"))
    ts = F.when(t == MAX_TIME, F.col("max_ts")).when(t >= 0, F.col("found_ts")).otherwise(none)
    known = F.col("hw").isNotNull()
    return rows.select(*requests.columns, F.when(known, 0).otherwise(3).alias("error_code"), F.when(known, off).otherwise(none).alias("off"), F.when(known, ts).otherwise(none).alias("ts_ms"))


def epoch_end(state: DataFrame, requests: DataFrame) -> DataFrame:
    """OffsetForLeaderEpoch where the only epoch is 0: (part, epoch, current_epoch) -> error_code, end_epoch, end_offset."""
    rows = requests.join(state.select("part", "hw"), "part", "left")
    code = F.when(F.col("hw").isNull(), 3).when(F.col("current_epoch") > 0, 75).otherwise(0)
    good = (code == 0) & (F.col("epoch") <= 0)
    return rows.select(*requests.columns, code.alias("error_code"), F.when(good, 0).otherwise(-1).alias("end_epoch"), F.when(good, F.col("hw")).otherwise(-1).alias("end_offset"))


def unflushed(batches: DataFrame, marks: DataFrame) -> DataFrame:
    """Of batches that end at or behind a partition's flush watermark (part, wm): bytes, first batch, largest offset."""
    return batches.join(marks, "part").where("last_offset >= wm").groupBy("part").agg(F.sum("batch_length").cast("long").alias("bytes"), F.min("batch_no").alias("first_seq"), F.max("last_offset").alias("max_offset"))


def global_watermark(pending: DataFrame, next_seq: int | Column) -> DataFrame:
    """The least unflushed sequence over all partitions, else the next one."""
    later = next_seq if isinstance(next_seq, Column) else F.lit(next_seq)
    return pending.agg(F.coalesce(F.min("first_seq"), later).cast("long").alias("watermark"))


def lag(state: DataFrame, committed: DataFrame) -> DataFrame:
    """grp, part, hw, committed, lag of each group and partition; without a commit all of the log lags."""
    # Every group against every partition of the log: the report has a row for each, so this product is its size.
    rows = committed.select("grp").distinct().join(state.select("part", "hw"))
    return rows.join(committed.select("grp", "part", "committed"), ["grp", "part"], "left").withColumn("lag", F.col("hw") - F.coalesce("committed", F.lit(0)))
