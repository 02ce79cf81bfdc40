"""Append: validation, time stamps, deduplication, offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import running

#: Error codes of the public protocol; fixed values.
OFFSET_OUT_OF_RANGE, CORRUPT, UNKNOWN_PARTITION, TOO_LARGE = 1, 2, 3, 10
OUT_OF_ORDER, UNSUPPORTED_FORMAT, INVALID_EPOCH = 45, 43, 90
HEADER = 61


def validate(batches: DataFrame, max_bytes: int) -> DataFrame:
    """Adds error_code: of part, n_parts, raw_length, declared_length, magic the first failing check; 0: none."""
    code = (
        F.when((F.col("part") < 0) | (F.col("part") >= F.col("n_parts")), UNKNOWN_PARTITION)
        .when(F.col("raw_length") < HEADER, CORRUPT)
        .when(F.col("declared_length") != F.col("raw_length") - 12, CORRUPT)
        .when(F.col("magic") != 2, UNSUPPORTED_FORMAT)
        .when(F.col("raw_length") > max_bytes, TOO_LARGE)
        .otherwise(0)
    )
    return batches.withColumn("error_code", code)


def append_time(records: DataFrame, now_ms: int | Column, by_append: Column) -> DataFrame:
    """Time stamps become ``now_ms`` where ``by_append`` holds."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return records.withColumn("ts_ms", F.when(by_append, now).otherwise(F.col("ts_ms")))


def stamp_batches(batches: DataFrame, now_ms: int | Column, by_append: Column) -> DataFrame:
    """Where ``by_append`` holds, both times of a batch become ``now_ms`` and its attributes say so (bit 3)."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    stamped = {c: F.when(by_append, now).otherwise(F.col(c)) for c in ("base_ts", "max_ts")}
    return batches.withColumns({**stamped, "attributes": F.when(by_append, F.col("attributes").bitwiseOR(F.lit(8))).otherwise(F.col("attributes"))})


def assign_offsets(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: Column, bucket: Column, prior: DataFrame | None = None) -> DataFrame:
    """Adds base_offset: dense offsets per partition in the given order, ``size`` for each row, after ``prior`` (by, hw).

    ``bucket`` must not fall as ``order`` rises; sums go in two levels by it.
    """
    rows = running(rows, by, order, bucket, size.cast("long"), "__base")
    base = F.col("__base")
    if prior is not None:
        rows = rows.join(prior.select(*by, F.col("hw").alias("__hw")), list(by), "left")
        base = base + F.coalesce("__hw", F.lit(0))
    return rows.withColumn("base_offset", base.cast("long")).drop("__base", "__hw")


def object_numbers(batches: DataFrame, target_bytes: int, width: int = 65_536) -> DataFrame:
    """Adds object_no: batches of a partition in order fill objects of about ``target_bytes``, each as it begins there."""
    rows = running(batches, ["part"], ["base_offset"], F.floor(F.col("base_offset") / width), F.col("batch_length"), "__bytes")
    return rows.withColumn("object_no", F.floor(F.col("__bytes") / target_bytes).cast("long")).drop("__bytes")


def flush_due(partitions: DataFrame, target_bytes: int, interval_ms: int, now_ms: int | Column, everything: bool = False) -> DataFrame:
    """Partitions (part, sealed_bytes, oldest_ms) to flush now; adds whole: with the open chunk too.

    Enough sealed bytes flush what is sealed; what waits for the interval, or
    a flush of everything, takes all.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    full = F.col("sealed_bytes") >= target_bytes
    old = F.coalesce(now - F.col("oldest_ms") >= interval_ms, F.lit(False))
    return partitions.where(full | old | F.lit(everything)).withColumn("whole", F.lit(everything) | ~full)


def first_sends(sends: DataFrame) -> DataFrame:
    """Of sends with one sequence (part, producer_id, seq) the first to arrive; adds n_sends."""
    return sends.groupBy("part", "producer_id", "seq").agg(F.min_by("off", "arrival").alias("off"), F.count(F.lit(1)).alias("n_sends"))


def classify_sends(sends: DataFrame) -> DataFrame:
    """Adds status by the sequence expected after the largest so far: accepted, duplicate or gap."""
    so_far = Window.partitionBy("part", "producer_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.max("seq").over(so_far) + 1, F.lit(0))
    return sends.withColumn("status", F.when(F.col("seq") == expected, "accepted").when(F.col("seq") < expected, "duplicate").otherwise("gap"))


class Producer:
    """What a producer has sent: its epoch, and for each partition the next sequence and the last four batches."""

    KEPT = 4

    def __init__(self):
        self.epoch: int | None = None
        self.parts: dict[int, tuple[int, list[tuple[int, int, int]]]] = {}

    def accept(self, part: int, epoch: int, seq: int, n: int, offset: int) -> tuple[int, int, bool]:
        """(error code, offset, duplicate) of a batch; an accepted one enters the state.

        The first batch of an unknown producer may begin anywhere. A lower
        epoch is fenced in all partitions; a higher one must begin at 0 and
        clears them all. A known producer begins a new partition at 0.
        """
        known = self.epoch is not None
        if known and epoch < self.epoch:
            return INVALID_EPOCH, -1, False
        if known and epoch > self.epoch:
            if seq != 0:
                return OUT_OF_ORDER, -1, False
            self.parts = {}
        expected, kept = self.parts.get(part, (0 if known else seq, []))
        for s, m, o in kept:
            if (s, m) == (seq, n):
                return 0, o, True
        if seq != expected:
            return OUT_OF_ORDER, -1, False
        self.epoch = epoch
        self.parts[part] = seq + n, [*kept[-(self.KEPT - 1) :], (seq, n, offset)]
        return 0, offset, False


VERDICT = "error_code int, result_offset long, duplicate boolean"


def dedup_exact(sends: DataFrame) -> DataFrame:
    """Each producer's batches (part, producer_id, epoch, seq, n, arrival, off) against what it has sent before, in order of arrival.

    Adds error_code, result_offset and duplicate. Rows without a producer (id
    or sequence below 0) pass and aren't shuffled. A producer's epoch holds
    across partitions, so its batches go through one task, in a stream of
    sorted rows: memory holds the state of one producer and one Arrow batch.
    """
    sends = sends.select("part", "producer_id", "epoch", "seq", "n", "arrival", "off")
    own = (F.col("producer_id") >= 0) & (F.col("seq") >= 0)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sends.schema)

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, Producer()
        for rows in chunks:
            found = []
            for r in rows.itertuples():
                if r.producer_id != now:
                    now, state = r.producer_id, Producer()
                found.append(state.accept(r.part, r.epoch, r.seq, r.n, r.off))
            yield rows.assign(**{c: [x[i] for x in found] for i, c in enumerate(("error_code", "result_offset", "duplicate"))})

    sorted_ = sends.where(own).repartition("producer_id").sortWithinPartitions("producer_id", "arrival")
    free = sends.where(~F.coalesce(own, F.lit(False)))
    return sorted_.mapInPandas(run, f"{names}, {VERDICT}").unionByName(free.select("*", F.lit(0).alias("error_code"), F.col("off").alias("result_offset"), F.lit(False).alias("duplicate")))


def append(batches: DataFrame, max_bytes: int, prior: DataFrame | None = None, bucket: Column | None = None) -> DataFrame:
    """The answer to a produce request: validation, deduplication and offsets in one pass over batches in order of arrival.

    batches: part, n_parts, raw_length, declared_length, magic, producer_id,
    epoch, seq, n, arrival (unique). prior: part, hw. bucket: of arrival, for
    the two levels of the sums. Returns part, arrival, error_code,
    base_offset (-1 where refused; that of the first send for a duplicate) and
    duplicate; acks = 0, where there is such a column, gets no answer.
    """
    checked = validate(batches, max_bytes)
    refused = checked.where("error_code <> 0").select("part", "arrival", "error_code", F.lit(-1).cast("long").alias("base_offset"), F.lit(False).alias("duplicate"))
    good = dedup_exact(checked.where("error_code = 0").withColumn("off", F.col("arrival")))
    new = good.where("error_code = 0 AND NOT duplicate")
    placed = assign_offsets(new, ["part"], ["arrival"], F.col("n"), F.floor(F.col("arrival") / 65_536) if bucket is None else bucket, prior)
    where = placed.select("part", F.col("arrival").alias("result_offset"), "base_offset")
    answered = good.join(where, ["part", "result_offset"], "left").select("part", "arrival", "error_code", F.coalesce("base_offset", F.lit(-1)).cast("long").alias("base_offset"), "duplicate")
    out = answered.unionByName(refused)
    if "acks" in batches.columns:
        out = out.join(batches.where("acks <> 0").select("arrival"), "arrival", "left_semi")
    return out


def contiguous_hw(batches: DataFrame, by: Sequence[str] = ("part",), width: int = 65_536) -> DataFrame:
    """hw per partition: the end of the commits without a gap from offset 0, whatever their order."""
    rows = running(batches, by, ["base_offset"], F.floor(F.col("base_offset") / width), F.col("last_offset") + 1, "__before", "max")
    before = F.coalesce("__before", F.lit(0))
    gap = F.min(F.when(F.col("base_offset") > before, before))
    return rows.groupBy(*by).agg(F.coalesce(gap, F.max(F.col("last_offset") + 1)).alias("hw"))


def new_topics(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Topics to create: requested names that the catalog lacks."""
    return requested.select("name").distinct().join(catalog.select("name"), "name", "left_anti")


def partition_of(key: Column, n: int) -> Column:
    """A client-side partitioner: by the first 32 bits of the key's MD5, which any client can compute."""
    return (F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("long") % n).cast("int")
