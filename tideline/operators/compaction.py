"""Key compaction: keep the latest record of each key, with tombstones, windows and bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, by: tuple[str, ...] = ("part",), key: str = "k", keep_null: bool = True, window: str | None = None, control: str | None = None) -> DataFrame:
    """Records that no later one of the same key replaces.

    Null keys are never replaced (or all dropped, without ``keep_null``), and
    neither are control records. With ``window`` only records of one window
    replace each other. The latest offset of each key is found by an
    aggregation with map-side combine and joined back by offset, so a key may
    hold any share of the log.
    """
    groups = [*by, *([window] if window else []), key]
    free = F.col(key).isNull() | (F.col(control) if control else F.lit(False))
    keyed = log.where(~free)
    winners = keyed.groupBy(*groups).agg(F.max("off").alias("off")).select(*by, "off")
    kept = keyed.join(winners, [*by, "off"], "left_semi")
    return kept.unionByName(log.where(free)) if keep_null else kept


def expire_tombstones(kept: DataFrame, now_ms: int | Column, retention_ms: int, key: str = "k", value: str = "v", ts: str = "ts_ms") -> DataFrame:
    """Drops latest records without a value that are older than the retention (strictly); 0 switches this off."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    gone = F.col(key).isNotNull() & F.col(value).isNull() & F.lit(retention_ms > 0) & (F.col(ts) > 0) & (now - F.col(ts) > retention_ms)
    return kept.where(~gone)


def record_time(by_append: Column) -> Column:
    """The time that tombstones age by: the batch's largest where the broker stamps, else the record's own."""
    return F.when(by_append, F.col("max_ts")).otherwise(F.col("ts_ms"))


def two_pass(log: DataFrame, by: tuple[str, ...] = ("part",), key: str = "k") -> DataFrame:
    """The two-pass form: an offset map of each key, and a filter by it."""
    offsets = log.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.max("off").alias("__last"))
    return log.join(offsets, [*by, key], "left").where(F.col("__last").isNull() | (F.col("off") == F.col("__last"))).drop("__last")


def orphans(objects: DataFrame) -> DataFrame:
    """Objects that end within what earlier ones of the partition cover. The window holds a row for each file."""
    covered = F.max("last_offset").over(Window.partitionBy("part").orderBy("base_offset", F.desc("last_offset"), "object_no").rowsBetween(Window.unboundedPreceding, -1))
    return objects.withColumn("__covered", covered).where("__covered >= last_offset").drop("__covered")


def windows(objects: DataFrame, cleaned: DataFrame, limit: int, now_ms: int | Column, min_lag_ms: int = 0) -> DataFrame:
    """Compaction windows: adds window_id to the objects of each partition from its anchor on.

    The anchor is the last object that begins at or before cleaned_up_to.
    Objects modified within ``min_lag_ms`` are left out, but for the anchor.
    A window takes objects while its bytes stay within ``limit``, one at
    least; windows of one object are dropped. Packing is a fold over the
    partition's list of objects, which is one entry for each file.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    rows = objects.join(cleaned.select("part", "cleaned_up_to"), "part")
    anchor = F.max(F.when(F.col("base_offset") <= F.col("cleaned_up_to"), F.col("base_offset"))).over(Window.partitionBy("part"))
    rows = rows.withColumn("__anchor", anchor)
    old = (now - F.col("modified_ms") >= min_lag_ms) | (F.col("base_offset") == F.col("__anchor"))
    rows = rows.where((F.col("__anchor").isNull() | (F.col("base_offset") >= F.col("__anchor"))) & old)
    parts = F.array_sort(F.collect_list(F.struct("base_offset", "data_size")))
    kind = "struct<id:bigint,used:bigint,out:array<struct<base_offset:bigint,window_id:bigint>>>"
    start = F.struct(F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<base_offset:bigint,window_id:bigint>>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        new = (acc["id"] < 0) | (acc["used"] + x["data_size"] > limit)
        number = F.when(new, acc["id"] + 1).otherwise(acc["id"])
        used = F.when(new, x["data_size"]).otherwise(acc["used"] + x["data_size"])
        item = F.array(F.struct(x["base_offset"].alias("base_offset"), number.alias("window_id")))
        return F.struct(number.alias("id"), used.alias("used"), F.concat(acc["out"], item).alias("out")).cast(kind)

    packed = rows.groupBy("part").agg(F.aggregate(parts, start, step)["out"].alias("x")).select("part", F.explode("x").alias("x")).select("part", "x.base_offset", "x.window_id")
    sizes = packed.groupBy("part", "window_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part", "window_id")
    return packed.join(sizes, ["part", "window_id"])


def cleaned_up_to(sources: DataFrame, kept: DataFrame) -> DataFrame:
    """part, window_id, watermark after compaction of windows: the last offset that is left of one, or that it had if nothing is left.

    sources: part, window_id, last_offset of the objects; kept: part,
    window_id, off of the records that stay.
    """
    had = sources.groupBy("part", "window_id").agg(F.max("last_offset").alias("__had"))
    left = kept.groupBy("part", "window_id").agg(F.max("off").alias("__left"))
    return had.join(left, ["part", "window_id"], "left").select("part", "window_id", F.coalesce("__left", "__had").alias("watermark"))


def dirtiest(candidates: DataFrame, now_ms: int | Column, min_dirty: int) -> DataFrame:
    """The partition to compact next: eligible and with the most dirty objects; of equals the first.

    candidates: part, policy, dirty, ever_compacted, last_compacted_ms,
    max_lag_ms (null: never forced).
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    stale = F.coalesce(now - F.col("last_compacted_ms") > F.col("max_lag_ms"), F.lit(False))
    eligible = F.contains("policy", F.lit("compact")) & ((F.col("dirty") >= min_dirty) | ((F.col("dirty") > 0) & (~F.col("ever_compacted") | stale)))
    return candidates.where(eligible).orderBy(F.desc("dirty"), "part").limit(1)


def backoff(failures: Column, base_ms: int, cap_ms: int = 3_600_000) -> Column:
    """Wait after so many failures: doubling from the base, capped; 0 without any."""
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), (failures - 1).cast("double")), F.lit(float(cap_ms)))).cast("long")


def dirty_counts(objects: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Objects behind cleaned_up_to, for each partition."""
    return objects.join(cleaned, "part").groupBy("part").agg(F.count_if(F.col("base_offset") > F.col("cleaned_up_to")).alias("dirty"))
