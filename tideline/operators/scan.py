"""Fetch: range checks, byte limits, visibility, tiers, lookups of objects and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import OFFSET_OUT_OF_RANGE
from .runs import as_of, running


def range_check(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Adds error_code to (request_id, part, off) against state (part, log_start, hw): 1 outside [log_start, hw]; at hw: empty."""
    joined = requests.join(state, "part", "left")
    bad = F.col("hw").isNull() | (F.col("off") < F.col("log_start")) | (F.col("off") > F.col("hw"))
    return joined.withColumn("error_code", F.when(F.col("hw").isNull(), 3).when(bad, OFFSET_OUT_OF_RANGE).otherwise(0))


def fetch(batches: DataFrame, requests: DataFrame, width: int = 65_536, span: int = 1 << 20) -> DataFrame:
    """Batches of each request (request_id, part, off, max_bytes): from the one that holds off on, the first always, then while their bytes fit.

    The first batch is looked up, and the place in bytes where it begins; the
    others lie within max_bytes of it, so a request meets only the batches of
    the stretches of ``span`` bytes that it covers.
    """
    rows = running(batches, ["part"], ["base_offset"], F.floor(F.col("base_offset") / width), F.col("batch_length"), "__begin")
    first = locate_batch(rows, requests, width, "__begin").where("base_offset IS NOT NULL")
    wanted = first.select(*requests.columns, F.col("base_offset").alias("__first"), F.col("__begin").alias("__from"))
    wanted = wanted.withColumn("__span", F.explode(F.sequence(F.floor(F.col("__from") / span), F.floor((F.col("__from") + F.col("max_bytes")) / span))))
    both = wanted.join(rows.withColumn("__span", F.floor(F.col("__begin") / span)), ["part", "__span"])
    total = F.col("__begin") + F.col("batch_length") - F.col("__from")
    fits = (F.col("base_offset") == F.col("__first")) | ((F.col("base_offset") > F.col("__first")) & (total <= F.col("max_bytes")))
    return both.where(fits).withColumn("running_bytes", total).drop("__span", "__first", "__from", "__begin")


def fetch_response(batches: DataFrame, requests: DataFrame, state: DataFrame, limit: int, committed: bool = False) -> DataFrame:
    """The answer to a fetch of several partitions: request_id, part, error_code, hw, lso, n_batches, bytes, kept.

    requests: response_id, seq, request_id, part, off, max_bytes; state: part,
    log_start, hw, lso. Each partition is checked, read up to the high
    watermark (the last stable offset if ``committed``) and its own limit;
    then the response is trimmed to ``limit`` bytes in the order of seq.
    Unknown partitions get error 3 and no watermarks.
    """
    checked = range_check(requests, state)
    end = F.col("lso") if committed else F.col("hw")
    readable = batches.join(state.select("part", end.alias("__end")), "part").where("last_offset < __end").drop("__end")
    good = checked.where("error_code = 0").select(*requests.columns)
    sizes = fetch(readable, good).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("batch_length").cast("long").alias("bytes"))
    rows = checked.join(sizes, "request_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    kept = trim_response(rows.select("response_id", "seq", F.col("bytes").alias("size")), limit).select("response_id", "seq", F.lit(True).alias("__kept"))
    rows = rows.join(kept, ["response_id", "seq"], "left")
    there = F.coalesce("__kept", F.lit(False))
    mark = lambda c: F.when(F.col("error_code") == 3, -1).otherwise(F.col(c)).cast("long").alias(c)
    return rows.select("request_id", "part", "error_code", mark("hw"), mark("lso"), F.when(there, F.col("n_batches")).otherwise(0).cast("long").alias("n_batches"), F.when(there, F.col("bytes")).otherwise(0).cast("long").alias("bytes"), there.alias("kept"))


def without_skips(found: DataFrame, unflushed: DataFrame) -> DataFrame:
    """Fetched batches (request_id, part, off, base_offset, ...) of the requests that skip no unflushed batch (part, base_offset, last_offset).

    A request whose first batch begins behind its offset, while an unflushed
    batch lies between, would lose that one and gets nothing.
    """
    first = found.groupBy("request_id", "part", "off").agg(F.min("base_offset").alias("__first")).where("__first > off")
    between = unflushed.select("part", F.col("base_offset").alias("__base"), F.col("last_offset").alias("__last"))
    skips = first.join(between, "part").where("__last >= off AND __base < __first").select("request_id").distinct()
    return found.join(skips, "request_id", "left_anti")


def trim_response(sized: DataFrame, limit: int) -> DataFrame:
    """Greedy trimming of a response: of (response_id, seq, size) keeps what still fits, in order; the first non-empty one always.

    One that doesn't fit is skipped, and a later, smaller one may still be kept.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", "size")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<seq:bigint,size:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["size"] > 0) & ((acc["used"] == 0) | (acc["used"] + x["size"] <= limit))
        more = F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["kept"], F.array(F.struct(x["seq"].cast("long").alias("seq"), x["size"].cast("long").alias("size")))).alias("kept"))
        return F.when(fits, more).otherwise(acc)

    folded = sized.groupBy("response_id").agg(F.aggregate(parts, start, step).alias("r"))
    return folded.select("response_id", F.explode("r.kept").alias("x")).select("response_id", "x.seq", "x.size")


def hw_visible(batches: DataFrame, state: DataFrame) -> DataFrame:
    """Batches that end below the high watermark."""
    return batches.join(state.select("part", "hw"), "part").where(F.col("last_offset") + 1 <= F.col("hw")).drop("hw")


def contiguous(batches: DataFrame, width: int = 65_536) -> DataFrame:
    """Batches up to the first gap of each partition."""
    rows = running(batches, ["part"], ["base_offset"], F.floor(F.col("base_offset") / width), F.col("last_offset") + 1, "__end", "max")
    gaps = rows.where("base_offset <> __end").groupBy("part").agg(F.min("base_offset").alias("__gap"))
    return batches.join(gaps, "part", "left").where("__gap IS NULL OR base_offset < __gap").drop("__gap")


def tier_union(*tiers: DataFrame) -> DataFrame:
    """One batch of each (part, base_offset): from the first tier that has it; adds tier."""
    tagged = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    others = [c for c in rows.columns if c not in ("part", "base_offset", "tier")]
    best = rows.groupBy("part", "base_offset").agg(F.min_by(F.struct(*others), "tier").alias("x"), F.min("tier").alias("tier"))
    return best.select("part", "base_offset", "x.*", "tier")


def locate_object(objects: DataFrame, requests: DataFrame, width: int = 1 << 20) -> DataFrame:
    """The object of each request (request_id, part, off): the last that begins at or before it, else the first; and its successor.

    Successors come from a window over the objects of a partition, one row for each file.
    """
    order = Window.partitionBy("part").orderBy("base_offset")
    spans = objects.select("part", "base_offset", F.lead("base_offset").over(order).alias("next_base"))
    found = as_of(requests, spans, ["part"], F.col("off"), F.col("base_offset"), width, F.struct("base_offset", "next_base"), "__object")
    first = spans.groupBy("part").agg(F.min_by(F.struct("base_offset", "next_base"), "base_offset").alias("__first"))
    object_ = F.coalesce("__object", "__first")
    return found.join(first, "part").select(*requests.columns, object_["base_offset"].alias("base_offset"), object_["next_base"].alias("next_base"))


def locate_batch(batches: DataFrame, requests: DataFrame, width: int = 65_536, *more: str) -> DataFrame:
    """The first batch that ends at or behind each request's offset, with its columns ``more``; null where there is none."""
    names = ["base_offset", *more]
    # Backwards, that is the last one that isn't above the offset.
    found = as_of(requests, batches, ["part"], -F.col("off"), -F.col("last_offset"), width, F.struct(*names), "__batch")
    return found.select(*requests.columns, *[F.col("__batch")[c].alias(c) for c in names])


def below_lso(batches: DataFrame, state: DataFrame) -> DataFrame:
    """Batches that begin below the last stable offset."""
    return batches.join(state.select("part", "lso"), "part").where("base_offset < lso").drop("lso")


def aborted_overlap(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """Aborted ranges that overlap each request's [off, until)."""
    return requests.join(ranges.where("outcome = 'abort'"), "part").where("last_offset >= off AND first_offset < until")


def read_committed(records: DataFrame, ranges: DataFrame, state: DataFrame) -> DataFrame:
    """Records below the last stable offset that are in no aborted range of their producer.

    part and producer_id are equalities, so this is a hash anti join with the
    offset range as a condition.
    """
    stable = records.join(state.select("part", "lso"), "part").where("off < lso").drop("lso")
    gone = ranges.where("outcome = 'abort'").select(F.col("part").alias("__part"), F.col("producer_id").alias("__pid"), "first_offset", "last_offset")
    on = (F.col("part") == F.col("__part")) & (F.col("producer_id") == F.col("__pid")) & F.col("off").between(F.col("first_offset"), F.col("last_offset"))
    return stable.join(gone, on, "left_anti")
