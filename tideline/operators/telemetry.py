"""Throughput and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_percentile(values: Column, p: float) -> Column:
    """sorted[min(floor(p * n), n - 1)] of an array in order."""
    return F.element_at(values, (F.least(F.floor(F.size(values) * F.lit(p)), F.size(values) - 1) + 1).cast("int"))


def percentiles(rows: DataFrame, by: list[str], column: str, points: dict[str, float]) -> DataFrame:
    """Percentiles by rank of each group, by counts of distinct values.

    Values are counted first and ranked by their running count, so no group's
    values gather in one array.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__c"))
    part = Window.partitionBy(*by)
    run = F.sum("__c").over(part.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumns({"__run": run, "__n": F.sum("__c").over(part)})
    out = [F.min(F.when(F.col("__run") > F.least(F.floor(F.col("__n") * F.lit(p)), F.col("__n") - 1), F.col(column))).alias(k) for k, p in points.items()]
    return counts.groupBy(*by).agg(*out)


def window_stats(rows: DataFrame, width_ms: int, ts: str = "ts_ms", size: str = "bytes") -> DataFrame:
    """Aligned tumbling windows: records, bytes, rates, and running totals.

    The running total goes over windows, one row each.
    """
    start = (F.floor(F.col(ts) / width_ms) * width_ms).cast("long")
    stats = rows.groupBy(start.alias("window_ms")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))
    so_far = Window.orderBy("window_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = lambda x: x * F.lit(1000.0) / F.lit(float(width_ms))
    return stats.select("window_ms", "n", "bytes", rate(F.col("n")).alias("per_s"), (rate(F.col("bytes")) / F.lit(1048576.0)).alias("mib_per_s"), F.sum("n").over(so_far).alias("c_n"), F.sum("bytes").over(so_far).alias("c_bytes"))


def window_latency(rows: DataFrame, width_ms: int, ts: str = "ts_ms", latency: str = "latency_ms", points: dict[str, float] | None = None) -> DataFrame:
    """window_ms, avg_ms, p50_ms to p999_ms and max_ms of each aligned window, and cumulative c_avg_ms and c_max_ms.

    The running values go over windows, one row each.
    """
    points = points or {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99, "p999_ms": 0.999}
    rows = rows.select((F.floor(F.col(ts) / width_ms) * width_ms).cast("long").alias("window_ms"), F.col(latency).alias("__x"))
    stats = rows.groupBy("window_ms").agg(F.sum("__x").alias("__sum"), F.count("__x").alias("__n"), F.max("__x").alias("max_ms"))
    ranks = percentiles(rows, ["window_ms"], "__x", points)
    so_far = Window.orderBy("window_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.sum("__sum").over(so_far) / F.greatest(F.sum("__n").over(so_far), F.lit(1))
    return stats.join(ranks, "window_ms", "left").select("window_ms", (F.col("__sum") / F.greatest(F.col("__n"), F.lit(1))).alias("avg_ms"), *points, "max_ms", mean.alias("c_avg_ms"), F.max("max_ms").over(so_far).alias("c_max_ms"))


def due_ms(nth: Column, per_second: float) -> Column:
    """Milliseconds after the start at which a throttled producer may send its ``nth`` record (from 0); 0 where unthrottled."""
    return F.floor(nth * F.lit(1000.0) / F.lit(per_second)).cast("long") if per_second > 0 else F.lit(0).cast("long")


def latency_ms(sent_ns: Column, received_ns: Column) -> Column:
    """Whole milliseconds, never negative."""
    return F.greatest(F.lit(0), F.floor((received_ns - sent_ns) / 1_000_000)).cast("long")


def decode_key(key: Column) -> tuple[Column, Column]:
    """measured, sent_ns from a key of one flag byte and eight big-endian bytes."""
    return F.hex(F.substring(key, 1, 1)) == "01", F.conv(F.hex(F.substring(key, 2, 8)), 16, 10).cast("long")


def encode_key(measured: Column, sent_ns: Column) -> Column:
    return F.unhex(F.concat(F.when(measured, "01").otherwise("00"), F.lpad(F.hex(sent_ns), 16, "0")))


def completeness(produced: DataFrame, consumed: DataFrame, by: list[str]) -> DataFrame:
    """Counts of both sides of each group, and whether they agree."""
    p, c = (x.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for x, n in ((produced, "produced"), (consumed, "consumed")))
    both = p.join(c, by, "full")
    return both.select(*by, F.coalesce("produced", F.lit(0)).alias("produced"), F.coalesce("consumed", F.lit(0)).alias("consumed"), F.expr("produced <=> consumed").alias("complete"))


def consumed_bytes(log: DataFrame, by: list[str]) -> DataFrame:
    size = F.coalesce(F.octet_length("k"), F.lit(0)) + F.coalesce(F.octet_length("v"), F.lit(0))
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))


def storage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Monthly cost of each provider: requests by the thousand, storage by the GiB.

    usage: one row, puts, gets, lists, gib; prices: provider, put, get, list
    (for a thousand), gib.
    """
    kilo = lambda n, p: F.col(n) / F.lit(1000.0) * F.col(p)
    rows = prices.join(F.broadcast(usage))  # one row
    parts = [kilo("puts", "put").alias("put_cost"), kilo("gets", "get").alias("get_cost"), kilo("lists", "list").alias("list_cost"), (F.col("gib") * F.col("gib_price")).alias("storage_cost")]
    return rows.select("provider", *parts).withColumn("total", F.col("put_cost") + F.col("get_cost") + F.col("list_cost") + F.col("storage_cost"))


def work_share(total: Column, workers: Column, worker: Column) -> Column:
    """The part of ``total`` for a worker (from 0): even, the remainder to the first ones."""
    return F.floor(total / workers).cast("long") + F.when(worker < total % workers, 1).otherwise(0)


#: Domains of the payload's fields; fixed values.
SOURCES = ("api", "web", "worker", "billing", "search", "auth", "orders", "gateway")
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
STATUS = (200, 200, 200, 200, 201, 204, 400, 404, 500)


def payloads(ids: DataFrame, size: int, now: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """JSON events of exactly ``size`` characters, made from ``id``: nested meta, a list of tags, padding in msg.

    An event that is longer without padding stays as it is.
    """
    h = lambda salt: F.xxhash64("id", F.lit(salt))
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(h(salt), F.lit(len(values))) + 1).cast("int"))
    number = lambda salt, lo, hi: (F.pmod(h(salt), F.lit(hi - lo + 1)) + lo).cast("int")
    name = lambda salt, prefix: F.concat(F.lit(prefix), F.lower(F.lpad(F.hex(h(salt)), 16, "0")))
    meta = F.struct(number("cart", 1, 20).alias("cart_items"), number("cents", 100, 99_999).alias("total_cents"), pick("cur", ("USD", "EUR", "GBP", "JPY")).alias("currency"), number("retry", 0, 2).alias("retry"))
    fields = [
        F.lit(now).alias("ts"),
        name("id", "").alias("id"),
        pick("src", SOURCES).alias("src"),
        pick("env", ("prod", "staging", "dev")).alias("env"),
        pick("level", LEVELS).alias("level"),
        name("user", "usr_").alias("user_id"),
        name("session", "ses_").alias("session"),
        name("request", "req_").alias("request_id"),
        pick("method", METHODS).alias("method"),
        pick("status", STATUS).alias("status"),
        number("ms", 1, 500).alias("duration_ms"),
        number("bytes", 100, 9_999).alias("payload_bytes"),
        F.array(pick("t1", ("a", "b")), pick("t2", ("c", "d")), pick("t3", ("e", "f"))).alias("tags"),
        meta.alias("meta"),
    ]
    bare = F.length(F.to_json(F.struct(*fields, F.lit("").alias("msg"))))
    pad = F.rpad(F.sha2(h("pad").cast("string"), 256), F.greatest(F.lit(size) - bare, F.lit(0)), F.sha2(h("more").cast("string"), 256))
    return ids.select("id", F.to_json(F.struct(*fields, pad.alias("msg"))).alias("value"))
