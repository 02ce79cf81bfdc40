"""Retention by time and size, truncation, garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import running

WEEK_MS = 604_800_000


def mark_expired(objects: DataFrame, now_ms: int | Column, retention_ms: int | Column, retention_bytes: int | Column) -> DataFrame:
    """Adds by_time, by_size and expired to the objects of each partition.

    by_time: the largest time stamp is older than the retention, wherever the
    object lies. by_size: this object and the newer ones exceed the limit, and
    it isn't the newest. Oldest first, both kinds expire, but one object
    always stays. Negative limits switch a kind off. Windows go over the
    objects of a partition, one row for each file.
    """
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    now, keep_ms, limit = map(as_col, (now_ms, retention_ms, retention_bytes))
    part = Window.partitionBy("part")
    order = part.orderBy("base_offset")
    suffix = F.sum("data_size").over(part.orderBy(F.desc("base_offset")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    newest = F.max("base_offset").over(part)
    rows = objects.withColumns(
        {
            "by_time": (keep_ms >= 0) & (F.col("max_ts") >= 0) & (F.col("max_ts") < now - keep_ms),
            "by_size": (limit >= 0) & (suffix > limit) & (F.col("base_offset") != newest),
            "__n": F.count(F.lit(1)).over(part),
        }
    )
    rank = F.sum((F.col("by_time") | F.col("by_size")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__rank", rank)
    return rows.withColumn("expired", (F.col("by_time") | F.col("by_size")) & (F.col("__rank") <= F.col("__n") - 1)).drop("__n", "__rank")


def select_work(partitions: DataFrame, budget: int, cursor: int = 0) -> DataFrame:
    """The partitions (topic, part, retention_ms, retention_bytes, dirty) that one round of retention looks at; adds turn.

    Those without any limit are left out. Dirty ones come first, in order;
    what is left of the budget goes round the others from ``cursor`` on.
    """
    rows = partitions.where("retention_ms >= 0 OR retention_bytes >= 0")
    rows = running(rows, [], ["topic", "part"], F.substring("topic", 1, 2), F.lit(1), "__place")
    total = rows.agg(F.count(F.lit(1)).alias("__n"))  # one row
    rows = rows.join(F.broadcast(total))
    round_ = F.pmod(F.col("__place") - cursor % F.greatest(F.col("__n"), F.lit(1)), F.col("__n"))
    first = F.struct((~F.col("dirty")).alias("clean"), F.when(F.col("dirty"), F.col("__place")).otherwise(round_).alias("at"))
    chosen = rows.withColumn("__first", first).orderBy("__first").limit(budget)
    return chosen.withColumn("turn", F.row_number().over(Window.orderBy("__first")) - 1).drop("__first", "__place", "__n")


def new_log_start(marked: DataFrame) -> DataFrame:
    """The first offset that survives, for each partition."""
    return marked.where(~F.col("expired")).groupBy("part").agg(F.min("base_offset").alias("log_start"))


def config_long(configs: Column, name: str, default: int) -> Column:
    """A number of a string map; the default where it is missing or isn't one."""
    return F.coalesce(F.try_element_at(configs, F.lit(name)).try_cast("long"), F.lit(default))


def delete_records(state: DataFrame, requests: DataFrame) -> DataFrame:
    """(part, off) against (part, log_start, hw): -1 means hw; outside [log_start, hw] error 1; the log start never falls."""
    rows = requests.join(state.select("part", "log_start", "hw"), "part", "left")
    target = F.when(F.col("off") == -1, F.col("hw")).otherwise(F.col("off"))
    code = F.when(F.col("hw").isNull(), 3).when((target < F.col("log_start")) | (target > F.col("hw")), 1).otherwise(0)
    return rows.select("part", "off", code.alias("error_code"), F.when(code == 0, F.greatest("log_start", target)).otherwise(F.col("log_start")).alias("new_log_start"))


def garbage(pending: DataFrame, directories: DataFrame, live: DataFrame) -> DataFrame:
    """(name, topic_id) to remove: pending deletes and directories of no live topic."""
    return pending.select("name", "topic_id").union(directories.select("name", "topic_id")).distinct().join(live.select("name", "topic_id"), ["name", "topic_id"], "left_anti")
