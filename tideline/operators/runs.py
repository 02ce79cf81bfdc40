"""Running sums and as-of lookups that spread over tasks, however few partitions a log has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str, how: str = "sum") -> DataFrame:
    """Adds ``name``: the sum or max of ``value`` over all earlier rows of the group (0 or null without any).

    ``bucket`` must not fall as ``order`` rises. Values go over buckets first,
    one row each, and inside buckets then; no window holds more than the
    buckets of a group or the rows of a bucket.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = rows.withColumns({"__value": value, "__bucket": bucket})
    sums = rows.groupBy(*by, "__bucket").agg(fold("__value").alias("__all"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__bucket", fold("__all").over(earlier).alias("__earlier"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", fold("__value").over(inside)).join(sums, [*by, "__bucket"])
    both = F.coalesce("__earlier", F.lit(0)) + F.coalesce("__inside", F.lit(0)) if how == "sum" else F.greatest("__earlier", "__inside")
    return rows.withColumn(name, both).drop("__value", "__bucket", "__earlier", "__inside")


def as_of(points: DataFrame, steps: DataFrame, by: Sequence[str], at: Column, step: Column, width: int, found: Column, name: str) -> DataFrame:
    """Adds ``name`` to the points: ``found`` of the last step of the group that isn't above ``at``; null without one.

    Points meet the steps of their own bucket of ``width`` by equality. Where
    none of those fits, the last step of the bucket before counts: buckets and
    points, not steps, go through one window for that.
    """
    place = lambda x: F.floor(x / width)
    steps = steps.select(*by, step.alias("__step"), place(step).alias("__bucket"), found.alias("__found"))
    points = points.withColumns({"__at": at, "__bucket": place(at)})
    keyed = points.select(*by, "__at", "__bucket").distinct()
    near = keyed.join(steps, [*by, "__bucket"]).where("__step <= __at").groupBy(*by, "__at").agg(F.max_by("__found", "__step").alias("__near"))
    ends = steps.groupBy(*by, "__bucket").agg(F.max_by("__found", "__step").alias("__far"))
    none = F.lit(None).cast(steps.schema["__found"].dataType)
    line = ends.select(*by, "__bucket", F.struct(F.col("__far").alias("x")).alias("__end")).unionByName(keyed.select(*by, "__bucket").distinct().select(*by, "__bucket", F.when(F.lit(False), F.struct(none.alias("x"))).alias("__end")))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rangeBetween(Window.unboundedPreceding, -1)
    far = line.withColumn("__far", F.last("__end", ignorenulls=True).over(earlier)["x"]).where("__end IS NULL").select(*by, "__bucket", "__far")
    out = points.join(far, [*by, "__bucket"], "left").join(near, [*by, "__at"], "left")
    return out.withColumn(name, F.coalesce("__near", "__far")).drop("__at", "__bucket", "__near", "__far")
