"""Mixing sources to target weights: a time-varying curriculum."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORDS, Scratch

#: Weight of a source over training time, as (time, factor) knots, by the place of its weight in the cycle: the
#: first fades, the second stays, the third grows. Each has mean 1, so that a source's whole demand is its target.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear weight reaches ``share`` of its whole."""
    parts, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        parts.append((t0, t1, w0, w1, total))
        total += (t1 - t0) * (w0 + w1) / 2
    if not total > 0:
        raise ValueError("a schedule needs a positive integral")
    out = F.lit(float(knots[-1][0]))
    for t0, t1, w0, w1, before in reversed(parts):
        slope = (w1 - w0) / (t1 - t0) if t1 > t0 else 0.0
        area = F.greatest(share * total - F.lit(before), F.lit(0.0))
        if slope:
            root = (F.sqrt(F.greatest(F.lit(w0 * w0) + area * (2 * slope), F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        else:
            root = area / F.lit(w0) if w0 else F.lit(0.0)
        end = before + (t1 - t0) * (w0 + w1) / 2
        out = F.when(share * total < F.lit(end), F.lit(t0) + root).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], limit: float, scratch: Scratch) -> DataFrame:
    """source, source_size, docs -> also weight, place and target; sources rank by code point, null last.

    A target is the source's weighted share of all sizes, at most ``limit``
    times its own size; what it can't take is reshared by weight among the
    rest, again and again until none is above. Each round is one aggregation
    that sends the driver three numbers.
    """
    ranked = sizes.withColumn("__first", F.coalesce(F.substring("source", 1, 1), F.lit("")))
    # Two levels, so that no task ranks more than the sources of one first character and the counts of characters.
    inside = F.row_number().over(Window.partitionBy("__null", "__first").orderBy("source"))
    ranked = ranked.withColumn("__null", F.col("source").isNull()).withColumn("__in", inside)
    firsts = ranked.groupBy("__null", "__first").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__null", "__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(firsts.withColumn("__before", before).drop("__n"), ["__null", "__first"])
    place = (F.col("__before") + F.col("__in") - 1) % F.lit(len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    table = scratch.save(ranked.select("source", "source_size", place.cast("int").alias("place"), weight.alias("weight"), (F.col("source_size") * float(limit)).alias("__cap")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    above, filled, free, n = F.lit(False), 0.0, 0.0, -1
    target = F.lit(0.0)
    while True:
        x = table.agg(F.sum(F.when(above, F.col("__cap")).otherwise(0.0)), F.sum(F.when(above, F.lit(0.0)).otherwise(F.col("weight"))), F.count(F.when(above, 1))).first()
        filled, free, held = x[0] or 0.0, x[1] or 0.0, x[2]
        if held == n:
            break
        n = held
        share = F.lit(float(total) - filled) * F.col("weight") / F.lit(free) if free else F.col("__cap")
        target = F.when(above, F.col("__cap")).otherwise(share)
        above = target >= F.col("__cap")
    return table.select("source", "source_size", "place", "weight", F.least(target, F.col("__cap")).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: int = 3, schedules: Sequence = SCHEDULES, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, the ``carry`` columns, size, source_size, target, taken and uses.

    ``uses`` lists (pass, words, position): the words that the mix takes of
    the document in each pass over its source, and the training position of
    that copy. A source is passed over whole as often as its target holds its
    size; the last pass takes documents in the order of a hash until the
    target is met, and cuts one document there. So each source's taken words
    are its rounded target, and no document exceeds ``limit`` times its size.

    Positions follow a curriculum. Each source's weight is a schedule over
    training time; its integral is the source's token demand so far. A copy's
    cumulative tokens, as a share of the target, go through the inverse of
    that integral to give the time in [0, 1] at which it is due.

    Running sums are made in two levels, inside and over hash buckets of a
    source, so a source of any size spreads over many tasks. Null sources
    make one source, last in order. A null doc_id is an id like any other;
    repeated rows are documents of their own. Null or wordless texts have
    size 0, taken 0 and no uses. Rows of one doc_id and size go in the order
    of a hash of their text, so reruns agree. An empty table gives no rows.

    ``carry`` columns, which may hold the texts, go into no scratch table:
    with them ``docs`` is read and measured twice.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    carry = [c for c in carry or [] if c not in ("doc_id", "source")]
    size = n_words(F.col("text"))
    key = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string"))), 1, 16)
    measure = lambda more: docs.select("doc_id", "source", *more, size.alias("size"), F.xxhash64("text").alias("__text")).withColumn("__key", key)
    sized = scratch.save(measure([]), "sized")

    n = sized.count()
    digits = min(4, max(1, math.ceil(math.log(max(n / 2000, 1), 16))))
    bucket = F.substring("__key", 1, digits)
    buckets = scratch.save(sized.groupBy("source", bucket.alias("__bucket")).agg(F.sum("size").alias("__words")), "buckets")
    sources = source_targets(buckets.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, limit, scratch)
    earlier = F.coalesce(F.sum("__words").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Null sources never meet in a join: a flag and an empty name stand for them.
    named = [F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__name")]
    starts = buckets.withColumn("__start", earlier).select(*named, "__bucket", "__start").join(sources.select(*named, "source_size", "place", "target"), ["__null", "__name"])

    within = Window.partitionBy("__null", "__name", "__bucket").orderBy("__key", "doc_id", "size", "__text").rowsBetween(Window.unboundedPreceding, -1)
    rows = (measure(carry) if carry else sized).select("*", *named, bucket.alias("__bucket")).withColumn("__in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, ["__null", "__name", "__bucket"])
    start = F.col("__start") + F.col("__in")
    goal = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.least(F.greatest(goal - whole * F.col("source_size") - F.col("__from"), F.lit(0)), F.col("size")).cast("long")
    rows = rows.withColumns({"__from": start, "__goal": goal, "__whole": whole}).withColumn("__rest", rest)

    def position(begin: Column, words: Column) -> Column:
        share = F.try_divide(begin + words / F.lit(2.0), F.col("__goal"))
        out = F.lit(0.0)
        for i in range(len(weights)):
            out = F.when(F.col("place") == i, inverse_demand(share, schedules[i % len(schedules)])).otherwise(out)
        return out

    def use(i: int) -> Column:
        words = F.when(F.lit(i) < F.col("__whole"), F.col("size")).when(F.col("__whole") == i, F.col("__rest")).otherwise(0).cast("long")
        begin = F.col("__from") + F.col("source_size") * i
        return F.struct(F.lit(i).alias("pass"), words.alias("words"), position(begin, words).alias("position"))

    uses = F.filter(F.array(*[use(i) for i in range(math.ceil(limit) + 1)]), lambda x: x["words"] > 0)
    taken = F.col("__whole") * F.col("size") + F.col("__rest")
    return rows.select("doc_id", "source", *carry, "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), uses.alias("uses"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: a row of ``docs``' columns for each use of a document, range-sorted by training position.

    A cut copy holds the first words of its document, joined by single
    spaces. Adds pass and position (mix_pass and mix_position where ``docs``
    has columns of these names).
    """
    rest = [c for c in docs.columns if c != "text"]  # the text travels once
    whole = docs.select("doc_id", "source", "text", F.struct(*rest).alias("__doc"))
    used = mix_plan(whole, carry=["text", "__doc"], **how).withColumn("__use", F.explode("uses"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), F.col("__use.words").cast("int")), " ")
    text = F.when(F.col("__use.words") >= F.col("size"), F.col("text")).otherwise(head)
    columns = [text.alias(c) if c == "text" else F.col("__doc")[c].alias(c) for c in docs.columns]
    added = [F.col("__use")[c].alias(f"mix_{c}" if c in docs.columns else c) for c in ("pass", "position")]
    out = used.select(*columns, *added)
    return out.orderBy(out.columns[-1], "doc_id", out.columns[-2])
