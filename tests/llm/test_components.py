import random

import pytest

from pyspark.sql import functions as F

from tideline.llm._common import Scratch, attach, components


@pytest.mark.parametrize("kind", ["none", "path", "random", "star", "cycle"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {
        "none": [(5, 5)],
        "path": [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)],
        "random": [(r.randint(-50, 300), r.randint(-50, 300)) for _ in range(180)],
        "star": [(1, 5000 + i) for i in range(1500)] + [(9000, 5003), (9000, 8)],
        "cycle": [(i, (i + 1) % 40) for i in range(40)] * 2,
    }[kind]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    got = {n: c for n, c in out}
    assert len(got) == len(out)
    assert {n: got.get(n, n) for n in root} == {n: find(n) for n in root}


def test_attach_deals_a_hot_key_out(spark):
    """Half of the rows have one key; no task of the shuffled join reads twice the mean."""
    n, parts = 40_000, 8
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(before, ("false", str(parts), "-1"), strict=True):
            spark.conf.set(c, v)
        out = attach(rows, groups, ["k"], "n", ["m"], n, ["v"])
        assert "__salt" in str(out._jdf.queryExecution().executedPlan()).split("SortMergeJoin", 1)[1].split("\n", 1)[0]
        sizes = out.groupBy(F.spark_partition_id()).agg(F.count("m").alias("n")).collect()
        assert len(sizes) == parts and max(x["n"] for x in sizes) < 2 * n / parts
        assert out.where("m <> CASE WHEN k = -1 THEN 0 ELSE k END").count() == 0
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
