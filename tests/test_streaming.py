"""Streams that stop and start again."""

import random
import tempfile

from tideline.streaming import jobs


def test_compaction_goes_on_after_a_restart(spark):
    r = random.Random(2)
    rows = [(i % 2, i, r.choice([None, "a", "b", "c", "d"]), f"v{i}", i) for i in range(60)]
    schema = "part int, off long, k string, v string, ts_ms long"
    folder, source = tempfile.mkdtemp(), tempfile.mkdtemp()

    def run(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{source}/log")
        stream = spark.readStream.schema(schema).parquet(f"{source}/log")
        return {(x.part, x.off) for x in jobs.compact(stream, spark, f"file://{folder}").collect()}

    last = {}
    for i, (a, b) in enumerate(((0, 30), (30, 45), (45, 60))):
        got = run(rows[a:b])  # a new query each time, from the same checkpoint
        for p, off, k, *_ in rows[a:b]:
            last[p, k if k is not None else off] = (p, off)
        assert got == set(last.values())
        assert len(jobs.snapshots(spark, f"file://{folder}")) == min(i + 1, 2)
