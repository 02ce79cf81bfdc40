"""Operators against explicit vectors."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import bytes_ as B
from tideline.operators import catalog, compaction, groups, ingest, lookup, retention, scan, telemetry, txn


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    def make(keys, ts=None, values=None):
        data = [(0, i, k, "v" if values is None else values[i], ts[i] if ts else i) for i, k in enumerate(keys)]
        return spark.createDataFrame(data, "part int, off long, k string, v string, ts_ms long")

    return make


def test_latest_per_key(log):
    out = compaction.latest_per_key(log(["A", "B", "C", "A", "B", "D"]))
    assert rows(out.select("k", "off")) == [("A", 3), ("B", 4), ("C", 2), ("D", 5)]
    assert rows(compaction.two_pass(log(["A", "B", "C", "A", "B", "D"])).select("k", "off")) == [("A", 3), ("B", 4), ("C", 2), ("D", 5)]


def test_null_and_empty_keys(log):
    assert {r.off for r in compaction.latest_per_key(log([None, "A", None, "A"])).collect()} == {0, 2, 3}
    assert {r.off for r in compaction.latest_per_key(log(["", "", "A"])).collect()} == {1, 2}


def test_sparse_offsets(log):
    assert {r.off for r in compaction.latest_per_key(log(["A", "B", "A", "C"])).collect()} == {1, 2, 3}


def test_tombstone_at_the_boundary_stays(log):
    kept = compaction.latest_per_key(log(["A", "A", "B"], [1, 99_990_000, 99_995_000], ["x", None, "x"]))
    assert compaction.expire_tombstones(kept, 100_000_000, 10_000).count() == 2
    assert {r.k for r in compaction.expire_tombstones(kept, 100_000_001, 10_000).collect()} == {"B"}
    assert compaction.expire_tombstones(kept, 100_000_001, 0).count() == 2


def test_windows_pack_from_the_anchor(spark):
    o = spark.createDataFrame([(0, b, s, 0) for b, s in ((0, 10), (10, 40), (20, 40), (30, 30), (40, 90), (50, 20))], "part int, base_offset long, data_size long, modified_ms long")
    cleaned = spark.createDataFrame([(0, 15)], "part int, cleaned_up_to long")
    assert rows(compaction.windows(o, cleaned, 100, 1000).select("base_offset", "window_id")) == [(10, 0), (20, 0)]
    assert rows(compaction.windows(o, cleaned, 110, 1000).select("base_offset", "window_id")) == [(10, 0), (20, 0), (30, 0), (40, 1), (50, 1)]


def test_backoff(spark):
    out = spark.createDataFrame([(0,), (1,), (2,), (30,)], "n int").select(compaction.backoff(F.col("n"), 1000))
    assert sorted(r[0] for r in out.collect()) == [0, 1000, 2000, 3_600_000]


def objects(spark, data):
    return spark.createDataFrame([(0, i, b, t, s) for i, (b, t, s) in enumerate(data)], "part int, object_no long, base_offset long, max_ts long, data_size long")


def test_retention(spark):
    timed = retention.mark_expired(objects(spark, [(0, 92_000, 10), (3, 99_000, 10)]), 100_000, 5_000, -1)
    assert rows(retention.new_log_start(timed)) == [(0, 3)]
    sized = retention.mark_expired(objects(spark, [(0, 1, 10), (1, 1, 10), (2, 1, 10)]), 100_000, -1, 11)
    assert rows(retention.new_log_start(sized)) == [(0, 2)]
    both = retention.mark_expired(objects(spark, [(0, 80_000, 10), (1, 98_000, 10), (2, 99_000, 10), (3, 99_500, 10)]), 100_000, 5_000, 21)
    assert {r.base_offset for r in both.where("NOT expired").collect()} == {2, 3}
    gone = retention.mark_expired(objects(spark, [(0, 1, 10), (1, 1, 10)]), 100_000, 5, 0)
    assert {r.base_offset for r in gone.where("NOT expired").collect()} == {1}


def batches(spark, data):
    return spark.createDataFrame([(0, b, last, ts, n) for b, last, ts, n in data], "part int, base_offset long, last_offset long, max_ts long, batch_length long")


def test_time_lookup(spark):
    b = batches(spark, [(i, i, t, 70) for i, t in enumerate((1000, 2000, 3000, 4000, 5000))])
    t = spark.createDataFrame([(0, 2500), (0, 9000)], "part int, t long")
    assert rows(lookup.offset_for_time(b, t)) == [(0, 2500, 2, 3000), (0, 9000, -1, -1)]
    m = batches(spark, [(0, 0, 1000, 70), (1, 1, 5000, 70), (2, 2, 3000, 70)])
    s = lookup.part_state(m).first()
    assert (s.max_ts_offset, s.max_ts, s.hw, s.log_start) == (1, 5000, 3, 0)


def test_fetch_takes_the_first_batch_always(spark):
    b = batches(spark, [(0, 9, 0, 500), (10, 19, 0, 50), (20, 29, 0, 50), (30, 39, 0, 50)])
    wanted = spark.createDataFrame([(1, 0, 5, 100), (2, 0, 10, 100), (3, 0, 40, 100)], "request_id int, part int, off long, max_bytes long")
    assert rows(scan.fetch(b, wanted).select("request_id", "base_offset")) == [(1, 0), (2, 10), (2, 20)]


def test_response_trim_skips_what_does_not_fit(spark):
    sized = spark.createDataFrame([(1, 0, 50), (1, 1, 80), (1, 2, 30), (2, 0, 0), (2, 1, 500), (2, 2, 10)], "response_id int, seq long, size long")
    assert rows(scan.trim_response(sized, 100).select("response_id", "seq")) == [(1, 0), (1, 2), (2, 1)]


def test_contiguous(spark):
    b = batches(spark, [(0, 9, 0, 1), (10, 19, 0, 1), (30, 39, 0, 1)])
    assert rows(scan.contiguous(b).select("base_offset")) == [(0,), (10,)]
    assert rows(ingest.contiguous_hw(b)) == [(0, 20)]
    assert rows(ingest.contiguous_hw(b.where("base_offset > 0"))) == [(0, 0)]


def test_validation_order(spark):
    data = [(9, 10, 0, 1), (0, 10, 0, 2), (0, 70, 57, 2), (0, 70, 58, 1), (0, 700, 688, 2), (0, 70, 58, 2)]
    b = spark.createDataFrame([(i, *x, 4) for i, x in enumerate(data)], "id int, part int, raw_length int, declared_length int, magic int, n_parts int")
    assert [r.error_code for r in ingest.validate(b, 500).orderBy("id").collect()] == [3, 2, 2, 43, 10, 0]


def test_producer_of_one_partition():
    w = ingest.Producer()
    take = lambda *x: w.accept(0, *x)
    assert take(0, 0, 5, 100) == (0, 100, False) and take(0, 5, 3, 200) == (0, 200, False) and take(0, 8, 2, 300) == (0, 300, False)
    assert take(0, 8, 2, 999) == (0, 300, True) and take(0, 10, 1, 400) == (0, 400, False)
    assert take(0, 0, 5, 999) == (0, 100, True) and take(0, 11, 1, 500) == (0, 500, False)
    assert take(0, 0, 5, 999)[0] == ingest.OUT_OF_ORDER  # four batches are remembered
    assert take(1, 3, 1, 600)[0] == ingest.OUT_OF_ORDER and take(1, 0, 4, 300) == (0, 300, False)
    assert take(1, 0, 4, 999) == (0, 300, True) and take(0, 4, 1, 700)[0] == ingest.INVALID_EPOCH


def test_producer_across_partitions():
    w = ingest.Producer()
    assert w.accept(0, 3, 40, 2, 7) == (0, 7, False)  # unknown: may begin anywhere
    assert w.accept(1, 3, 5, 1, 8)[0] == ingest.OUT_OF_ORDER and w.accept(1, 3, 0, 1, 8) == (0, 8, False)  # known: a new partition begins at 0
    assert w.accept(1, 4, 0, 1, 9) == (0, 9, False)  # a new epoch clears all partitions
    assert w.accept(0, 3, 42, 1, 10)[0] == ingest.INVALID_EPOCH and w.accept(0, 4, 42, 1, 10)[0] == ingest.OUT_OF_ORDER
    assert w.accept(0, 4, 0, 1, 11) == (0, 11, False)


def test_dedup_keeps_the_order_of_arrival_across_partitions(spark):
    sent = [(0, 5, 0, 0, 1, 1, 100), (1, 5, 0, 0, 1, 2, 101), (0, 5, 1, 0, 1, 3, 102), (1, 5, 0, 1, 1, 4, 103), (1, 5, 1, 0, 2, 5, 104), (1, 5, 1, 0, 2, 6, 999), (0, -1, 0, -1, 1, 7, 105), (None, None, None, None, 1, 8, 106)]
    out = ingest.dedup_exact(spark.createDataFrame(sent, "part int, producer_id long, epoch int, seq long, n int, arrival long, off long"))
    assert rows(out.select("arrival", "error_code", "result_offset", "duplicate")) == [(1, 0, 100, False), (2, 0, 101, False), (3, 0, 102, False), (4, 90, -1, False), (5, 0, 104, False), (6, 0, 104, True), (7, 0, 105, False), (8, 0, 106, False)]


def test_as_of_and_running_against_plain_python(spark):
    import random

    from tideline.operators import runs

    r = random.Random(5)
    steps = sorted({(r.randrange(3), r.randrange(-50, 400)) for _ in range(60)})
    points = [(r.randrange(4), r.randrange(-80, 500)) for _ in range(80)]
    s = spark.createDataFrame([(g, x, None if x % 5 == 0 else x * 10) for g, x in steps], "g int, x long, v long")
    p = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(points)], "id int, g int, at long")
    want = {}
    for i, (g, x) in enumerate(points):
        best = max((y for h, y in steps if h == g and y <= x), default=None)
        want[i] = None if best is None else (best, None if best % 5 == 0 else best * 10)
    for width in (1, 7, 100_000):
        got = runs.as_of(p, s, ["g"], F.col("at"), F.col("x"), width, F.struct("x", "v"), "found").collect()
        assert {y.id: None if y.found is None else tuple(y.found) for y in got} == want
    for how, fold in (("sum", sum), ("max", max)):
        got = runs.running(s, ["g"], ["x"], F.floor(F.col("x") / 30), F.col("x"), "before", how).collect()
        assert len(got) == len(steps)
        for y in got:
            before = [x for g, x in steps if g == y.g and x < y.x]
            assert y.before == (fold(before) if before else (0 if how == "sum" else None))


def test_fetch_does_not_join_on_partition_alone(spark):
    b = batches(spark, [(i * 10, i * 10 + 9, i, 50) for i in range(300)])
    wanted = spark.createDataFrame([(i, 0, i * 37, 120) for i in range(80)], "request_id int, part int, off long, max_bytes long")
    got = rows(scan.fetch(b, wanted, width=64, span=100).select("request_id", "base_offset"))
    assert got == sorted((i, x) for i in range(80) for x in range(i * 37 // 10 * 10, i * 37 // 10 * 10 + 20, 10) if x < 3000)
    plan = str(scan.fetch(b, wanted)._jdf.queryExecution().optimizedPlan())
    assert all("__bucket" in j or "__span" in j or "__at" in j for j in plan.splitlines() if "Join" in j and "part" in j)


def test_results_that_skip_unflushed_batches_are_held_back(spark):
    found = spark.createDataFrame([(1, 0, 5, 20), (2, 0, 20, 20), (3, 0, 12, 20)], "request_id int, part int, off long, base_offset long")
    unflushed = spark.createDataFrame([(0, 0, 9)], "part int, base_offset long, last_offset long")
    assert rows(scan.without_skips(found, unflushed).select("request_id")) == [(2,), (3,)]


def test_end_of_transactions(spark):
    known = spark.createDataFrame([(1, 0, "Ongoing", None, None), (2, 0, "Ending", True, None), (3, 0, "None", None, False)], "producer_id long, epoch int, state string, ending boolean, last boolean")
    ask = spark.createDataFrame([(1, 0, True, True), (2, 0, True, True), (2, 0, False, True), (3, 0, False, True), (3, 0, True, True), (1, -1, True, True), (1, 1, True, True), (9, 0, True, True), (2, 0, True, False)], "producer_id long, epoch int, commit boolean, success boolean")
    assert [tuple(r) for r in txn.prepare_end(ask, known).select("producer_id", "error_code", "state").collect()].count((1, 0, "Ending")) == 1
    assert rows(txn.prepare_end(ask, known).select("producer_id", "epoch", "commit", "error_code")) == sorted([(1, 0, True, 0), (2, 0, True, 0), (2, 0, False, 53), (3, 0, False, 0), (3, 0, True, 53), (1, -1, True, 90), (1, 1, True, 47), (9, 0, True, 3), (2, 0, True, 0)])
    done = {(r.producer_id, r.commit, r.success, r.epoch): (r.error_code, r.state, r.last) for r in txn.finish_end(ask, known).collect()}
    assert done[2, True, True, 0] == (0, "None", True) and done[2, True, False, 0] == (0, "Ongoing", None) and done[2, False, True, 0] == (53, "Ending", None)
    assert done[3, False, True, 0] == (0, "None", False) and done[1, True, True, 0] == (53, "Ongoing", None)


def test_transactions(spark):
    log = spark.createDataFrame([(0, 1, 0, None), (0, 1, 1, "abort"), (0, 1, 2, None), (0, 2, 3, None), (0, 1, 4, "commit"), (0, 1, 5, None)], "part int, producer_id long, off long, control string")
    ranges = txn.ranges_from_markers(log)
    assert rows(ranges) == [(0, 1, 0, 1, "abort"), (0, 1, 2, 4, "commit"), (0, 1, 5, 5, "open"), (0, 2, 3, 3, "open")]
    state = lookup.stable_offsets(spark.createDataFrame([(0, 0, 6)], "part int, log_start long, hw long"), ranges)
    assert state.first().lso == 3
    assert rows(scan.read_committed(log.where("control IS NULL"), ranges, state).select("off")) == [(2,)]
    reqs = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "seq long, txn_id string")
    assert rows(txn.init_producers(reqs).select("seq", "producer_id", "epoch")) == [(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 2, 0)]


def test_election(spark):
    m = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["b", "a"]), ("g", 3, ["c", "b", "a"])], "grp string, member_id int, protocols array<string>")
    assert rows(groups.elect_protocol(m)) == [("g", "b", 2)]


def test_member_ids(spark):
    got = spark.createDataFrame([("c", None), ("c", "i")], "c string, i string").select("i", groups.member_id(F.col("c"), F.col("i")).alias("m")).collect()
    assert {(r.i, r.m[:2], len(r.m)) for r in got} == {(None, "c-", 38), ("i", "i-", 38)} and got[0].m != got[1].m


def test_names_and_configs(spark):
    names = {"ok": True, "": False, ".": False, "..": False, "x" * 249: True, "x" * 250: False, "a b": False, "é": False, "a.b_c-D1": True, "a\n": False, None: False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", catalog.valid_name(F.col("n")).alias("v"))
    assert {r.n: r.v for r in got.collect()} == names
    t = spark.createDataFrame([("t", {"retention.ms": "5", "own": "x"}), ("u", None)], "name string, configs map<string,string>")
    d = {(r.name, r.config): (r.value, r.is_default) for r in catalog.describe_configs(t).collect()}
    assert d["t", "retention.ms"] == ("5", False) and d["t", "own"] == ("x", False) and d["u", "retention.ms"] == ("604800000", True) and len(d) == 21
    twice = spark.createDataFrame([(0, "a", 1, None), (1, "a", 1, None), (2, "b", 1, None)], "seq long, name string, n_parts int, config_name string")
    assert {r.error_code for r in catalog.create_topics(twice, spark.createDataFrame([("z",)], "name string")).collect()} == {42}


def test_metadata(spark):
    e = spark.createDataFrame([(1, "C", 1, "a", True, 5), (2, "C", 1, None, True, 5), (3, "C", 2, "b", True, 5), (4, "PartitionCount", 2, "9", True, 5), (5, "PartitionCount", 2, "10", True, 5), (6, "C", 2, "z", False, 5)], "seq long, kind string, entity int, value string, good boolean, bytes long")
    good = catalog.readable_prefix(e)
    assert good.count() == 5
    assert rows(catalog.fold_metadata(good)) == [("C", 2, "b"), ("PartitionCount", 2, "10")]
    assert rows(catalog.stale_share(good)) == [(25, 15, 400_000)]


def test_percentiles(spark):
    v = spark.range(10).select(F.lit(1).alias("g"), F.col("id").alias("x"))
    r = telemetry.percentiles(v, ["g"], "x", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).first()
    assert (r.p0, r.p50, r.p99, r.p100) == (0, 5, 9, 9)


def test_bytes(spark):
    assert B.crc32c_bytes(b"123456789") == 0xE3069283
    for n in (0, -1, 1, 63, -64, 64, 300, -(1 << 62), (1 << 62)):
        data = B.encode_varint(n)
        assert B.decode_varint(b"x" + data, 1) == (n, 1 + len(data))
    d = spark.createDataFrame([(n, b"123456789") for n in (0, -1, 5, -(1 << 40))], "n long, b binary")
    for r in d.select("n", B.unzigzag(B.zigzag(F.col("n"))).alias("m"), B.crc32c("b").alias("c"), B.big_endian(F.col("b"), 0, 2).alias("e")).collect():
        assert (r.m, r.c, r.e) == (r.n, 0xE3069283, 0x3132)
    k = spark.createDataFrame([(7,)], "o long").select(B.object_key(F.lit("p"), F.lit("a-b"), F.lit("0" * 32), F.lit(3), F.col("o")).alias("path"))
    assert k.select(B.key_offset(F.col("path"))).first()[0] == 7
    assert rows(catalog.infer_topics(k)) == [("a-b", "0" * 32, 4)]


def test_offsets_after_a_log(spark):
    b = spark.createDataFrame([(0, i, 3) for i in range(50)] + [(1, 0, 2)], "part int, arrival long, n int")
    out = ingest.assign_offsets(b, ["part"], ["arrival"], F.col("n"), F.floor(F.col("arrival") / 7), spark.createDataFrame([(0, 100)], "part int, hw long"))
    assert {(r.part, r.arrival): r.base_offset for r in out.collect()} == {**{(0, i): 100 + 3 * i for i in range(50)}, (1, 0): 0}
