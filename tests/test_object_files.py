"""Object files: every codec, damage, and files on disk."""

import pytest

from tideline.sources import object_files as O

RECORDS = [O.Record(0, 0, b"k", b"v" * 5000), O.Record(1, 5, None, None), O.Record(2, -3, b"", b"", [("h", b"1"), ("h", None), ("é", b"")])]


@pytest.mark.parametrize("codec", range(5))
def test_batch_round_trip(codec):
    raw = O.encode_batch(100, 1000, RECORDS, codec, O.TRANSACTIONAL, (7, 2, 40))
    head, back = O.decode_batch(raw)
    assert back == RECORDS and head[0] == 100 and head[5] == codec | O.TRANSACTIONAL and head[8] == 1005 and head[9:12] == (7, 2, 40)
    with pytest.raises(ValueError):
        O.decode_batch(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_files(spark, tmp_path):
    folder = tmp_path / f"t-{'a' * 32}" / "3"
    folder.mkdir(parents=True)
    marker = O.encode_batch(13, 9, [O.Record(0, 0, b"\0\0\0\1", b"")], 0, O.CONTROL | O.TRANSACTIONAL)
    batches = [O.encode_batch(10, 1000, RECORDS, 4), marker, O.encode_batch(14, 50, [O.Record(0, 0, b"z", None)], 0, O.BY_APPEND)]
    good = O.encode_object(batches)
    (folder / "00000000000000000010.obj").write_bytes(good)
    hurt = bytearray(good)
    hurt[len(batches[0]) + 70] ^= 255
    (folder / "00000000000000000020.obj").write_bytes(bytes(hurt))
    (folder / "00000000000000000030.obj").write_bytes(b"nothing")
    (folder / "00000000000000000040.obj").write_bytes(O.encode_object([]))
    files = O.object_files(spark, str(tmp_path))
    rows = [r for r in O.decoded(files).collect() if r.object_key.endswith("10.obj")]
    assert [(r.topic, r.part, r.off, r.ts_ms, r.key, r.value) for r in rows[:2]] == [("t", 3, 10, 1000, b"k", b"v" * 5000), ("t", 3, 11, 1005, None, None)]
    assert [(h.key, h.value) for h in rows[2].headers] == [("h", b"1"), ("h", None), ("é", b"")]
    assert rows[3].is_control and rows[3].control_type == "commit" and rows[4].ts_type == "LogAppendTime"
    bad = [r for r in O.decoded(files).collect() if r.error]
    assert {(r.object_key[-6:-4], r.base_offset) for r in bad} == {("20", 13), ("30", None)}
    index = O.footers(files).collect()
    assert sorted((r.base_offset, r.last_offset, r.num_records) for r in index if r.object_key.endswith("10.obj")) == [(10, 12, 3), (13, 13, 1), (14, 14, 1)]
    assert O.decoded(files.limit(0)).count() == 0


def test_store_round_trip(spark, tmp_path):
    """Objects written, read by their tails and by ranges, compacted in place twice, and deleted."""
    from tideline.sources import object_store as S

    rows = [(p, i, 1000 + i, None if i % 7 == 0 else f"k{i % 11}", f"v{i}") for p in (0, 1) for i in range(200)]
    log = spark.createDataFrame(rows, "part int, off long, ts_ms long, k string, v string")
    folder = f"file://{tmp_path}/objects"
    done = S.write_objects(O.encoded(log, "t", "a" * 32, per_object=64, codec=4), folder).collect()
    assert len(done) == 8 and not [p for p in tmp_path.rglob("*.tmp")]
    files = O.object_files(spark, folder)
    for tail in (S.TAIL, 16):
        assert sorted(map(tuple, S.tail_footers(S.stored(spark, folder), tail).collect())) == sorted(map(tuple, O.footers(files).collect()))
    index = S.tail_footers(S.stored(spark, folder)).where("base_offset BETWEEN 32 AND 100")
    got = S.read_batches(index).select("part", "off", "value").collect()
    assert sorted((r.part, r.off, r.value.decode()) for r in got) == sorted((p, o, v) for p, o, _, _, v in rows if 32 <= o < 112)
    assert S.spans([(0, 5), (5, 5), (20, 5), (25, 100)], 50) == [(0, 2, 0, 10), (2, 3, 20, 25), (3, 4, 25, 125)]
    last = {}
    for p, o, _, k, v in rows:
        last[p, k or f"#{o}"] = (p, o, v)
    for _ in range(2):
        marks = S.compact_objects(spark, folder, "t", "a" * 32, f"file://{tmp_path}/marks", per_object=64)
        assert sorted((r.part, r.off, r.value.decode()) for r in O.decoded(O.object_files(spark, folder)).collect()) == sorted(last.values())
        assert sorted(map(tuple, marks.collect())) == [(0, 199), (1, 199)]
    gone = S.remove_objects(S.stored(spark, folder)).collect()
    assert all(r.removed for r in gone) and not list(tmp_path.rglob("*.obj"))
    assert [r.removed for r in S.remove_objects(spark.createDataFrame([(gone[0].path,)], "path string")).collect()] == [False]
