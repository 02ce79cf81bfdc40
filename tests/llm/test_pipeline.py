"""The stages, one by one, against what their operators must leave."""

import random
import re

import corpus_pipeline
import pytest

from tideline.llm import mixing, queries

pytest.importorskip("public_tokenizers")


def test_stages(spark, make, corpus):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3]) for i, t in corpus] + [(700, "12 34", "en", "a"), (701, None, None, None)]
    docs = make(rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    left, columns = {}, docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        if name != "packing":
            assert now.columns == columns, name
        left[name] = now.collect()
        now = spark.createDataFrame(left[name], now.schema)
    text = {i: t for i, t, *_ in rows}
    assert {r.doc_id for r in left["language_id"]} == {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
    assert all(r.text == text[r.doc_id] for r in left["language_id"])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for r in sorted(left["language_id"], key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in left["exact_dedup"]} == set(first.values())

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {r.doc_id: shingles(r.text) for r in left["exact_dedup"]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in left["near_dedup"]} == {i for i in sets if find(i) == i}
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(make([tuple(r[:4]) for r in left["near_dedup"]])).collect()}
    words = {}
    for r in left["mixing"]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in plan.items() if n}
    pieces = left["packing"]
    assert sum(r.start == 0 for r in pieces) == len(left["mixing"]) and all(r.offset + r.length <= 1024 for r in pieces)


def test_one_row_of_each_group_with_null_and_repeated_ids(spark, make):
    long_ = " ".join(f"word{k}" for k in range(60))
    rows = [(None, "same text"), (None, "same  text"), (7, "one of two"), (7, "one of two"), (7, "another"), (8, long_), (None, long_ + " end"), (None, None), (9, "")]
    exact = corpus_pipeline.exact(spark, make(rows), "")
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in exact.collect()) == [(False, 7, "another"), (False, 7, "one of two"), (False, 8, long_), (False, 9, ""), (True, 0, rows[1][1]), (True, 0, long_ + " end")]
    near = corpus_pipeline.near(spark, make(rows), "")
    left = [x.text for x in near.collect()]
    assert left.count(long_) == 1 and long_ + " end" not in left and left.count("one of two") == 1 and left.count("another") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_one_of_each_by_broadcast_and_by_shuffle(spark, make, few):
    rows = [(i, f"text {i % 70}") for i in range(100)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.one_of_each(make(rows), corpus_pipeline.exact_dedup.exact_dedup, few)
        assert sorted(x.doc_id for x in out.collect()) == list(range(70))
        assert ("Exchange hashpartitioning" in plan_of(out)) == (few == 0)  # texts are shuffled only where too many rows go
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mixing_writes_texts_to_no_scratch_table(spark, make, monkeypatch):
    saved, save = {}, mixing.Scratch.save

    def noted(self, df, label, *how):
        saved[label] = df.columns
        return save(self, df, label, *how)

    monkeypatch.setattr(mixing.Scratch, "save", noted)
    rows = [(i, f"some words {i} and more", "en", "ab"[i % 2]) for i in range(60)]
    mixed = mixing.mix(make(rows)).collect()
    assert {x.text for x in mixed} <= {t for _, t, *_ in rows} | {" ".join(t.split()[:k]) for _, t, *_ in rows for k in range(1, 5)}
    assert saved and not any("text" in c or "__doc" in c for c in saved.values())


def test_empty_table(spark, make):
    now = make([(1, "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, "").collect(), stage(spark, now, "").schema)
    assert now.count() == 0


def test_whole_pipeline_keeps_the_order_of_the_mix(spark, make, tmp_path):
    """run() over files: every piece of the mix is packed, and early sequences hold what the mix puts first."""
    r = random.Random(1)
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "paper") for b in ("s", "ed", "ing", "er", "ly")]
    rows = [(i, " ".join(r.choice(words) + str(r.randrange(900)) for _ in range(r.randint(20, 200))), "en", "abc"[i % 3]) for i in range(240)]
    make(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    source = {i: s for i, _, _, s in rows}
    bins = {}
    for x in pieces:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(bins) == list(range(len(bins)))
    for x in bins.values():
        end = 0
        for a, n in sorted(x):
            assert a == end
            end += n
        assert end <= 1024
    half = len(bins) // 2
    early = {s: sum(x.length for x in pieces if source[x.doc_id] == s and x.sequence_id < half) / sum(x.length for x in pieces if source[x.doc_id] == s) for s in "abc"}
    assert early["a"] > 0.55 and early["c"] < 0.45


def test_queries_have_names_of_all_ten():
    numbers = {int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))}
    assert numbers == set(range(1, 11)) and "pipeline" in queries.QUERIES
    assert set(queries.ORACLES) <= set(queries.QUERIES)
