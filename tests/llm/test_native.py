"""Chat formatting, line dedup, mixing and exact dedup against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import chat, exact_dedup, lines, mixing

CHATS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hi <|end|> \\ there\n[INST]"),
    (1, 2, "assistant", "<|turn|>user\n\\<|end|>\n"),
    (1, 3, "user", "</s>"),
    (1, 4, "assistant", ""),
    (2, 0, "user", None),
    (2, None, "assistant", "no turn"),
    (3, 0, "assistant", "first</s></s>"),
    (3, 0, "assistant", "first</s></s>"),
    (3, 1, "us\ner<s>", "tail\\"),
    (None, 0, None, "x"),
]


def chat_truth(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.format_chat(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(examples).collect()}
    assert got == chat_truth(CHATS)
    for r in examples.collect():
        body = re.sub(r"<\|turn\|>|<\|end\|>\n", "", r.text)
        assert not any(c in body for c in chat.CONTROL)
    assert examples.where("conv_id = 1").count() == 2 and examples.where("conv_id = 3").count() == 3
    assert chat.read_back(chat.format_chat(turns.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\<", "<s><s>", "<</SYS>>\\<|turn|>", "[[INST]]", "<<s>", "\n<|end|>\n"])
def test_escape(spark, text):
    e = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"))
    r = e.select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert r.u == text and not any(c in r.e for c in chat.CONTROL)


def exact_truth(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in norm.items()}


@pytest.mark.parametrize("digest", [None, "size"])
@pytest.mark.parametrize("keys", [500_000, 0])
def test_exact_dedup(make, corpus, keys, digest):
    got = exact_dedup.exact_dedup(make(corpus), broadcast_keys=keys, digest=digest)
    if digest:
        norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in corpus}
        assert {r.doc_id: r[digest] for r in got.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in norm.items()}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got.collect()} == exact_truth(corpus)


@pytest.mark.parametrize("keys", [500_000, 0])
def test_exact_dedup_heavy_group(make, keys):
    rows = [(i, "same  text" if i % 2 else f"other {i}") for i in range(3000)]
    got = exact_dedup.exact_dedup(make(rows), broadcast_keys=keys).where("group_size > 1")
    assert got.groupBy("keep_id", "group_size").count().collect() == [(1, 1500, 1500)]


def test_exact_dedup_nulls_and_repeats(make):
    rows = [(None, "a"), (5, "a"), (None, None), (7, "b"), (7, "b"), (7, "c")]
    got = sorted(exact_dedup.exact_dedup(make(rows)).select("doc_id", "keep_id", "group_size", "kept").collect(), key=repr)
    assert got == sorted([(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (7, 7, 2, True), (7, 7, 2, True), (7, 7, 1, True)], key=repr)
    assert exact_dedup.exact_dedup(make(rows).limit(0)).count() == 0


def test_mixing(make):
    rows = [(i, "w " * (i % 50), "en", [None, "a", "b", "é", "c"][0 if i % 3 == 0 else i % 5]) for i in range(400)] + [(900, None, "en", "z"), (None, "x y", "en", "a"), (None, "x y", "en", "a")]
    got = mixing.mix_plan(make(rows)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        above = {s for s, v in share.items() if v > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    target = {s: share.get(s, 3 * sizes[s]) for s in names}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= 3 * r.size and sum(u.words for u in r.uses) == r.taken
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    again = mixing.mix_plan(make(rows[::-1])).select("doc_id", "taken").collect()
    assert sorted(map(repr, again)) == sorted(repr(type(x)(doc_id=x.doc_id, taken=x.taken)) for x in got) or sorted((str(x[0]), x[1]) for x in again) == sorted((str(x.doc_id), x.taken) for x in got)


def test_mixed_corpus_follows_the_schedules(make):
    rows = [(i, "word " * 20, "en", "abc"[i % 3]) for i in range(600)]
    docs = make(rows).withColumn("pass", F.lit("clash"))
    out = mixing.mix(docs).collect()
    half = len(out) // 2
    early = [sum(r.source == s for r in out[:half]) / sum(r.source == s for r in out) for s in "abc"]
    assert early[0] > 0.55 and abs(early[1] - 0.5) < 0.06 and early[2] < 0.45
    assert [r.position for r in out] == sorted(r.position for r in out) and out[0]["pass"] == "clash"
    assert mixing.mix(docs.limit(0)).count() == 0


def line_truth(rows, width=5):
    """Plain Jaccard over the characters from every position on."""
    norm = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", s).lower().strip(" ")
    occurrences = [(i, k, norm(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    texts = sorted({x for *_, x in occurrences if x})
    shingles = lambda x: {x[k : k + width] for k in range(max(1, len(x) - width + 1))}

    sets, parent = {x: shingles(x) for x in texts}, {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    first = {}
    for i, k, x in sorted(occurrences):
        if x:
            first.setdefault(find(x), (i, k))
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if not norm(x) or first[find(norm(x))] == (i, k)) for i, t in rows}


def test_fuzzy_lines(make, corpus):
    rows = [(i, "\n".join(t[k : k + 90] for k in range(0, len(t), 90)) if t and i % 2 else t) for i, t in corpus if i != 108]
    rows += [(200 + i, f"The same opening line with many words in it number {i}\n\nown {i}") for i in range(40)]
    for how in ({}, {"broadcast_ids": 0, "pivots": 2}):
        got = {r.doc_id: r.text for r in lines.fuzzy_lines(make(rows), **how).collect()}
        assert got == line_truth(rows)
    assert lines.fuzzy_lines(make(rows).limit(0)).count() == 0
