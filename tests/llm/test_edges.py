"""Ties, repeated rows and long inputs that the other tests leave out."""

import random

import pytest

from tideline.llm import chat, langid, minhash, mixing, packing


def test_chat_of_many_turns(spark):
    n = 300
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(n)] + [(2, 0, "user", "x" * 200_000), (2, 1, "assistant", "</s>" * 20_000)], "conv_id long, turn long, role string, text string")
    examples = chat.format_chat(turns)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(examples).collect()}
    assert got == {1: (n, sum(len(f"t{i}") for i in range(1, n, 2))), 2: (2, 80_000)}
    assert examples.where("conv_id = 1").count() == n // 2


def test_near_duplicates_of_repeated_ids(make):
    r = random.Random(4)
    say = lambda k: " ".join(f"w{r.randrange(500)}" for _ in range(k))
    a, b, c = say(60), say(60), say(60)
    rows = [(1, a), (1, a), (2, a + " end"), (3, b), (3, c), (4, b), (5, c), (6, None), (6, None), (None, a), (None, a)]
    got = sorted((x.doc_id is None, x.doc_id or 0, x.component_id, x.kept) for x in minhash.near_duplicates(make(rows)).collect())
    assert [x for x in got if not x[0]] == sorted([(False, 1, 1, True)] * 2 + [(False, 2, 1, False)] + [(False, 3, 3, True)] * 2 + [(False, 4, 3, False), (False, 5, 3, False)] + [(False, 6, 6, True)] * 2)
    assert [x[2:] for x in got if x[0]] == [(None, True)] * 2


def test_mixing_of_ties_agrees_with_a_rerun(make):
    rows = [(7, f"{w} " * 5, "en", "ab"[i % 2]) for i, w in enumerate("abcdefghij")] * 2 + [(i, "one two", "en", "c") for i in range(20)]
    key = lambda x: sorted((y.doc_id, y.source, y.text) for y in x.collect())
    first = key(mixing.mix(make(rows)))
    assert first == key(mixing.mix(make(rows[::-1]).repartition(3))) and len(first) > len(rows) // 2


def test_language_of_a_tie_is_the_first_by_name(make):
    docs = make([(1, "abc abc", "y"), (2, "abc abc", "x"), (3, "abc", None)])
    assert {x.doc_id: x.lang_pred for x in langid.identify(docs, langid.train(docs)).collect()} == {1: "x", 2: "x", 3: "x"}


def test_packing_of_one_length(make):
    P = pytest.importorskip("public_tokenizers")
    out = packing.pack(make([(i % 50, "same words here") for i in range(300)]), P.path("byte_bpe_50k.json"), room=64).collect()
    n = out[0].length
    assert len({(x.sequence_id, x.offset) for x in out}) == 300 and len({x.sequence_id for x in out}) == -(-300 // (64 // n))
