"""Language ID with more letters and labels than four Latin languages have."""

import random

import numpy as np
import pytest

from tideline.llm import langid


def phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def script(seed, first, size):
    """Unspaced text over ``size`` code points, the same blanks in all."""
    r = random.Random(seed)
    words = ["".join(chr(first + r.randrange(size)) for _ in range(2)) for _ in range(60)]
    return " ".join("".join(r.choice(words) for _ in range(5)) for _ in range(200))


@pytest.mark.parametrize("dense", [64, 1, 7])
def test_every_letter_of_the_samples_has_its_own_symbol(dense):
    samples = {"han": script(1, 0x4E00, 900), "kana": script(2, 0x3042, 60), "rare": script(3, 0x20000, 300), "latin": "the cat sat on the mat " * 20}
    p = langid.CrossParser(samples, piece=7, dense=dense)
    for text in (*(t[:300] for t in samples.values()), "the dog дом sat", "龠龡龢"):
        symbols = p.symbols(text)
        counts, _ = p.parse(symbols, np.array([0, len(symbols)]))
        assert counts[0].tolist() == [phrases(p.clean(text), p.clean(samples[k])) for k in p.langs]
    # the same words in another order, and the same blanks in both languages
    two = langid.CrossParser({"a": script(1, 0x4E00, 900), "b": script(1, 0x6E00, 900)}, dense=dense)
    assert two.predict([script(1, 0x4E00, 900)[500:], script(1, 0x6E00, 900)[500:]])[0] == ["a", "b"]


def test_every_label_is_learned(make):
    r = random.Random(5)
    rows = []
    for k in range(70):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(10 * k + i, " ".join(r.choice(words) for _ in range(30)), f"l{k:02d}") for i in range(2 if k < 66 else 1)]
    docs = make(rows)
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs, langid.train(docs)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_languages_are_ranked_by_entropy():
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    samples = {"long": text(8000), "short": text(150)}
    p = langid.CrossParser(samples, piece=10_000)
    turned = 0
    for _ in range(60):
        k = r.randrange(100)
        t = samples["short"][k : k + 12] + text(r.randint(10, 40))
        symbols = p.symbols(t)
        counts, size = p.parse(symbols, np.array([0, len(symbols)]))
        coded = [langid.entropy(n, size[0], len(samples[k])) for n, k in zip(counts[0].tolist(), p.langs, strict=True)]
        assert p.predict([t])[0] == [p.langs[int(np.argmin(coded))]]
        turned += int(np.argmin(coded)) != int(np.argmin(counts[0]))
    assert turned


def test_a_cut_text_counts_as_a_whole_one():
    """Also where the parses of the pieces never meet, as in repeated characters."""
    r = random.Random(9)
    samples = {"a": "a" * 5 + "b", "mix": "".join(r.choice("abc") for _ in range(400))}
    texts = ["a" * 997, "ab" * 300, "aab" * 211, *("".join(r.choice("abcd") for _ in range(r.randint(0, 700))) for _ in range(40))]
    for piece in (1, 4, 64):
        p = langid.CrossParser(samples, piece=piece)
        parts = [p.symbols(t) for t in texts]
        counts, _ = p.parse(np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))]))
        assert counts.tolist() == [[phrases(t, samples[k]) for k in p.langs] for t in texts]


def test_query_against_plain_parsing(spark, tmp_path):
    """The whole query over a small table: every prediction by counting phrases with Python's ``in``."""
    from pyspark.sql import functions as F

    from tideline.llm import queries

    r = random.Random(12)
    word = {k: ["".join(r.choice(s) for _ in range(r.randint(2, 6))) for _ in range(40)] for k, s in (("x", "abcdefgh"), ("y", "efghijkl"), ("z", "каплнос"))}
    rows = [(i, " ".join(r.choice(word["xyz"[i % 3]]) for _ in range(r.choice([1, 3, 30, 600]))), "xyz"[i % 3], "s") for i in range(90)]
    rows += [(200, None, "x", "s"), (201, "12, 34!", "y", None), (202, "", "z", "s"), (None, "капл", None, "s"), (203, "qqq", None, "s"), (5, rows[5][1], "z", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_language_id(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    samples = {k: langid.CrossParser.clean(t) for k, t in langid.sample_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1, 24_000, 64).items()}
    assert sorted(samples) == ["x", "y", "z"] and len(got) == len(rows)
    for x in got:
        text = langid.CrossParser.clean(next(t for i, t, *_ in rows if i == x.doc_id) or "")
        coded = {k: langid.entropy(phrases(text, s), 1, len(s)) for k, s in samples.items()}
        least, second = sorted(coded.values())[:2]
        assert x.lang_pred == (min(coded, key=lambda k: (coded[k], k)) if text else "und")
        assert abs(x.score - (1 - least / second if text else 0)) < 1e-9
