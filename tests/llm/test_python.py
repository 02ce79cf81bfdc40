"""The operators with Python inside against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import langid, minhash, packing, suffixes, toxicity, vectors


def closure(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# Best-fit packing


def plain_best_fit(sizes, room):
    free, n = [], 0
    for s in sorted(sizes, reverse=True):
        fit = [f for f in free if f >= s]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - s)
        else:
            n += 1
            free.append(room - s)
    return n, sorted(free)


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_equals_piece_by_piece(seed):
    r = random.Random(seed)
    room = r.choice([7, 16, 100, 1024])
    sizes = [r.randint(1, r.choice([room, max(1, room // 3), 5 if room > 5 else room])) for _ in range(r.randint(0, 400))]
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1
    runs = packing.best_fit(dict(counts), room)
    bins = defaultdict(list)
    for length, a, b, first, each, offset in runs:
        for k in range(b - a):
            bins[first + k // each].append((offset + k % each * length, length))
    assert sum(len(x) for x in bins.values()) == len(sizes)
    for x in bins.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= room
    n, free = plain_best_fit(sizes, room)
    assert (len(bins), sorted(room - sum(n for _, n in x) for x in bins.values())) == (n, free)


def test_capacity_tree():
    r, tree, there = random.Random(1), packing.CapacityTree(50), set()
    for _ in range(2000):
        c = r.randint(0, 50)
        there ^= {c}
        tree.set(c, c in there)
        q = r.randint(0, 50)
        assert tree.tightest(q) == min((x for x in there if x >= q), default=None)


def test_pack(make, corpus):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rows = [*corpus, (500, "a <|endoftext|> b"), (501, "tab\t\tand  spaces \n")]
    t = Tokenizer.from_file(path)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in packing.pack(make(rows), path, room=64).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(ids) == r.length
        got[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        pieces = sorted(got[i])
        assert [p for p, *_ in pieces] == list(range(len(pieces))) and sum(n for *_, n in pieces) == len(ids)
        assert all(n == 64 for *_, n in pieces[1:])
    sizes = [n for x in bins.values() for _, n in x]
    assert len(bins) == plain_best_fit(sizes, 64)[0]
    for x in bins.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= 64
    assert packing.pack(make(rows).limit(0), path).count() == 0


def test_pack_with_null_and_repeated_ids_by_parts(make):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    rows = [(i if i % 5 else None, "word " * (i % 37), "en", "ab"[i % 2]) for i in range(200)] + [(3, None, "en", "a")] * 4
    out = packing.pack(make(rows), path, room=32, part=F.when(F.col("source") == "a", 1).otherwise(7)).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert sorted(bins) == list(range(len(bins))) and sum(r.piece == 0 for r in out) == len(rows)
    for x in bins.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= 32
    alone = [len({r.sequence_id for r in packing.pack(make([x for x in rows if x[3] == s]), path, room=32).collect()}) for s in "ab"]
    assert len(bins) == sum(alone)


# MinHash


def word_sets(rows, n=5):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


@pytest.mark.parametrize("small", [32, 1])
@pytest.mark.parametrize("least", [80, 60])
def test_near_duplicates(make, corpus, small, least):
    sets = word_sets(corpus)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    want = closure(sets, links)
    how = {"bands": 40, "rows": 2} if least < 80 else {}
    got = minhash.near_duplicates(make([*corpus, (None, "a b c d e f"), (None, None)]), share=(least, 100), small=small, block=16, **how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert minhash.near_duplicates(make(corpus).limit(0)).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = base[:1500], base[500:]
    s = minhash.circulant_signature(np.concatenate([a, b]), np.array([0, 1500]), 2048)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


# Vectors


def test_near_vectors(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((150, 16))
    rows = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(base)]
    for i in range(150, 330):
        rows.append((i, (base[i % 12] + r.standard_normal(16) * 0.32).astype(np.float32).tolist(), 1))
    rows += [(400, rows[3][1], 2), (401, rows[3][1], 2), (402, [2 * x for x in rows[3][1]], 2), (403, None, 0), (404, [0.0] * 16, 0), (405, [float("nan")] * 16, 0), (406, [None, *[1.0] * 15], 0), (407, [1.0, 2.0], 0), (408, [1.0, 2.0], 0), (409, [], 0), (410, [float("inf")] * 16, 0)]
    good = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a]) / np.sqrt(good[b] @ good[b]) >= 0.9]
    want, degree = closure([i for i, *_ in rows], links), defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for cell in (8192, 40):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.near_vectors(table, cell=cell).collect()}
        assert got == {i: (degree[i], want[i], want[i] == i) for i, *_ in rows}
    assert vectors.near_vectors(table.limit(0)).count() == 0
    assert vectors.near_vectors(table.select(F.lit(None).cast("long").alias("vec_id"), "embedding").limit(3)).select("n_links", "component_id", "kept").distinct().collect() == [(0, None, True)]


# Suffix arrays


def removal_truth(rows, length):
    seen, out = {}, {}
    data = sorted((((1 << 62) if i is None else i), (t or "").encode(), i) for i, t in rows)
    for i, b, _ in data:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = min(seen.get(b[k : k + length], i), i)
    for i, b, name in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < i:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) == 1)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.setdefault(name, []).append((len(b), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("length", "inner", "hot"), [(50, 24, 65_536), (20, 8, 2), (50, 24, 1)])
def test_repeated_substrings(make, corpus, length, inner, hot):
    rows = [*corpus, (None, corpus[5][1]), (3, corpus[3][1]), (3, corpus[4][1]), (600, "\0" * 90), (601, "\0" * 70 + "end")]
    got = defaultdict(list)
    for r in suffixes.repeated_substrings(make(rows), length=length, inner=inner, shard_bytes=3000, key_bytes=2000, part_bytes=1500, hot=hot).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == removal_truth(rows, length)
    assert suffixes.repeated_substrings(make(rows).limit(0)).count() == 0


def test_repeated_substrings_where_all_hashes_agree(make, corpus, monkeypatch):
    """Slices are told apart by their bytes alone when every hash is the same."""
    r = random.Random(6)
    blob = np.frombuffer(bytes(r.choice(b"ab") for _ in range(300)), np.uint8)
    start, size = np.array([r.randrange(200) for _ in range(150)]), np.array([r.randint(1, 9) for _ in range(150)])
    number, head = suffixes.strings_of(blob, start, size, np.zeros(150, np.uint64), start)
    text = [blob[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
    names = {}
    assert all(names.setdefault(n, x) == x for n, x in zip(number.tolist(), text, strict=True)) and len(names) == len(set(text))
    assert [text[h] for h in head] == [names[k] for k in range(len(head))]
    assert all(start[head[n]] <= a for n, a in zip(number, start, strict=True))


def test_repeated_substrings_of_structured_text(make):
    """Texts for which polynomials modulo a power of two collide."""
    words = [b"a", b"b"]
    for _ in range(11):
        words = [words[0] + words[1], words[1] + words[0]]
    rows = [(1, words[0].decode() + "x" * 60), (2, words[1].decode() + "y" * 60), (3, words[0].decode()), (4, "z" + words[1].decode())]
    got = defaultdict(list)
    for x in suffixes.repeated_substrings(make(rows), length=50).collect():
        got[x.doc_id].append((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256))
    assert got == removal_truth(rows, 50)


def test_repeated_substrings_of_a_whole_table(spark):
    """The query over all documents of the smallest table."""
    import os

    from tideline.llm import queries

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no tables here")
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = defaultdict(list)
    for x in queries.op10_suffix_array_dedup(spark, d).collect():
        got[x.doc_id].append((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256))
    assert got == removal_truth(rows, 50)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    r = random.Random(seed)
    text = bytes(r.choice(b"ab" if seed % 2 else b"abcdefgh\xc3") for _ in range(r.choice([1, 9, 40, 700]))) * r.choice([1, 1, 3])
    data = np.frombuffer(text, np.uint8)
    order, _ = suffixes.suffix_array(data)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    common = suffixes.common_prefixes(data, order, 50, lanes=4)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == min(n, 50)


# Language ID


def longest_match_parse(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_cross_parser_counts_phrases():
    samples = {"x": "banana bandana ", "y": "the cat sat on the mat "}
    p = langid.CrossParser(samples, piece=3)
    for text in ("banana", "the bandana sat", "zzz cat", "a", "mat mat mat", "the cat sat on a bandana mat " * 9, "anananananananan" * 5):
        symbols = p.symbols(text)
        counts, _ = p.parse(symbols, np.array([0, len(symbols)]))
        assert counts[0].tolist() == [longest_match_parse(p.clean(text), p.clean(samples[k])) for k in p.langs]


def test_language_id(make):
    r = random.Random(2)
    word = {"a": lambda: "".join(r.choice(["ka", "ti", "mo"]) for _ in range(3)), "b": lambda: "".join(r.choice(["stre", "ngth", "öß"]) for _ in range(2))}
    rows = [(i, " ".join(word["ab"[i % 2]]() for _ in range(40)), "ab"[i % 2]) for i in range(200)]
    odd = [(900, None, "a"), (901, "", "b"), (902, "12 34 !", "a"), (903, "語", None), (904, ("kati " * 30_000), "a"), (904, ("kati " * 30_000), "a")]
    docs = make([*rows, *odd])
    model = langid.train(docs, F.col("doc_id") % 3 != 1)
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows) and got[904][0] == "a"
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3 and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {x.lang_pred for x in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


# Toxicity


def segments_truth(scores):
    """All maximal scoring segments, by recursion on the best one."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = round(sum(scores[i:j]), 9)
            if s > 0 and (best is None or (s, i - j) > best[:2]):
                best = (s, i - j, i, j)
    if best is None:
        return []
    s, _, i, j = best
    return [*segments_truth(scores[:i]), (i, j, s), *((a + j, b + j, v) for a, b, v in segments_truth(scores[j:]))]


@pytest.mark.parametrize("seed", range(40))
def test_segments(seed):
    r = random.Random(seed)
    scores = [r.choice([-0.3, -0.3, r.choice([0.21, 0.52, 0.93, 1.07])]) for _ in range(r.randint(0, 25))]
    at = np.array([i for i, s in enumerate(scores) if s > 0], int)
    got = toxicity.segments(at, np.array([scores[i] for i in at]), 0.3)
    want = segments_truth(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_signed_log_odds_against_counting(spark, make):
    """Every kept feature's log-odds from plain counts, under the informed prior."""
    from collections import Counter

    from tideline.llm._bytes import packed

    r = random.Random(14)
    words = [a + b for a in "bcdfg" for b in ("ana", "elo", "iru", "oka")]
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        w = [r.choice(words) for _ in range(40)] + (["vilexyz"] * r.randint(1, 3) if bad else ["kindabc"] * r.randint(1, 3) if i % 3 else [])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    model = toxicity.train(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), prior=0.05)
    count = {s: Counter() for s in (0, 1)}
    for (_, t), (_, s) in zip(rows, labels, strict=True):
        count[s].update(t.split())
    total = {s: sum(c.values()) for s, c in count.items()}

    def odds(word):
        alpha = (count[0][word] + count[1][word]) * 0.05
        side = lambda s: np.log((count[s][word] + alpha) / (total[s] + sum(total.values()) * 0.05 - count[s][word] - alpha))
        return side(1) - side(0)

    text = packed(__import__("pyarrow").array(["vilexyz bana kindabc vilexy"]))
    at, gain, *_ = model.gains(*text)
    got = dict(zip(at.tolist(), (gain + model.drift).tolist(), strict=True))
    assert set(got) == {0, 2, 3} and abs(got[0] - odds("vilexyz")) < 1e-9 and abs(got[2] - odds("kindabc")) < 1e-9
    assert odds("vilexyz") > 2 and odds("kindabc") < -2 and got[3] == got[0]  # of an unknown word, its longest known beginning counts


@pytest.mark.parametrize("seed", range(20))
def test_segments_with_negative_scores_of_their_own(seed):
    r = random.Random(100 + seed)
    scores = [r.choice([-0.3, -0.3, r.choice([-1.7, -0.31, 0.52, 0.93, 1.07])]) for _ in range(r.randint(0, 25))]
    at = np.array([i for i, s in enumerate(scores) if s != -0.3], int)
    got = toxicity.segments(at, np.array([scores[i] for i in at]), 0.3)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in segments_truth(scores)]


def test_toxicity(spark, make):
    r = random.Random(4)
    plain = [f"word{k}".replace("0", "o") for k in range(300)]
    plain = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in plain]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["idiotic", "Scumbag", "worthless"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    odd = [(2000, None), (2001, ""), (2002, "idiotic " * 50_000), (None, "Scumbag scumbag scumbag")]
    docs, marks = make([*rows, *odd]), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, F.col("doc_id") % 5 != 0)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    wrong = [i for i, t in labels if i % 5 == 0 and got[i].predicted != t]
    assert len(wrong) <= 2 and got[2002].predicted == 1 and got[None].predicted == 1 and got[2000].predicted == got[2001].predicted == 0
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, marks.limit(0))).count() == len(rows) + 4
