"""Fuzzy line dedup against character shingles at every position."""

import random

from pyspark.sql import functions as F

from tideline.llm import lines

WIDTH = 5


def left(make, rows):
    return {r.doc_id: r.text for r in lines.fuzzy_lines(make(rows)).collect()}


def test_lines_that_share_only_their_beginning_stay(make):
    urls = [f"https://www.{name}.example/{name * 3}" for name in ("river", "stone", "cloud", "window", "paper", "garden")]
    unspaced = ["今日は良い天気ですね今日は" + x for x in ("山に登って景色を眺めましょう", "海で魚をたくさん釣りました", "駅前の新しい店で本を買った")]
    rows = list(enumerate([*urls, *unspaced]))
    assert left(make, rows) == dict(rows)


def truth(rows):
    """Rows of one normal line each: who stays by plain Jaccard, and the number of linked pairs."""
    sets = {i: {t[k : k + WIDTH] for k in range(max(1, len(t) - WIDTH + 1))} for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = 0
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
                n += 1
    return {i for i in sets if find(i) == i}, n


def test_short_lines_with_one_typo_are_found(make):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    rows = []
    for i in range(150):
        t = " ".join(word() for _ in range(r.randint(7, 14)))
        k = r.randrange(len(t))
        rows += [(2 * i, t), (2 * i + 1, t[:k] + "q" + t[k + 1 :])]
    rows += [(900, "ab"), (901, "abc"), (902, "the cat sat at the mat near the old stone bridge"), (903, "the cat sat that the mat near the old stone bridge")]
    want, linked = truth(rows)
    got = {i for i, t in left(make, rows).items() if t}
    assert linked > 75 and want <= got and len(got - want) <= 2


def test_lines_of_few_or_repeated_characters(make):
    rows = list(enumerate(["aaaaaa", "a" * 1000, "ab" * 30, "ab" * 300, "é", "E", "x" * 70_000 + "y", "internationally", "internationalization", "abcdefghijkl", "abcdefghijkm", "😀😀😀😀😀😀", "😀" * 40, "\t\x0b", "\u3000"]))
    got = {i for i, t in left(make, rows).items() if t}
    assert got == {0, 2, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14}


def test_null_ids_and_repeated_rows(make):
    rows = [(None, "one line that comes last\n\nnull only"), (3, "One  line that comes LAST"), (3, "One  line that comes LAST"), (4, None), (5, "")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_removed, r.text) for r in lines.fuzzy_lines(make(rows)).collect())
    assert got == [(False, 3, 1, 0, rows[1][1]), (False, 3, 1, 0, rows[1][1]), (False, 4, 1, 0, ""), (False, 5, 1, 0, ""), (True, 0, 3, 1, "\nnull only")]


def test_no_python_on_the_main_path(make, spark):
    plan = lines.fuzzy_lines(make([(i, f"line {i} of the text") for i in range(50)]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_few_pairs_below_the_threshold_reach_their_sets(make, monkeypatch):
    """Lines of one large group, all at a similarity of about 0.7: buckets hold many, and none of them links."""
    r = random.Random(5)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)]
    rows = []
    for i in range(150):
        t = list(base)
        for k in r.sample(range(10, 390), 8):
            t[k] = r.choice("0123456789")
        rows.append((i, "".join(t)))
    asked, similar = [], lines.similar

    def noted(all_, pairs, *how):
        asked.append(pairs.count())
        return similar(all_, pairs, *how)

    monkeypatch.setattr(lines, "similar", noted)
    got = {i for i, t in left(make, rows).items() if t}
    assert truth([(i, " ".join(t.split())) for i, t in rows]) == (got, 0) and len(asked) > 1
    assert sum(asked[1:]) < 1000


def test_bitmaps_reject_no_link(spark):
    r = random.Random(9)
    rows = []
    for i in range(60):
        t = "".join(r.choice("abcdefgh ") for _ in range(r.choice([3, 30, 300, 3000])))
        u = list(t)
        for _ in range(len(t) // 60):
            u[r.randrange(len(u))] = "q"
        rows += [(2 * i, t), (2 * i + 1, "".join(u))]
    marks = lines.bitmaps(spark.createDataFrame(rows, "id long, text string"), WIDTH)
    other = marks.select(*[marks[c].alias(f"p_{c}") for c in marks.columns])
    x, y = ({c: (marks if not p else other)[p + c] for c in marks.columns} for p in ("", "p_"))
    passed = {(a, b) for a, b in marks.join(other, x["id"] < y["id"]).where(lines.may_link(x, y, x["n"] + y["n"], (80, 100))).select("id", "p_id").collect()}
    sets = {i: {t[k : k + WIDTH] for k in range(max(1, len(t) - WIDTH + 1))} for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(links) > 20 and links <= passed and len(passed) < 300


def test_two_lines_meet_in_one_bucket_only(spark):
    """Lines that share many buckets make one row of the join on buckets, in every pair of them."""
    r = random.Random(13)
    rows = []
    for i in range(40):
        base = "".join(r.choice("abcdefghijklmnop ") for _ in range(r.choice([6, 30, 60, 500])))
        rows += [(5 * i + j, base[:k] + "q" + base[k + 1 :]) for j, k in enumerate(r.sample(range(len(base)), 5))]
    data = spark.createDataFrame(rows, "id long, text string")
    signed = lines.signatures(data, WIDTH, 1).unionByName(lines.signatures(data, WIDTH, lines.COORDINATES)).withColumn("bands", lines.bands_of())
    keyed = lines.banded(signed, "key", "bands", *lines.SKETCH).withColumn("earlier", F.expr(lines.EARLIER))
    other = keyed.select("bucket", *[F.col(c).alias(f"p_{c}") for c in keyed.columns if c != "bucket"])
    x, y = ({c: F.col(p + c) for c in keyed.columns if c != "bucket"} for p in ("", "p_"))
    shared = keyed.join(other, "bucket").where(x["key"] < y["key"]).select("key", "p_key", (~lines.met_before(x, y)).alias("first"))
    shared = shared.groupBy("key", "p_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("int")).alias("firsts")).collect()
    assert len(shared) > 100 and max(s.n for s in shared) > 8 and {s.firsts for s in shared} == {1}


def test_recall_of_similar_pairs(spark, make):
    """Pairs at a similarity of 0.8 to 0.95, none of them alike otherwise."""
    r = random.Random(11)
    rows = []
    for i in range(700):
        t = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.randint(8, 400))).strip() + "z"
        t = " ".join(t.split())
        u = list(t)
        for _ in range(r.randint(1, max(1, len(t) // 45))):
            u[r.randrange(len(u))] = r.choice("QXYZ")
        rows += [(2 * i, t), (2 * i + 1, "".join(u))]
    sets = {i: {t.lower()[k : k + WIDTH] for k in range(max(1, len(t) - WIDTH + 1))} for i, t in rows}
    linked = {2 * i + 1 for i in range(700) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])}
    gone = {i for i, t in left(make, rows).items() if not t}
    assert len(linked) > 300 and gone <= linked and len(gone) >= 0.98 * len(linked)


def alike_lines(seed: int, n: int, changes: list[int]) -> list[tuple[int, str]]:
    """Lines of one large group; each has some characters of the same line changed, in places of its own."""
    r = random.Random(seed)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)]
    rows = []
    for i in range(n):
        t = list(base)
        for k in r.sample(range(10, 390), r.choice(changes)):
            t[k] = r.choice("0123456789")
        rows.append((i, " ".join("".join(t).split())))
    return rows


def test_few_pairs_below_the_threshold_leave_the_join_on_buckets(make, monkeypatch):
    """All at a similarity of about 0.7, below what bitmaps let pass: the pairs that the join makes, over all turns."""
    rows = alike_lines(5, 150, [8])
    kept, save = [], lines.Scratch.save

    def noted(self, df, label, *how):
        out = save(self, df, label, *how)
        if label == "pairs":
            kept.append(out.count())
        return out

    monkeypatch.setattr(lines.Scratch, "save", noted)
    got = {i for i, t in left(make, rows).items() if t}
    assert truth(rows) == (got, 0) and len(kept) > 3
    assert sum(kept[2:]) < 500  # of 11,175; the first two are of lines and the smallest of their bucket


def test_pivots_of_all_turns_find_what_one_turn_finds(make):
    """Groups of chance: some lines link, most are between 0.6 and 0.8."""
    rows = alike_lines(17, 90, [3, 4, 5, 6, 8])
    want, linked = truth(rows)
    for pivots in (2, 1000):
        got = {r.doc_id for r in lines.fuzzy_lines(make(rows), pivots=pivots).collect() if r.text}
        assert want <= got and len(got - want) <= 2 and linked > 50


def test_lines_far_below_the_threshold_share_few_buckets(spark):
    """Lines that share a third of their words: pairs that meet by chance grow with the square of the table, whatever is rejected later."""
    r = random.Random(23)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(36)]
    rows = [(i, " ".join(r.sample(words, 12))) for i in range(600)]
    signed = lines.signatures(spark.createDataFrame(rows, "id long, text string"), WIDTH, 1).withColumn("bands", lines.bands_of())
    n = F.count(F.lit(1))
    pairs = lines.banded(signed, "key").groupBy("bucket").agg((n * (n - 1) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0]
    assert pairs < 1500  # of 179,700; 2533 with bands of five


def test_naming_buckets_stays_compiled(spark, tmp_path):
    """The JVM interprets methods above 8000 bytes: no stage that names buckets may have one."""
    lines.signatures(spark.createDataFrame([(1, "a line of text")], "id long, text string"), WIDTH, 1).write.parquet(f"{tmp_path}/s")
    signed = spark.read.parquet(f"{tmp_path}/s").withColumn("bands", lines.bands_of())
    signed = signed.unionByName(signed)
    keyed = lines.banded(signed, "key")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (keyed.groupBy("bucket").agg(F.min("key"), F.max("key"), F.count(F.lit(1))), keyed.join(F.broadcast(spark.range(3).withColumnRenamed("id", "bucket")), "bucket")):
            parts = df._jdf.queryExecution().debug().codegenToSeq()
            sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
            assert sizes and 0 < max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
