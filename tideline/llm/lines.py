"""Fuzzy line dedup by MinHash over character shingles at every position, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, Scratch, attach, components, few_or_all, shuffles_dropped

LAST = (1 << 63) - 1  # stands for a null doc_id: no document is larger
#: Coordinates of a signature, and rows of a band; there are three bands for each ROWS coordinates.
COORDINATES, ROWS = 48, 6
#: Signatures with fewer filled coordinates also come from one permutation for each coordinate; those with fewer than ENOUGH only.
SPARSE, ENOUGH = 34, 24
#: Least hashes are looked for among so many shingles for each coordinate; a coordinate stays empty with probability exp(-NEAR).
NEAR = 4
#: Bits that a sketch keeps of each coordinate, and coordinates in each of its words.
LANE = 16
LANES = 64 // LANE
#: Bands of each cut, and words of a sketch that hold one coordinate of each of them.
CUT = COORDINATES // ROWS
STEP = CUT // LANES
#: The coordinates of each band: cut straight, then across, then aslant (a lane further in each word, the fifth again the first).
BANDS = [
    *[list(range(b, b + ROWS)) for b in range(0, COORDINATES, ROWS)],
    *[list(range(b, COORDINATES, CUT)) for b in range(CUT)],
    *[[r * CUT + b // LANES * LANES + (b + r) % LANES for r in range(ROWS)] for b in range(CUT)],
]
#: Least hashes and words of bitmaps are aggregated so many (a power of two) in a row: a row for each costs an entry, a column for each a test.
TOGETHER = 8
#: Bits of a bitmap of a line's shingles, 64 a word.
BITS = 4096


def normal_line(line: Column) -> Column:
    """Lower case, runs of ASCII white space as one space, none at the ends.

    The regular expression runs only on lines that hold anything but single spaces.
    """
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, SPACES, " ")).otherwise(line)))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id, doc, line, text: every normalised line that isn't blank once, and where it stands first.

    Lines are one if two hashes of 64 bits agree.
    """
    split = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    rows = split.select("doc", "line", normal_line(F.col("raw")).alias("text")).where("text <> ''")
    keyed = rows.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.struct("doc", "line").alias("at"), "text")
    firsts = keyed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("text").alias("text"))
    return firsts.select(F.monotonically_increasing_id().alias("id"), "at.doc", "at.line", "text")


def shingle(codes: Column, at: Column, width: int) -> Column:
    """Hash of the ``width`` characters from the ``at``-th on, of a text in four bytes a character; of a shorter text, all of it."""
    return F.xxhash64(F.substring(codes, at * 4 + 1, F.lit(4 * width)))


def shingles(lines: DataFrame, width: int) -> DataFrame:
    """The other columns of ``lines``, n, at and h: a row for each of the n runs of ``width`` characters of text; a shorter text is one run."""
    rest = [c for c in lines.columns if c != "text"]
    n = F.greatest(F.char_length("text") - (width - 1), F.lit(1))
    sized = lines.select(*rest, F.encode("text", "UTF-32").alias("__codes"), n.alias("n"))
    placed = sized.select(*rest, "n", "__codes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    return placed.select(*rest, "n", "at", shingle(F.col("__codes"), F.col("at"), width).alias("h"))


def signatures(lines: DataFrame, width: int, permutations: int) -> DataFrame:
    """key, filled (a bit for each coordinate that has a hash, the first the lowest) and s0, s1, ... (LANE bits of each coordinate) of each line's set.

    key: twice the id, and 1 more for signatures from many permutations; these meet their like only.

    One permutation: every shingle goes to the coordinate that its hash names,
    which takes the least hash; a coordinate may stay empty. Least hashes are
    the same whatever else a set holds, so sets of all sizes agree on them.
    With a permutation for each coordinate, none does.
    """
    hashed = shingles(lines.select("id", "text").repartition("id"), width)
    groups = range(COORDINATES // TOGETHER)
    if permutations > 1:
        rows = hashed.select("id", "h", F.explode(F.array(*[F.lit(g) for g in groups])).alias("g"))
        each = [F.shiftrightunsigned(F.xxhash64("h", F.col("g") * TOGETHER + j), 33).cast("int") for j in range(TOGETHER)]
    else:
        # Only what can be least: of n shingles, NEAR for each coordinate are expected below this. One stays of every line.
        low = (F.shiftrightunsigned("h", 33) * F.col("n") < F.lit((1 << 31) * COORDINATES * NEAR)) | (F.col("at") == 0)
        rows = hashed.where(low).select("id", F.shiftright(F.col("h").bitwiseAND((1 << 31) - 1) * COORDINATES, 31).cast("int").alias("k"), F.shiftrightunsigned("h", 33).cast("int").alias("m"))
        rows = rows.select("id", F.shiftright("k", TOGETHER.bit_length() - 1).alias("g"), F.col("k").bitwiseAND(TOGETHER - 1).alias("k"), "m")
        each = [F.when(F.col("k") == j, F.col("m")) for j in range(TOGETHER)]
    least = rows.groupBy("id", "g").agg(*[F.coalesce(F.min(x), F.lit(-1)).alias(f"m{j}") for j, x in enumerate(each)])

    # -1 stands for an empty coordinate.
    words = [reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"m{w + i}").bitwiseAND((1 << LANE) - 1).cast("long"), LANE * i) for i in range(LANES)]).alias(f"w{w}") for w in range(0, TOGETHER, LANES)]
    filled = reduce(Column.bitwiseOR, [F.shiftleft((F.col(f"m{j}") >= 0).cast("int"), j) for j in range(TOGETHER)])
    packed = least.select("id", "g", filled.cast("long").alias("filled"), *words)
    shifted = reduce(Column.bitwiseOR, [F.coalesce(F.max(F.when(F.col("g") == g, F.shiftleft("filled", g * TOGETHER))), F.lit(0).cast("long")) for g in groups])
    sketch = [F.coalesce(F.max(F.when(F.col("g") == g, F.col(f"w{w}"))), F.lit(-1).cast("long")).alias(f"s{(g * TOGETHER + w) // LANES}") for g in groups for w in range(0, TOGETHER, LANES)]
    return packed.groupBy("id").agg(shifted.alias("filled"), *sketch).select((F.col("id") * 2 + int(permutations > 1)).alias("key"), "filled", *[f"s{w}" for w in range(COORDINATES // LANES)])


SKETCH = [f"s{w}" for w in range(COORDINATES // LANES)]
#: A signature's bands before the one of its row.
EARLIER = "bands & (shiftleft(1, band) - 1)"


def lanes(of: list[int]) -> dict[int, int]:
    """The bits that coordinates take in each word of a sketch, as signed numbers; only words that hold any."""
    out = {w: sum(((1 << LANE) - 1) << LANE * (k % LANES) for k in of if k // LANES == w) for w in {k // LANES for k in of}}
    return {w: m - (1 << 64) if m >> 63 else m for w, m in sorted(out.items())}


def bands_of() -> Column:
    """A bit for each band of which more than half of the coordinates are filled."""
    each = [F.when(F.bit_count(F.col("filled").bitwiseAND(F.lit(sum(1 << k for k in of)))) > ROWS // 2, F.lit(1 << b)).otherwise(F.lit(0)) for b, of in enumerate(BANDS)]
    return reduce(Column.bitwiseOR, each)


def bucket(b: int) -> Column:
    """Names band ``b`` of a signature: what the sketch keeps of its coordinates."""
    return F.xxhash64(F.lit(b), F.col("key").bitwiseAND(1), *[F.col(f"s{w}").bitwiseAND(F.lit(m)) for w, m in lanes(BANDS[b]).items()])


def met_before(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Whether two signatures of one bucket also share the bucket of an earlier band; ``x`` has its EARLIER as earlier."""
    either = lambda of: reduce(Column.bitwiseOR, of)
    turned = lambda d, by: F.shiftrightunsigned(d, LANE * by).bitwiseOR(F.shiftleft(d, 64 - LANE * by)) if by else d  # noqa: E731  lane ``by`` becomes the lowest
    words = [x[w].bitwiseXOR(y[w]) for w in SKETCH]
    across = [either(words[r::STEP]) for r in range(STEP)]
    aslant = [either(turned(d, i % LANES) for i, d in enumerate(words[r::STEP])) for r in range(STEP)]
    out = F.lit(False)
    for b, of in enumerate(BANDS[:-1]):
        if b < CUT:
            differ = either(words[w].bitwiseAND(F.lit(m)) for w, m in lanes(of).items())
        else:
            differ = (across if b < 2 * CUT else aslant)[b % CUT // LANES].bitwiseAND(F.lit([*lanes([b % LANES]).values()][0]))
        out = out | ((x["earlier"].bitwiseAND(y["bands"]).bitwiseAND(1 << b) != 0) & (differ == 0))
    return out


def known(column: str, kind: str = "long") -> Column:
    """A number that is never null, so that Spark knows it.

    Else the compiled comparison of two lines, or the naming of a line's
    buckets, passes the 8000 bytes above which the JVM interprets a method.
    """
    return F.coalesce(column, F.lit(0).cast(kind))


def banded(signed: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of signatures, band and bucket: a row for each of their bands."""
    rest = [c for c in columns if c not in ("key", "bands", *SKETCH)]
    sure = signed.select(*rest, known("key").alias("key"), known("bands", "int").alias("bands"), *[known(w).alias(w) for w in SKETCH])
    each = F.array(*[F.when(F.col("bands").bitwiseAND(1 << b) != 0, bucket(b)) for b in range(len(BANDS))])
    return sure.select(*columns, F.posexplode(each).alias("band", "bucket")).where("bucket IS NOT NULL")


#: The lowest 8 bits of each coordinate, eight in a word.
LOW = [f"l{w}" for w in range(COORDINATES // 8)]


def low_lanes() -> list[Column]:
    """LOW of a sketch."""
    low8 = F.lit(sum(0xFF << LANE * i for i in range(LANES)))
    return [F.col(v).bitwiseAND(low8).bitwiseOR(F.shiftleft(F.col(w).bitwiseAND(low8), 8)).alias(c) for c, v, w in zip(LOW, SKETCH[::2], SKETCH[1::2], strict=True)]


def unequal(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """In how many of their coordinates two sketches differ by the lowest 8 bits."""
    out = F.lit(0)
    for c in LOW:
        d = x[c].bitwiseXOR(y[c])
        for by in (4, 2, 1):  # the lowest bit of each byte becomes the OR of its bits
            d = d.bitwiseOR(F.shiftrightunsigned(d, by))
        out = out + F.bit_count(d.bitwiseAND(F.lit(sum(1 << 8 * i for i in range(8)))))
    return out


def bitmaps(lines: DataFrame, width: int) -> DataFrame:
    """id, n (shingles of each line, repeated ones too) and b0, b1, ...: a bit for each of BITS that the hash of a shingle names."""
    groups = range(BITS // 64 // TOGETHER)
    bit = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    word = F.shiftright("h", 6).bitwiseAND(BITS // 64 - 1).cast("int")
    rows = shingles(lines.select("id", "text").repartition("id"), width).select("id", word.alias("w"), bit.alias("bit"))
    rows = rows.select("id", F.shiftright("w", TOGETHER.bit_length() - 1).alias("g"), F.col("w").bitwiseAND(TOGETHER - 1).alias("w"), "bit")
    none = F.lit(0).cast("long")
    rows = rows.groupBy("id", "g").agg(F.count(F.lit(1)).alias("n"), *[F.bit_or(F.when(F.col("w") == j, F.col("bit")).otherwise(none)).alias(f"w{j}") for j in range(TOGETHER)])
    return rows.groupBy("id").agg(F.sum("n").alias("n"), *[F.bit_or(F.when(F.col("g") == g, F.col(f"w{j}")).otherwise(none)).alias(f"b{g * TOGETHER + j}") for g in groups for j in range(TOGETHER)])


def may_link(x: dict[str, Column], y: dict[str, Column], n: Column, share: tuple[int, int]) -> Column:
    """False only where the bitmaps prove that two lines of ``n`` shingles together don't link.

    Every bit in which they differ is named by a shingle, of its own, that
    only one of the lines has. Lines that link have at most (share[1] -
    share[0]) / (share[1] + share[0]) of the shingles of both as such.
    """
    differ = reduce(Column.__add__, [F.bit_count(x[f"b{j}"].bitwiseXOR(y[f"b{j}"])) for j in range(BITS // 64)])
    return differ * (share[1] + share[0]) <= n * (share[1] - share[0])


def alike(x: dict[str, Column], y: dict[str, Column], share: tuple[int, int]) -> Column:
    """As ``may_link``, of lines whose bitmaps are arrays.

    A join by a condition with functions of arrays isn't compiled as a whole,
    but in methods of its parts. As a whole, this module's conditions would
    pass the 8000 bytes above which the JVM interprets a method.
    """
    differ = F.aggregate(F.zip_with(x["bits"], y["bits"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d)
    return differ * (share[1] + share[0]) <= (x["shingles"] + y["shingles"]) * (share[1] - share[0])


def not_ruled_out(lines: DataFrame, pairs: DataFrame, width: int, share: tuple[int, int], scratch: Scratch, broadcast_ids: int) -> DataFrame:
    """The (u, v) that bitmaps of their shingles don't prove to be unlike."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    bits = scratch.save(bitmaps(lines.join(few_or_all(ids, broadcast_ids), "id", "left_semi"), width), "bits")
    few = few_or_all(bits, broadcast_ids * 8 // BITS)
    sides = []
    for p, at in (("x_", "u"), ("y_", "v")):
        side = few.select(F.col("id").alias(at), *[known(c).alias(p + c) for c in bits.columns if c != "id"])
        sides.append(F.broadcast(side) if few is not bits else side)
    both = pairs.select("u", "v").join(sides[0], "u").join(sides[1], "v")
    x, y = ({c: F.col(p + c) for c in bits.columns if c != "id"} for p in ("x_", "y_"))
    out = scratch.save(both.where(may_link(x, y, x["n"] + y["n"], share)).select("u", "v"), "pairs")
    scratch.drop(bits)
    return out


def similar(lines: DataFrame, pairs: DataFrame, width: int, share: tuple[int, int], scratch: Scratch, broadcast_ids: int) -> DataFrame:
    """The (u, v) whose full shingle sets have share[1] * intersection >= share[0] * union."""
    ids = scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
    texts = scratch.save(lines.select("id", "text").join(few_or_all(ids, broadcast_ids), "id", "left_semi"), "texts")
    both = pairs.select("u", "v").join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")

    def members(text: str) -> Column:
        # The outer transform codes a text once; what a lambda holds is evaluated for each element.
        last = lambda c: F.greatest((F.octet_length(c) / 4).cast("int") - width, F.lit(0))
        return F.get(F.transform(F.array(F.encode(text, "UTF-32")), lambda c: F.transform(F.sequence(F.lit(0), last(c)), lambda i: shingle(c, i, width))), F.lit(0))

    sets = both.select("u", "v", members("a").alias("x"), members("b").alias("y"))
    counted = sets.select("u", "v", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("all"))
    out = scratch.save(counted.where(F.col("shared") * share[1] >= F.col("all") * share[0]).select("u", "v"), "links")
    scratch.drop(ids, texts)
    return out


def line_groups(lines: DataFrame, scratch: Scratch, width: int, share: tuple[int, int], broadcast_ids: int, pivots: int) -> DataFrame:
    """node, component over the ids of lines that are similar to another one."""
    one = scratch.save(signatures(lines, width, 1), "signatures")
    sparse = few_or_all(one.where(F.bit_count("filled") < SPARSE).select(F.shiftright("key", 1).alias("id")), broadcast_ids)
    full = scratch.save(signatures(lines.join(sparse, "id", "left_semi"), width, COORDINATES), "signatures")
    signed = one.where(F.bit_count("filled") >= ENOUGH).unionByName(full).withColumn("bands", bands_of())

    keyed = banded(signed, "key")
    buckets = scratch.save(keyed.groupBy("bucket").agg(F.min("key").alias("centre"), F.max("key").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    large = buckets.where("n > 2").select("bucket", "centre", "n")
    if (many := large.count()) <= broadcast_ids:
        members = keyed.join(F.broadcast(large), "bucket")
    else:
        members = attach(keyed, large, ["bucket"], "n", ["centre", "n"], max(many, keyed.count()), ["key"]).where("centre IS NOT NULL")
    members = scratch.save(members.where("key <> centre"), "members")

    mean = COORDINATES * share[0] / share[1]
    most = int(COORDINATES - mean + 3 * (mean * (1 - share[0] / share[1])) ** 0.5)
    x, y = ({c: F.col(p + c) for c in LOW} for p in ("x_", "y_"))
    met = buckets.where("n = 2").select(F.col("top").alias("p"), F.col("centre").alias("q")).unionByName(members.select(F.col("key").alias("p"), F.col("centre").alias("q"))).distinct()
    met = scratch.save(met, "met")
    ends = few_or_all(met.select(F.explode(F.array("p", "q")).alias("key")).distinct(), broadcast_ids)
    ends = scratch.save(signed.join(ends, "key", "left_semi").select("key", *low_lanes()), "ends")
    pairs = met
    for p, at in (("x_", "p"), ("y_", "q")):
        pairs = pairs.join(ends.select(F.col("key").alias(at), *[F.col(c).alias(p + c) for c in LOW]), at)
    tested = scratch.save(pairs.where(unequal(x, y) <= most).select(F.shiftright("p", 1).alias("u"), F.shiftright("q", 1).alias("v")).distinct(), "pairs")
    scratch.drop(met, ends)
    links = similar(lines, not_ruled_out(lines, tested, width, share, scratch, broadcast_ids), width, share, scratch, broadcast_ids)
    members = members.select("bucket", "band", "key", F.shiftright("key", 1).alias("id"))

    turn = 0
    while True:
        stars = components(links, scratch)
        # What is left: members of one bucket in different components. Pivots of each such bucket are compared with all others of it.
        labelled = members.join(stars.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        labelled = scratch.save(labelled, "labelled")
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("bucket", "m")
        left = scratch.save(labelled.join(few_or_all(mixed, broadcast_ids), "bucket"), "left")
        scratch.drop(labelled)
        largest = left.agg(F.max("m")).first()[0]
        if not largest:
            return stars
        if not turn:  # what is open later is open now
            sketches = signed.select("key", F.shiftright("key", 1).alias("id"), "bands", *SKETCH, *low_lanes()).join(few_or_all(left.select("key").distinct(), broadcast_ids), "key", "left_semi")
            marks = bitmaps(lines.join(few_or_all(left.select("id").distinct(), broadcast_ids), "id", "left_semi"), width)
            marks = scratch.save(marks.select("id", F.col("n").alias("shingles"), F.array(*[f"b{j}" for j in range(BITS // 64)]).alias("bits")), "bits")
            sketches = scratch.save(sketches.join(marks, "id").drop("id"), "sketches")
            scratch.drop(marks, one, full, buckets)
        open_ = left.join(sketches, "key")
        # Pivots of a turn are pivots of those that follow, too; they have been compared with all of their bucket by then.
        each = min(pivots ** (turn + 1), 1 << 31)
        before = each // pivots if turn else 0
        drawn = F.shiftrightunsigned(F.xxhash64("id"), 33) * F.col("m")
        open_ = open_.where(drawn >= F.lit(before << 31))
        plain = [c for c in open_.columns if c not in ("bucket", "key", "band", "m")]
        numbered = open_.select("bucket", *plain, F.expr(EARLIER).alias("earlier"), (drawn < F.lit(each << 31)).cast("int").alias("chosen"))
        pivot = numbered.where("chosen = 1").select("bucket", *[F.col(c).alias(f"p_{c}") for c in plain])
        x, y = ({c: F.col(p + c) for c in [*plain, "earlier"][: len(plain) + (not p)]} for p in ("", "p_"))
        # Where both are pivots, one order will do; of the buckets that two lines share, the first.
        once = (x["id"] > y["id"]) | (F.col("chosen") == 0)
        met = numbered.join(pivot, "bucket").where((x["component"] != y["component"]) & once & (unequal(x, y) <= most) & ~met_before(x, y) & alike(x, y, share))
        met = met.select(F.greatest("id", "p_id").alias("u"), F.least("id", "p_id").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
        met = scratch.save(met, "pairs")
        scratch.drop(left)
        more = similar(lines, met, width, share, scratch, broadcast_ids)
        tested = tested.unionByName(met)
        links = scratch.save(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), "links")
        scratch.drop(more)
        if each >= largest:
            return components(links, scratch)
        turn += 1


def fuzzy_lines(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), broadcast_ids: int = 1_000_000, pivots: int = 16) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row of ``docs``.

    Lines are split at newlines, lower-cased and their white space
    normalised. A line's set holds its character shingles: ``width``
    characters from every position on (a shorter line is one shingle). Lines
    link when share[1] * intersection >= share[0] * union of these, confirmed
    on the full sets. Of each connected component, and of lines equal to each
    other, the first by doc_id and line number stays; blank lines stay where
    they are.

    Signatures have 48 coordinates from one permutation, or from one each for
    lines of few shingles. Candidates share one of 24 bands of 6 coordinates,
    three ways of cutting 48 into sixes (at a similarity of 0.8 with
    probability 0.993, at 0.85 with 0.999), and a sketch of all coordinates that is within three
    standard errors of the threshold. In each bucket all lines are compared
    with the smallest; where a bucket holds lines of different components,
    about ``pivots`` lines are drawn and compared with all others, ``pivots``
    times as many each round, until all have been. Equal lines are one from the first
    aggregation on, so a line that fills a third of the corpus costs no more
    than another. Tables of at most ``broadcast_ids`` rows of a few numbers
    are broadcast, others are shuffled.

    Null texts count as empty (one blank line). Null doc_ids come last; rows
    that repeat a doc_id are one document listed again and share decisions.
    Other columns are left out; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(distinct_lines(docs), "lines", "zstd")
    with shuffles_dropped(docs.sparkSession):  # of counts, too
        stars = line_groups(lines, scratch, width, share, broadcast_ids, pivots)
    stars = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    labelled = lines.select("id", "doc", "line").join(stars.withColumnRenamed("node", "id"), "id", "left")
    alone = labelled.where("component IS NULL").select("doc", "line")
    firsts = labelled.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc", "line")).alias("at")).select("at.doc", "at.line")
    kept = scratch.save(alone.unionByName(firsts).groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("keep")), "kept")
    whole = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.join(kept, "doc", "left").select("doc_id", "keep", F.split("text", "\n").alias("all"))
    blank = F.filter(F.transform("all", lambda x, i: F.when(F.btrim(x, F.lit(" \t\x0b\x0c\r")) == "", i)), lambda i: i.isNotNull())
    stay = F.sort_array(F.concat(F.coalesce("keep", F.array().cast("array<int>")), blank))
    out = whole.select("doc_id", F.size("all").cast("long").alias("n_lines"), F.transform(stay, lambda i: F.get("all", i)).alias("left"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("left")).cast("long").alias("n_removed"), F.array_join("left", "\n").alias("text"))
