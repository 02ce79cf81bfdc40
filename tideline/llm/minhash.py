"""MinHash near-dedup with circulant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import SPACE, U, blocks, mix, shingles, tokens
from ._common import Scratch, attach, components, few_or_all

#: 28 bands of 5: a pair at a similarity of 0.8 shares a band with probability 1 - 1.5e-5, at 0.85 with 1 - 8e-8.
BANDS, ROWS = 28, 5
#: Coordinates by which members of large buckets are compared, and how far below the threshold still counts.
FINE, SLACK = 512, 0.09


def permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit values; overwrites ``x``."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash coordinates for each set, from two permutations.

    hashes: the sets' 64-bit members one after another; starts: where each set
    begins; none is empty. The first permutation (already in the hash) sends a
    member to one of 2**32 places; coordinate k is the least value of the
    second permutation, shifted circularly by k, over the set's places.
    """
    places = (hashes >> U(32)).astype(np.uint32)
    out = np.empty((len(starts), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(permuted(places + np.uint32(k + 1)), starts)
    return out


def sets(buffer: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, start, end, first = tokens(buffer, offsets, ~SPACE)
    return shingles(hashes.hash(start, end), first, n)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (h1, h2) and the bands' keys."""
    fields = [docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "h1", "h2")], T.StructField("keys", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buffer, offsets in blocks(batches):
            members, begin = sets(buffer, offsets, n)
            size = np.diff(begin)
            there = np.flatnonzero(size)
            h1, h2 = np.zeros((2, len(size)), U)
            keys = np.zeros((len(size), bands), U)
            if len(there):
                at = begin[there]
                h1[there] = np.add.reduceat(mix(members + U(1)), at)
                h2[there] = np.bitwise_xor.reduceat(mix(members + U(2)), at)
                coordinates = circulant_signature(members, at, bands * rows)
                for b in range(bands):
                    key = np.full(len(there), b + 1, U)
                    for c in coordinates[:, b * rows : (b + 1) * rows].T:
                        key = mix(key * U(31) + c.astype(U))
                    keys[there, b] = key
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def verified(docs: DataFrame, pairs: DataFrame, n: int, share: tuple[int, int], scratch: Scratch, broadcast_ids: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose full shingle sets have share[1] * intersection >= share[0] * union."""
    ids = scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids")
    few = ids.count() <= broadcast_ids
    part = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buffer, offsets in blocks(batches):
            members, begin = sets(buffer, offsets, n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([members[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())], names=["doc_id", "members"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar_sets(*(np.frombuffer(t.as_buffer(), U) for t in pair), share) for pair in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    table = scratch.save(part.mapInArrow(run, "doc_id long, members binary"), "sets")
    joined = pairs.join(table.select(F.col("doc_id").alias("u"), F.col("members").alias("a")), "u").join(table.select(F.col("doc_id").alias("v"), F.col("members").alias("b")), "v")
    out = scratch.save(joined.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long").distinct(), "links")
    scratch.drop(ids, table)
    return out


def sketched_sets(docs: DataFrame, ids: DataFrame, n: int, broadcast_ids: int) -> DataFrame:
    """doc_id, members, sketch (8 bits of each of FINE coordinates) of the documents of ``ids``."""
    few = ids.count() <= broadcast_ids
    part = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buffer, offsets in blocks(batches):
            members, begin = sets(buffer, offsets, n)
            there = np.flatnonzero(np.diff(begin))
            if len(there):
                sketch = (circulant_signature(members, begin[there], FINE) & np.uint32(0xFF)).astype(np.uint8)
                whole = [members[begin[i] : begin[i + 1]].tobytes() for i in there]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(there)), pa.array(whole, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "members", "sketch"])

    return part.mapInArrow(run, "doc_id long, members binary, sketch binary")


def similar_sets(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether two sorted sets reach the share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or share[1] * len(x) < share[0] * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return share[1] * both >= share[0] * (len(x) + len(y) - both)


def links_across(members: DataFrame, share: tuple[int, int], block: int, broadcast_ids: int) -> DataFrame:
    """(u, v): links between components inside large buckets.

    members: bucket, doc_id, component, n_shingles, members, sketch. Pairs of
    two components whose sketches are close enough are tested on their full
    sets, the closest first, until their components are joined. So a task
    sends out at most one link for each component that it joins.

    The members of a bucket's largest component, which most are in after the
    comparison with the smallest, go to one block each; only the others are
    sent to every block, and compared block by block among themselves.
    """

    def run(table: pa.Table) -> pa.Table:
        part, ids, comp, size = (np.asarray(table.column(c)) for c in ("part", "doc_id", "component", "n_shingles"))
        lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
        whole = [np.frombuffer(x.as_buffer(), U) for x in table.column("members")]
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        found = [np.zeros((0, 3))]
        for i in left.tolist():
            other = right[(comp[right] != comp[i]) & (share[1] * np.minimum(size[right], size[i]) >= share[0] * np.maximum(size[right], size[i]))]
            if lo == hi:
                other = other[other > i]
            equal = (sketch[other] == sketch[i]).mean(1)
            near = np.flatnonzero(equal >= share[0] / share[1] - SLACK)
            found.append(np.stack([np.full(len(near), i), other[near], -equal[near] * FINE], 1))
        pairs = np.concatenate(found).astype(np.int64)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        out = []
        for i, j, _ in pairs[np.argsort(pairs[:, 2], kind="stable")].tolist():
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b and similar_sets(whole[i], whole[j], share):
                parent[max(a, b)] = min(a, b)
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    by = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    by = by.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("n"))
    count = lambda x: F.ceil(x / block).cast("int")
    by = by.select("bucket", "main", count(F.col("c")).alias("blocks"), count(F.col("n") - F.col("c")).alias("rest"))
    rows = members.join(few_or_all(by, broadcast_ids), "bucket")
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    own = ["bucket", "doc_id", "component", "n_shingles", "members", "sketch"]
    main = rows.where("component = main").select(*own, F.lit(-1).alias("lo"), deal("blocks").alias("hi")).withColumn("part", F.col("hi"))
    others = rows.where("component <> main")
    sent = others.select(*own, F.lit(-1).alias("lo"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("hi"), F.lit(-1).alias("part"))
    among = others.select(*own, deal("rest").alias("part"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("other"))
    among = among.select(*own, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part")
    return main.unionByName(sent).unionByName(among).groupBy("bucket", "lo", "hi").applyInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS, small: int = 32, block: int = 512, broadcast_ids: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A document's set holds the hashes (64 bits) of its distinct runs of ``n``
    lower-cased words. Two link when share[1] * intersection >= share[0] *
    union; links are confirmed on the full sets, which are made anew from the
    texts of the candidates only.

    Equal sets are one node. In each bucket of a band every node is compared
    with the smallest, which links most groups without pairing their members.
    Then nodes of a bucket that are in different components are compared: all
    of them in buckets of at most ``small`` nodes; in larger ones block by
    block, those that could link by a sketch (of 512 coordinates, equal ones
    within 0.09 of the threshold: five standard errors at a similarity of 0.8
    and over). So no bucket is capped, and no pairs inside a component are
    made.

    component_id is the smallest doc_id reachable. Texts without words (null
    and empty ones too) have no shingles and link with nothing; so do rows
    with a null doc_id, whose component_id is null and which are kept. Rows
    that repeat a doc_id are one node. Other columns are left out; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.save(signatures(docs, n, bands, rows), "signatures")
    full = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["h1", "h2", "n_shingles"]
    groups = scratch.save(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "groups")
    firsts = full.join(groups.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", *same])

    keyed = scratch.save(firsts.select("doc_id", "n_shingles", F.explode("keys").alias("bucket")), "keyed")
    centres = keyed.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.save(attach(keyed, centres, ["bucket"], "n", ["centre"], keyed.count(), ["doc_id"]).where("centre IS NOT NULL AND centre <> doc_id"), "members")
    scratch.drop(keyed)

    tested = scratch.save(members.select(F.col("doc_id").alias("u"), F.col("centre").alias("v")).distinct(), "pairs")
    links = verified(docs, tested, n, share, scratch, broadcast_ids)
    stars = scratch.save(components(links, scratch), "stars")

    labelled = members.select("bucket", "doc_id", "n_shingles").join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = scratch.save(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket", "n")
    open_ = scratch.save(labelled.join(few_or_all(mixed, broadcast_ids), "bucket"), "open")
    few = open_.where(F.col("n") <= small)
    other = few.select("bucket", F.col("doc_id").alias("v"), F.col("component").alias("c"), F.col("n_shingles").alias("s"))
    sized = F.least("s", "n_shingles") * share[1] >= F.greatest("s", "n_shingles") * share[0]
    pairs = few.join(other, "bucket").where((F.col("v") < F.col("doc_id")) & (F.col("c") != F.col("component")) & sized).select(F.col("doc_id").alias("u"), "v").distinct()
    pairs = scratch.save(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
    more = []
    if pairs.limit(1).count():
        more.append(verified(docs, pairs, n, share, scratch, broadcast_ids))
    many = open_.where(F.col("n") > small)
    if many.limit(1).count():
        whole = scratch.save(sketched_sets(docs, many.select("doc_id").distinct(), n, broadcast_ids), "sketched")
        more.append(scratch.save(links_across(many.join(whole, "doc_id"), share, block, broadcast_ids), "across"))
    if any(m.limit(1).count() for m in more):
        edges = stars.select(F.col("node").alias("u"), F.col("component").alias("v"))
        for m in more:
            edges = edges.unionByName(m)
        stars = components(edges, scratch)

    settled = groups.join(stars.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep")).select(*same, "n", "component_id")
    out = attach(signed.select("doc_id", *same), settled, same, "n", ["component_id"], signed.count(), ["doc_id"])
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))
