"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, attach, components, partitions


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / largest  # else squares of tiny or huge components would leave the range of doubles
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


class Subspaces:
    """The rotated space cut into blocks, each with its share of the squared distance that a link allows.

    moments: the sum of the unit vectors' outer products. The rotation then
    goes to their principal axes, the largest ones leading one block each, so
    that a cut along them prunes most; without moments it is a random one.
    """

    def __init__(self, dim: int, blocks: int, least: float, moments: np.ndarray | None = None):
        blocks = min(blocks, dim)
        axes = rotation(dim) if moments is None else np.linalg.eigh(moments)[1][:, ::-1]
        self.turn = np.concatenate([axes[:, b::blocks] for b in range(blocks)], 1)
        self.cuts = np.cumsum([0, *(len(range(b, dim, blocks)) for b in range(blocks))])
        self.budget = [(2 - 2 * least) * (b - a) / dim + 1e-9 for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def distance(self, x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
        d = x[:, self.cuts[block] : self.cuts[block + 1]] - y[:, self.cuts[block] : self.cuts[block + 1]]
        return (d * d).sum(1)


def linked(x: np.ndarray, y: np.ndarray, block: int, space: Subspaces, least: float, same: bool, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` and ``y`` (unit vectors) with cosine >= least that first fit the budget in ``block``."""
    rx, ry = x @ space.turn, y @ space.turn
    a, b = space.cuts[block], space.cuts[block + 1]
    p, q = rx[:, a:b].astype(np.float32), ry[:, a:b].astype(np.float32)
    # One product gives squared distances: |p|^2 * 1 + 1 * |q|^2 - 2 p.q
    left = np.concatenate([p, (p * p).sum(1, keepdims=True), np.ones((len(p), 1), np.float32)], 1)
    right = np.concatenate([-2 * q, np.ones((len(q), 1), np.float32), (q * q).sum(1, keepdims=True)], 1).T.copy()
    limit = np.float32(space.budget[block] + 1e-5)
    out = []
    for i in range(0, len(p), tile):
        for j in range(i if same else 0, len(q), tile):
            at, to = np.divmod(np.flatnonzero(left[i : i + tile] @ right[:, j : j + tile] <= limit), min(tile, len(q) - j))
            at, to = at + i, to + j
            if same:
                at, to = at[at < to], to[at < to]
            for k in range(0, len(at), 200_000):
                s, t = at[k : k + 200_000], to[k : k + 200_000]
                good = (x[s] * y[t]).sum(1) >= least
                s, t = s[good], t[good]
                good = space.distance(rx[s], ry[t], block) <= space.budget[block]
                for earlier in range(block):
                    good &= space.distance(rx[s], ry[t], earlier) > space.budget[earlier]
                out.append((s[good], t[good]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, least: float = 0.9, blocks: int = 4, cell: int | None = None, cell_bytes: int = 32 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Two rows link when their cosine, in doubles, is at least ``least``. Unit
    vectors with that cosine are within 2 - 2 * least of each other in squared
    distance, so after a rotation at least one of the ``blocks`` subspaces
    holds at most its proportional part of it. The rotation goes to the
    principal axes of all vectors (up to 512 dimensions; a random one beyond,
    and where one cell holds everything). Each subspace is range-joined on its
    first coordinate: cells of about ``cell`` vectors (as many as
    ``cell_bytes`` hold in doubles, if not given), bounded by quantiles, meet
    the cells that begin within the block's budget. In a pair of cells the
    whole subspace distance picks candidates, and their full cosine decides. A
    pair counts in the first subspace that it fits, so the union over
    subspaces needs no shuffle of pairs. Tasks send out a count and one edge
    for each vector, however many links there are.

    Equal embeddings are one node that counts as often as it occurs: n_links
    takes all copies in. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do rows with a null vec_id
    (component_id null, kept) or vectors of different dimension. Rows that
    repeat a vec_id are vectors of their own for n_links and one node for
    components. Other columns, labels too, play no part. An empty table gives
    no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    kept = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if kept else "array<double>").alias("embedding"))
    rows = rows.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")))
    keys = ["__k1", "__k2"]
    rows = rows.withColumns({"__k1": F.xxhash64("embedding"), "__k2": F.hash("embedding")})
    nodes = scratch.save(rows.where("embedding IS NOT NULL").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "nodes")

    parts = []
    for r in nodes.groupBy(F.size("embedding").alias("dim")).count().collect():
        size = cell or max(1, cell_bytes // (8 * r["dim"]))
        parts.append(links_of(nodes.where(F.size("embedding") == r["dim"]).select("rep", F.col("__k1").alias("node"), "copies", "embedding"), r["dim"], r["count"], least, blocks, size, scratch))
    if not parts:
        parts = [scratch.save(spark.createDataFrame([], "rep long, node long, links long, root long"), "none")]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    degree = found.groupBy("rep", F.col("node").alias("__k1")).agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    settled = nodes.select(*keys, "rep", "copies").join(degree, ["rep", "__k1"], "left").join(stars.withColumnRenamed("node", "rep"), "rep", "left")
    settled = settled.select(*keys, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    plain = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("__k1")).alias("__k1"), F.when(F.col("embedding").isNotNull(), F.col("__k2")).alias("__k2"))
    out = attach(plain, settled, keys, "copies", ["n_links", "component_id"], nodes.agg(F.sum("copies")).first()[0] or 0, ["vec_id"])
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def links_of(nodes: DataFrame, dim: int, n: int, least: float, blocks: int, cell: int, scratch: Scratch, fitted: int = 512) -> DataFrame:
    """rep, node, links, root: partial counts of links, and edges of a spanning forest, from each pair of cells."""

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), float).reshape(-1, dim)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit(matrix(batch.column("embedding"))) if batch.num_rows else np.zeros((0, dim))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], names=["i", "x"])

    space = Subspaces(dim, blocks, least)
    if dim <= fitted and n > cell:
        sums = nodes.select("embedding").mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        space = Subspaces(dim, blocks, least, np.array([x for _, x in sorted(map(tuple, sums))]).reshape(dim, dim))
    n_blocks = len(space.budget)
    lead_of = lambda x: (unit(x) @ space.turn)[:, space.cuts[:-1]]

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, lead_of(matrix(batch.column("embedding"))).T)), names=[f"c{b}" for b in range(n_blocks)])

    kind = nodes.schema["embedding"].dataType.simpleString()
    cells = partitions(n, cell)
    names = [f"c{b}" for b in range(n_blocks)]
    edges = [[] for _ in names]
    if cells > 1:
        leads = nodes.select("embedding").mapInArrow(lead, ", ".join(f"{c} double" for c in names))
        edges = leads.approxQuantile(names, [i / cells for i in range(1, cells)], 0.1 / cells)
    edges = [np.array(sorted(set(e))) for e in edges]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coordinates = lead_of(matrix(batch.column("embedding")))
            for b in range(n_blocks):
                x, reach = coordinates[:, b], np.sqrt(space.budget[b]) + 1e-6
                home, low, high = (np.searchsorted(edges[b], v, "right") for v in (x, x - reach, x + reach))
                many = high - low + 1
                at = np.repeat(np.arange(len(x)), many)
                other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + low[at]
                columns = [pa.array(np.full(len(at), b, np.int32)), pa.array(np.minimum(home[at], other).astype(np.int32)), pa.array(np.maximum(home[at], other).astype(np.int32)), pa.array(home[at].astype(np.int32))]
                for k in range(0, len(at), 20_000):
                    rows = batch.take(pa.array(at[k : k + 20_000]))
                    yield pa.RecordBatch.from_arrays([*[c.slice(k, 20_000) for c in columns], *rows.columns], names=["block", "lo", "hi", "home", "rep", "node", "copies", "embedding"])

    def join(table: pa.Table) -> pa.Table:
        block, lo, hi = (table.column(c)[0].as_py() for c in ("block", "lo", "hi"))
        table = table.combine_chunks().sort_by("rep")
        home, rep, copies = (np.asarray(table.column(c)) for c in ("home", "rep", "copies"))
        x = unit(matrix(table.column("embedding").combine_chunks()))
        if lo == hi:
            a, b = linked(x, x, block, space, least, True)
        else:
            i, j = np.flatnonzero(home == lo), np.flatnonzero(home == hi)
            a, b = linked(x[i], x[j], block, space, least, False)
            a, b = i[a], j[b]
        links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        root, there = roots(len(rep), a, b), np.flatnonzero(links)
        return pa.table({"rep": rep[there], "node": np.asarray(table.column("node"))[there], "links": links[there].astype(np.int64), "root": rep[root[there]]})

    dealt = nodes.mapInArrow(deal, f"block int, lo int, hi int, home int, rep long, node long, copies long, embedding {kind}")
    return scratch.save(dealt.groupBy("block", "lo", "hi").applyInArrow(join, "rep long, node long, links long, root long"), "links")
