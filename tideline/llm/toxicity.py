"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import LETTER, U, blocks, mix, tokens
from ._common import Scratch

#: A token's features: the word, and its first so many bytes where it is longer.
PREFIXES = (4, 5, 6)


def features(buffer: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """(token numbers, hashes) for each kind of feature; starts and ends of the tokens; number of each text's first token."""
    hashes, start, end, first = tokens(buffer, offsets, LETTER)
    found = [(np.arange(len(start)), hashes.hash(start, end))]
    for n in PREFIXES:
        at = np.flatnonzero(end - start > n)
        found.append((at, mix(hashes.hash(start[at], start[at] + n) + U(n))))
    return found, start, end, first


def segments(at: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time: (first token, token behind the last, score).

    at, gain: place and score of the tokens with a score of their own, in
    order; any other token scores -drift.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    total, behind = 0.0, 0
    for p, g in zip(at.tolist(), gain.tolist(), strict=True):
        total -= drift * (p - behind)
        first, before = p, total
        total += g
        behind = p + 1
        if g <= 0:
            continue
        now = (first, behind, before, total)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j -= 1
            if j < 0 or stack[j][3] >= now[3]:
                break
            now = (stack[j][0], now[1], stack[j][2], now[3])
            del stack[j:]
        stack.append(now)
    return [(a, b, after - before) for a, b, before, after in stack]


@dataclass
class ToxicityModel:
    """Signed log-odds of the features that tell toxic from clean text; ``rate`` is the lambda of the extreme-value law of segment scores."""

    hashes: np.ndarray
    odds: np.ndarray
    drift: float
    rate: float
    weights: tuple[float, float, float]

    def __post_init__(self):
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & U(0xFFFFF)).astype(np.int64)] = True

    def gains(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and scores of the tokens with log-odds of their own; starts, ends and first numbers of all tokens.

        A token's log-odds are those of the whole word or else of its longest known beginning.
        """
        found, start, end, first = features(buffer, offsets)
        best = np.zeros(len(start))
        for at, h in [*found[1:], found[0]]:  # the longer ones later: they overwrite
            near = np.flatnonzero(self.bits[(h & U(0xFFFFF)).astype(np.int64)])
            if len(near) and len(self.hashes):
                i = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
                hit = self.hashes[i] == h[near]
                best[at[near[hit]]] = self.odds[i[hit]]
        at = np.flatnonzero(best)
        return at, best[at] - self.drift, start, end, first

    def passages(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, float]]], np.ndarray]:
        """Of each text: its significant passages (start byte, end byte, -ln of the expected number of such by chance), and their sum."""
        at, gain, start, end, first = self.gains(buffer, offsets)
        cut = np.searchsorted(at, first)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
        z = np.zeros(len(out))
        for d in np.flatnonzero(np.diff(cut)).tolist():
            size = math.log(max(int(first[d + 1] - first[d]), 1))
            lo, hi = cut[d], cut[d + 1]
            for a, b, s in segments(at[lo:hi], gain[lo:hi], self.drift):
                if (value := self.rate * s - size) > 0:
                    out[d].append((int(start[a] - offsets[d]), int(end[b - 1] - offsets[d]), value))
            z[d] = sum(x[2] for x in out[d])
        return out, z

    def probability(self, z: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(z) + c * (z > 0), -30, 30)))


def fit_logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    x = np.stack([np.ones(len(z)), np.log1p(z), (z > 0).astype(float)], 1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def extreme_rate(share: np.ndarray, gain: np.ndarray, drift: float) -> float:
    """The positive lambda at which exp(lambda * score) has mean 1 over tokens of clean text; others than ``gain`` score -drift."""
    rest = max(1 - share.sum(), 1e-9)
    lo, hi = 0.0, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        if (share * np.exp(np.clip(mid * gain, None, 600))).sum() + rest * math.exp(-mid * drift) > 1:
            hi = mid
        else:
            lo = mid
    return max(lo, 1e-3)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = 30_000, prior: float = 0.0025, significance: float = 3.3, least_odds: float = 2.0, least_docs: int = 3, drift: float = 0.1) -> ToxicityModel:
    """A model from at most ``rows`` labelled documents, those smallest by a hash of their doc_id.

    Every token of these documents counts. A feature's log-odds compare its
    tokens in toxic and in clean documents under an informed Dirichlet prior:
    to each side the share ``prior`` of the whole sample's tokens is added,
    divided among the features as these are. Log-odds of either sign are kept where they exceed ``least_odds`` and
    ``significance`` standard errors, and at least ``least_docs`` documents of
    that side hold the feature; all other tokens have none. Tokens of one
    document come in bursts, so errors go by documents, under the same prior. Of repeated labels of a doc_id
    the largest counts; null labels and ids are left out.
    """
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    if usable is not None:
        known = known.where(usable)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("__toxic").cast("int").alias("__toxic"))
    sample = Scratch(spark, "toxicity").save(sample, "sample")
    names = ["tox", "clean", "tox_docs", "clean_docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens and documents of either label by feature; feature null: tokens only, of all words."""
        held: list[list[np.ndarray]] = [[] for _ in range(5)]
        size = np.zeros(2, np.int64)
        for batch, buffer, offsets in blocks(batches):
            toxic = np.asarray(batch.column("__toxic")) == 1
            found, start, _, first = features(buffer, offsets)
            n = np.diff(first)
            size += [n[toxic].sum(), n[~toxic].sum()]
            owner = np.repeat(np.arange(len(toxic)), n)
            h = np.concatenate([x for _, x in found])
            o = np.concatenate([owner[at] for at, _ in found])
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            keys, at = np.unique(h, return_index=True)
            if len(keys):
                bad = toxic[o]
                for x, y in zip(held, (keys, *(np.add.reduceat(v.astype(np.int64), at) for v in (bad, ~bad, bad & new, ~bad & new))), strict=True):
                    x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *[pa.array([int(x)], pa.int64()) for x in (*size, 0, 0)]], names=["feature", *names])
        if held[0]:
            keys, inverse = np.unique(np.concatenate(held[0]), return_inverse=True)
            sums = [np.bincount(inverse, np.concatenate(x), len(keys)).astype(np.int64) for x in held[1:]]
            for i in range(0, len(keys), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[s].view(np.int64)), *[pa.array(x[s]) for x in sums]], names=["feature", *names])

    n = {r["__toxic"]: r["count"] for r in sample.groupBy("__toxic").count().collect()}
    n_tox, n_clean = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    if not n_tox or not n_clean:
        return ToxicityModel(np.zeros(0, U), np.zeros(0), drift, 1.0, (10.0 if n_tox else -10.0, 0.0, 0.0))
    counts = sample.mapInArrow(count, ", ".join(f"{c} long" for c in ["feature", *names])).groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])
    counts = Scratch(spark, "toxicity").save(counts, "counts")
    all_tox, all_clean = counts.where("feature IS NULL").select("tox", "clean").first()
    alpha = (F.col("tox") + F.col("clean")) * prior
    added = (all_tox + all_clean) * prior
    side = lambda c, total: F.log((F.col(c) + alpha) / F.greatest(F.lit(total + added) - F.col(c) - alpha, F.lit(0.5)))
    some = alpha * F.try_divide(F.col("tox_docs") + F.col("clean_docs"), F.col("tox") + F.col("clean"))
    error = F.sqrt(F.try_divide(F.lit(1), F.col("tox_docs") + some) + F.try_divide(F.lit(1), F.col("clean_docs") + some))
    marked = counts.where("feature IS NOT NULL").select("feature", "tox_docs", "clean_docs", (side("tox", all_tox) - side("clean", all_clean)).alias("odds"), error.alias("error"))
    enough = F.when(F.col("odds") > 0, F.col("tox_docs")).otherwise(F.col("clean_docs")) >= least_docs
    kept = marked.where((F.abs("odds") > F.greatest(significance * F.col("error"), F.lit(least_odds))) & enough).select("feature", "odds").toPandas().sort_values("feature", key=lambda x: x.to_numpy().view(np.uint64))
    hashes = kept["feature"].to_numpy(np.int64).view(np.uint64)
    gain = kept["odds"].to_numpy(float)
    first = ToxicityModel(hashes, gain, drift, 1.0, (0.0, 0.0, 0.0))
    held = spark.sparkContext.broadcast(first)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of clean documents by their score in quarters; null: all tokens."""
        for batch, buffer, offsets in blocks(batches):
            at, gain_, _, _, begin = held.value.gains(buffer, offsets)
            clean = np.asarray(batch.column("__toxic")) != 1
            mine = clean[np.searchsorted(begin, at, "right") - 1]
            level, n = np.unique(np.floor(gain_[mine] * 4).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*level.tolist(), None], pa.int64()), pa.array(np.append(n, np.diff(begin)[clean].sum()))], names=["level", "n"])

    if not len(hashes):
        share = math.log(n_tox / n_clean)
        return ToxicityModel(hashes, gain, drift, 1.0, (share, 0.0, 0.0))
    levels = {r["level"]: r["n"] for r in sample.mapInArrow(measure, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    size = levels.pop(None) + 1
    top = math.floor(max(gain.max(), 1.0) * 4)
    levels[top] = levels.get(top, 0) + 0.5  # the law needs a score above zero
    rate = extreme_rate(np.array(list(levels.values())) / size, (np.array(list(levels)) + 0.5) / 4, drift)
    second = ToxicityModel(hashes, gain, drift, rate, (0.0, 0.0, 0.0))
    held2 = spark.sparkContext.broadcast(second)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buffer, offsets in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("__toxic"), pa.array(held2.value.passages(buffer, offsets)[1])], names=["toxic", "z"])

    points = sample.mapInArrow(scored, "toxic int, z double").toPandas()
    return ToxicityModel(hashes, gain, drift, rate, fit_logistic(points["z"].to_numpy(float), (points["toxic"] == 1).to_numpy(float)))


def score(docs: DataFrame, model: ToxicityModel, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the ``carry`` columns, score, predicted and passages for every row of ``docs``.

    Tokens are runs of letters, lower-cased. A token scores the signed
    log-odds of its word, or of the longest beginning that has any, less a
    drift; or minus the drift. All maximal
    scoring segments of the whole text are found in one linear scan; those
    expected less than once by chance in a text of that length are its
    passages (start and end in bytes of the UTF-8 text, value = -ln of the
    expected number). A logistic of their summed values is the score, 0 to 1;
    predicted is 1 from 0.5. Null texts count as empty, and these get the
    score of a text without passages. Repeated rows get equal scores; other
    columns are left out; an empty table gives no rows.
    """
    carry = [c for c in carry or [] if c not in ("doc_id", "score", "predicted", "passages")]
    passage = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.DoubleType())]))
    fields = [docs.schema["doc_id"], *[docs.schema[c] for c in carry], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", passage)]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buffer, offsets in blocks(batches, "__text"):
            found, z = held.value.passages(buffer, offsets)
            p = held.value.probability(z)
            found = pa.array([[{"start": a, "end": b, "value": v} for a, b, v in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *carry)], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), found], names=["doc_id", *carry, "score", "predicted", "passages"])

    return docs.select("doc_id", *carry, F.col("text").alias("__text")).mapInArrow(run, T.StructType(fields))
