"""Best-fit-decreasing packing of token sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, partitions

#: The same vocabulary as ranks, for the same ids about four times as fast.
RANKS = ".tiktoken"
_encoders: dict[str, object] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the ``tokenizers`` library, without special tokens added.

    If a file of the same vocabulary as ranks lies beside it, texts go through
    that; texts that hold the string of an added token go through
    ``tokenizers`` itself, which alone knows these. Tests hold both ways
    against each other.
    """

    def __init__(self, path: str):
        from pathlib import Path

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = Path(path).with_suffix(RANKS)
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            with ranks.open("rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class CapacityTree:
    """A segment tree over remaining capacities 0 to ``top``: which is the smallest, from a given one on, that an open bin has?"""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:  # up to the first right neighbour with a bin, then down to its leftmost leaf
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over pieces that are told apart by length only.

    counts: pieces of each length. Returns runs (length, first rank, last rank
    + 1, first bin, pieces in each bin, offset): of the pieces of that length,
    the ranks of the run fill bins one after another, so many in each, from
    that offset on. Equal to placing the pieces one by one, longest first,
    each into the tightest open bin that holds it: bins of equal remaining
    capacity are interchangeable, and a bin that has just taken a piece is the
    tightest for the next of that length while it holds it. Bins are kept as
    intervals by remaining capacity, so the work depends on the number of
    lengths, not of pieces.
    """
    tree = CapacityTree(room)
    free: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]  # by capacity: (first bin, bins)
    runs, bins = [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                first, n, r = bins, -(-left // (room // length)), room
                bins += n
            else:
                first, n = free[r].pop()
                tree.set(r, bool(free[r]))
            fit = r // length
            full = min(n, left // fit)
            if full:
                runs.append((length, rank, rank + full * fit, first, fit, room - r))
                rank, left = rank + full * fit, left - full * fit
                free[r - fit * length].append((first, full))
                tree.set(r - fit * length, True)
            first, n = first + full, n - full
            if n and left:  # fewer than fit are left: they share one bin
                runs.append((length, rank, rank + left, first, left, room - r))
                free[r - left * length].append((first, 1))
                tree.set(r - left * length, True)
                first, n, left = first + 1, n - 1, 0
            if n:
                free[r].append((first, n))
                tree.set(r, True)
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, room: int, end_id: int) -> DataFrame:
    """doc_id, __part, piece, start, length, ids_crc32: every document's ids and ``end_id``, cut where longer than ``room``."""
    fields = [docs.schema["doc_id"], docs.schema["__part"], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), np.array([end_id], np.uint32)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.concatenate([code.ids(text.as_py() or ""), end]).astype("<u4")
                cuts = [0, *range(len(ids) % room or room, len(ids) + 1, room)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "__part")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=[f.name for f in fields])

    return docs.select("doc_id", "__part", "text").mapInArrow(run, T.StructType(fields))


def pack(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, part: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenized whole (null text: empty), ``end_id`` closes each;
    those longer than ``room`` are cut into pieces of ``room`` ids, of which
    the first may be shorter. Pieces are packed by best-fit decreasing over
    the whole corpus: only the number of pieces of each length (at most
    ``room`` numbers) goes to the driver, which packs these counts with a
    segment tree over remaining capacities; what comes back says into which
    bin and at which offset the pieces of each length go by their rank, and
    each piece looks up its own place. So no task holds more than its share
    of pieces, however many have one length.

    With ``part``, a column of a few integers, the documents of each part are
    packed by themselves and sequence_id rises from part to part: so packing
    keeps an order of parts, as a curriculum asks. The driver gets ``room``
    numbers for each part.

    Ranks go by bucket of doc_id, then doc_id, piece and checksum: reruns
    agree. A null doc_id is an id like any other; repeated rows are packed
    each. Other columns are left out. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    docs = docs.select("doc_id", "text", (F.lit(0) if part is None else part).cast("long").alias("__part"))
    pieces = scratch.save(token_pieces(docs, tokenizer, room, end_id), "pieces")
    counts: dict[int, dict[int, int]] = {}
    for r in pieces.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["__part"], {})[r["length"]] = r["n"]
    # A slot is a part and a length; slots, and the runs of each, in order.
    slots, table, bins = [], [], 0
    for p in sorted(counts):
        runs = sorted(best_fit(counts[p], room))
        for length, first, _, bin0, each, offset in runs:
            if not slots or slots[-1] != (p, length):
                slots.append((p, length))
            table.append((len(slots) - 1, first, bin0 + bins, each, offset))
        bins += max(bin0 + -(-(last - first) // each) for _, first, last, bin0, each, _ in runs)
    held = docs.sparkSession.sparkContext.broadcast((np.array(slots, np.int64).reshape(-1, 2), np.array(table, np.int64).reshape(-1, 5)))

    n = sum(sum(x.values()) for x in counts.values())
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(n, 20_000)))
    rows = pieces.withColumn("__bucket", bucket)
    slot = ["__part", "length"]
    inside = F.row_number().over(Window.partitionBy(*slot, "__bucket").orderBy("doc_id", "piece", "ids_crc32"))
    groups = rows.groupBy(*slot, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*slot).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("__in", inside).join(groups.withColumn("__before", before).drop("__n"), [*slot, "__bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__part", (F.col("__before") + F.col("__in") - 1).cast("long").alias("__rank"))
    fields = [*ranked.schema.fields[:-2], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, table = held.value
        at, first, bin0, each, offset = table.T
        keys = (at << 44) + first
        names = slots[:, 0] * (room + 1) + slots[:, 1]
        for batch in batches:
            part, n, rank = (np.asarray(batch.column(c), np.int64) for c in ("__part", "length", "__rank"))
            i = np.searchsorted(keys, (np.searchsorted(names, part * (room + 1) + n) << 44) + rank, "right") - 1
            nth, k = np.divmod(rank - first[i], each[i])
            out = [*batch.columns[:-2], pa.array(bin0[i] + nth), pa.array(offset[i] + k * n)]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return ranked.mapInArrow(place, T.StructType(fields))
