"""Removal of repeated byte strings by per-shard suffix arrays.

Strings that can't be shared are told apart first: of each window of bytes the
smallest hash of its inner strings (its minimizer) depends on its content
only, so windows whose minimizer occurs in one document are unique. The other
windows, joined into runs of one minimizer, are dealt to content shards by
it; equal windows always meet. Each shard sorts the suffixes of what it holds
by Larsson-Sadakane refinement, finds common prefixes by Kasai's scan, and so
the smallest document of every window. A content shard of more than a few MB
is sorted in parts, whose windows are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import Bytes, U, mix, spans
from ._common import Scratch, attach, partitions

LAST = (1 << 63) - 1  # stands for a null doc_id: no document is larger
EMPTY = hashlib.sha256(b"").hexdigest()


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and each one's rank.

    Larsson-Sadakane refinement: suffixes are grouped by their first eight
    bytes, and each round sorts inside groups by the rank of the suffix that
    begins where the known order ends, which doubles that order. Groups of one
    are left alone. The order is settled to the end, as Kasai's scan needs.
    """
    n = len(text)
    room = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, U)
    for i in range(8):
        key = (key << U(8)) | room[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = heads
    known = 8
    at = np.arange(n)  # places in the order whose group isn't settled
    while known < n:
        first = np.ones(len(at), bool)
        first[1:] = rank[order[at[1:]]] != rank[order[at[:-1]]]
        single = first & np.append(first[1:], True)
        at = at[~single]
        if not len(at):
            break
        here = order[at]
        group, then = rank[here], rank[np.minimum(here + known, n)]
        sort = np.lexsort((then, group))
        here, group, then = here[sort], group[sort], then[sort]
        order[at] = here
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        rank[here] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        known *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int, lanes: int = 1024) -> np.ndarray:
    """Of each suffix in ``order``, the bytes in common with the one before it, as far as ``limit``.

    Kasai's scan: in the order of the text a suffix shares at most one byte
    less with its neighbour than the suffix before it does. The text is cut
    into lanes that are scanned side by side, and eight bytes are compared at
    a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    room = np.concatenate([text, np.zeros(8 + limit, np.uint8)])
    word = np.zeros(n + limit, U)
    for i in range(8):
        word |= room[i : i + n + limit].astype(U) << U(8 * i)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    out = np.zeros(n, np.int64)
    width = -(-n // lanes)
    starts = np.arange(0, n, width)
    h = np.zeros(len(starts), np.int64)
    for t in range(width):
        i = starts + t
        i = i[i < n]
        h = np.maximum(h[: len(i)] - 1, 0)
        j = before[i]
        h[j < 0] = 0
        live = np.flatnonzero((j >= 0) & (h < limit))
        while len(live):
            a, b = i[live] + h[live], j[live] + h[live]
            x = word[a] ^ word[b]
            low = x & (~x + U(1))  # the lowest differing bit
            same = np.where(x == 0, 8, np.log2(low.astype(np.float64) + (x == 0)).astype(np.int64) // 8)
            same = np.minimum(same, n - np.maximum(a, b))
            h[live] = np.minimum(h[live] + same, limit)
            live = live[(same == 8) & (h[live] < limit)]
        out[i] = h
    return out[order]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def runs(blob: np.ndarray, ends: np.ndarray, length: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bytes]:
    """Runs of windows of ``length`` bytes that share their minimizer, inside texts: first and last window, and the minimizer.

    blob holds the texts one after another; ends: where each ends. A minimizer
    is the least hash of the strings of ``inner`` bytes in a window.
    """
    hashes = Bytes(blob)
    n = len(blob)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.view(U), hashes
    at = np.arange(n - inner + 1)
    least = sliding_min(hashes.hash(at, at + inner), length - inner + 1)
    inside = np.ones(len(least) + length, bool)
    for k in ends[:-1].tolist():
        inside[max(0, k - length + 1) : k] = False
    inside = inside[: len(least)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    after = np.flatnonzero(np.append((new | ~inside)[1:], True) & inside)
    return first, after, mix(least[first] + U(7)), hashes


def gathered(blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the slices, one after another."""
    return blob[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def equal_slices(blob: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b on are the same, for each pair."""
    out, raw = a == b, blob.tobytes()
    at = np.flatnonzero(~out)
    i, j, n = (x[at].tolist() for x in (a, b, size))
    out[at] = [raw[x : x + k] == raw[y : y + k] for x, y, k in zip(i, j, n, strict=True)]
    return out


def strings_of(blob: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's string, and the first slice (least ``tie``) of each string.

    Slices are sorted by hash; those of one hash are compared byte by byte.
    """
    order = np.lexsort((tie, size, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (size[order][1:] != size[order][:-1])
    group = np.cumsum(new) - 1
    head = order[new]
    wrong = ~equal_slices(blob, start[order], start[head[group]], size[order])
    if wrong.any():  # one hash, different strings
        more, named = [], {}
        for i in np.flatnonzero(np.isin(group, group[wrong])).tolist():
            k = order[i]
            key = int(group[i]), blob[start[k] : start[k] + size[k]].tobytes()
            if key not in named:
                named[key] = key[0] if k == head[group[i]] else len(head) + len(more)
                if named[key] >= len(head):
                    more.append(k)
            group[i] = named[key]
        head = np.concatenate([head, np.array(more, head.dtype)])
    number = np.empty(len(order), np.int64)
    number[order] = group
    return number, head


class Shard:
    """A shard of documents: ids ascending, their texts one after another."""

    def __init__(self, ids: bytes, sizes: bytes, blob: bytes, length: int, inner: int):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.blob, self.length = np.frombuffer(blob, np.uint8), length
        first, last, key, owner, slices, bounds = [], [], [], [], [], [0, *self.ends.tolist()]
        i = 0
        while i < len(self.ids):  # about a megabyte at a time
            j = max(i + 1, int(np.searchsorted(self.ends, bounds[i] + 1_000_000, "right")))
            a, b = bounds[i], bounds[j]
            f, t, k, hashes = runs(self.blob[a:b], self.ends[i:j] - a, length, inner)
            first.append(f + a)
            last.append(t + a)
            key.append(k)
            slices.append(hashes.hash(f, t + length))
            owner.append(np.searchsorted(self.ends[i:j] - a, f, "right") + i)
            i = j
        self.first, self.last, self.key, self.slice, self.owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, last, key, slices, owner))

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers, by shard of the smaller numbers first; and the log2 of how many documents hold each."""
        order = np.lexsort((self.owner, self.key))
        key, owner = self.key[order], self.owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, counts = np.unique(key[new], return_counts=True)
        return key, np.log2(np.maximum(counts, 1)).astype(np.uint8)

    def strings(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct strings of the runs with a shared minimizer; runs of hot ones are told apart window by window.

        Returns for each occurrence: first window, windows, number of its string; for each string: start, length, document, shard key.
        """
        use = np.isin(self.key, shared)
        first, last, key, owner, slices = (x[use] for x in (self.first, self.last, self.key, self.owner, self.slice))
        windows = last - first + 1
        burst = np.isin(key, hot)
        if burst.any():
            n = np.where(burst, windows, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            burst, first, key, owner, slices, windows = (np.repeat(x, n) for x in (burst, first, key, owner, slices, windows))
            first, windows = first + nth, np.where(burst, 1, windows)
            content = [hashlib.blake2b(self.blob[i : i + self.length].tobytes(), digest_size=8).digest() for i in first[burst].tolist()]
            slices[burst] = key[burst] = np.frombuffer(b"".join(content), U)
        number, head = strings_of(self.blob, first, windows + self.length - 1, slices, first)
        return first, windows, number, first[head], windows[head] + self.length - 1, self.ids[owner[head]], key[head]


def window_owners(blob: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int, part: int) -> np.ndarray:
    """Of every window of the strings in ``blob``, the smallest owner of an equal window; windows of all strings one after another.

    Strings are sorted in parts of about ``part`` bytes; windows of different
    parts are merged by binary search.
    """
    ends = np.cumsum(size)
    starts = ends - size
    count = size - length + 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.repeat(owner, count)
    held, i = [], 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + part, "right")))
        text = blob[starts[i] : ends[j - 1]]
        order, _ = suffix_array(text)
        common = common_prefixes(text, order, length)
        place = np.full(len(text), -1, np.int64)
        where = np.repeat(starts[i:j] - starts[i] - (offsets[i:j] - offsets[i]), count[i:j]) + np.arange(offsets[j] - offsets[i])
        place[where] = np.arange(len(where))
        # A class is a stretch of the order with common prefixes of the whole length; suffixes that aren't windows break none.
        klass = np.cumsum(common < length)
        window = place[order] >= 0
        klass, of = klass[window], place[order][window]
        heads = np.flatnonzero(np.concatenate([[True], klass[1:] != klass[:-1]]))
        least = np.minimum.reduceat(out[offsets[i] + of], heads)
        nth = np.cumsum(np.concatenate([[True], klass[1:] != klass[:-1]])) - 1
        out[offsets[i] + of] = least[nth]
        held.append((i, j, text, where, of, heads, nth, least))
        i = j
    if len(held) > 1:
        lists = []
        for _, _, text, where, of, heads, _, least in held:
            at = where[of[heads]]
            rows = text[at[:, None] + np.arange(length)]
            lists.append((np.ascontiguousarray(rows).view(f"S{length}").ravel(), least.copy()))
        for a in range(len(lists)):
            for b in range(a):
                small, large = (a, b) if len(lists[a][0]) < len(lists[b][0]) else (b, a)
                x, y = lists[small][0], lists[large][0]
                k = np.minimum(np.searchsorted(y, x), len(y) - 1)
                hit = np.flatnonzero(y[k] == x)
                low = np.minimum(lists[small][1][hit], lists[large][1][k[hit]])
                lists[small][1][hit] = low
                lists[large][1][k[hit]] = low
        for (i, _, _, _, of, _, nth, _), (_, least) in zip(held, lists, strict=True):
            out[offsets[i] + of] = least[nth]
    return out


def packed_bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def bits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def repeated_substrings(docs: DataFrame, length: int = 50, inner: int = 24, shard_bytes: int = 2_000_000, key_bytes: int = 4_000_000, part_bytes: int = 1_000_000, hot: int = 65_536, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if ``texts``) for every row of ``docs``.

    A byte of a document's UTF-8 text goes if a string of ``length`` bytes
    that covers it also starts in a document with a smaller doc_id; overlaps
    count, and strings are judged on the input. Matches never cross documents.

    Texts equal to one with a smaller doc_id go whole and are not looked at
    further. The rest is dealt to shards of about ``shard_bytes``. Shards
    exchange: (1) their distinct minimizers, for which of them other documents
    hold too; (2) the distinct strings of runs with such minimizers, for the
    smallest document of each window. A minimizer that over ``hot`` documents
    hold is dealt by the content of its windows instead, so no content shard
    grows with one passage. Every exchange is bounded by a shard's size; a
    shard sends one message to each shard of keys for which it has any, so
    messages are as many as the blocks of a shuffle between them, and never
    more than the keys. Strings whose hashes agree are compared by their
    bytes.

    Null texts count as empty; a null doc_id counts as larger than any other,
    and documents of one doc_id, repeated rows too, don't remove from one
    another. Texts shorter than ``length`` stay. Other columns are left out;
    an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "suffixes")
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce("doc_id", F.lit(LAST))
    rows = docs.select("doc_id", key.alias("__id"), text.alias("__text"))
    keys = [F.xxhash64("__id", "__text").alias("__key"), F.xxhash64(F.lit(1), "__id", "__text").alias("__key2")]  # 128 bits together
    ids = scratch.save(rows.select("doc_id", "__id", F.octet_length("__text").cast("long").alias("n_bytes"), F.unhex(F.sha2("__text", 256)).alias("__sha"), *keys), "ids")
    same = ids.groupBy("__sha").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    ids = scratch.save(attach(ids, same, ["__sha"], "__n", ["__first"], ids.count(), ["__key"]), "firsts")
    total = ids.where(f"n_bytes >= {length} AND __id = __first").agg(F.sum("n_bytes")).first()[0] or 0
    n_shards = partitions(total, shard_bytes)
    # A window has about 2 / (length - inner + 2) minimizers, of six bytes each.
    n_keys = partitions(total * 12 // (length - inner + 2), key_bytes)
    shard = F.pmod(F.xxhash64("__key"), F.lit(n_shards)).cast("long").alias("shard")
    copies = ids.where(f"n_bytes >= {length} AND __id <> __first").select("__key", "__key2", shard)
    long_ = rows.where(F.octet_length("__text") >= length).select("__id", "__text", *keys).select("__key", "__key2", "__id", "__text", shard)

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("shard", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("blob", pa.binary()))})
        left = left.combine_chunks()
        gone = set(zip(right.column("__key").to_pylist(), right.column("__key2").to_pylist(), strict=True))
        kept = [x not in gone for x in zip(left.column("__key").to_pylist(), left.column("__key2").to_pylist(), strict=True)]
        at = np.flatnonzero(kept)
        doc = np.asarray(left.column("__id"))[at]
        at, doc = at[np.argsort(doc, kind="stable")], np.sort(doc, kind="stable")
        parts = [left.column("__text")[int(i)].as_buffer() for i in at]
        sizes = np.array([len(p) for p in parts], np.int64)
        return pa.table({"shard": [left.column("shard")[0].as_py()], "ids": [doc.tobytes()], "sizes": [sizes.tobytes()], "blob": [b"".join(parts)]}, pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("blob", pa.binary())]))

    shards = long_.groupBy("shard").cogroup(copies.groupBy("shard")).applyInArrow(build, "shard long, ids binary, sizes binary, blob binary")
    shards = scratch.save(shards.where("length(ids) > 0"), "shards")

    def load(row) -> Shard:
        return Shard(row["ids"].as_py(), row["sizes"].as_py(), row["blob"].as_py(), length, inner)

    def keys_of(shard_: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        found, level = shard_.minimizers()
        bucket = (found % U(n_keys)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_keys + 1))
        for b in range(n_keys):
            at = order[cuts[b] : cuts[b + 1]]
            if len(at):
                yield b, found[at], level[at]

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                out = [(row["shard"].as_py(), b, k, v) for b, k, v in keys_of(load(row))]
                # 40 bits of a key suffice: bits in common only make a shard look at a string that proves unique.
                low = [(k >> U(20)).astype("<u4").tobytes() + (k >> U(52)).astype(np.uint8).tobytes() for _, _, k, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(low, pa.binary()), pa.array([x[3].tobytes() for x in out], pa.binary())], names=["shard", "bucket", "keys", "levels"])

    def meet_keys(table: pa.Table) -> pa.Table:
        n = [len(x.as_buffer()) for x in table.column("levels")]
        parts = [x.as_buffer() for x in table.column("keys")]
        keys = np.concatenate([np.frombuffer(p, "<u4", k).astype(U) | (np.frombuffer(p, np.uint8, k, 4 * k).astype(U) << U(32)) for p, k in zip(parts, n, strict=True)])
        level = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("levels")])
        order = np.argsort(keys, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        count = np.add.reduceat(1 << level[order].astype(np.int64), head)
        sizes = np.diff(np.append(head, len(keys)))
        shared, warm = np.zeros((2, len(keys)), bool)
        shared[order] = np.repeat(count > 1, sizes)
        warm[order] = np.repeat(count > hot, sizes)
        cuts = np.concatenate([[0], np.cumsum(n)])
        pieces = list(zip(cuts, cuts[1:], strict=False))
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "shared": pa.array([packed_bits(shared[a:b]) for a, b in pieces], pa.binary()), "hot": pa.array([packed_bits(warm[a:b]) for a, b in pieces], pa.binary())})

    sent = shards.mapInArrow(send_keys, "shard long, bucket long, keys binary, levels binary")
    marks = scratch.save(sent.groupBy("bucket").applyInArrow(meet_keys, "shard long, bucket long, shared binary, hot binary"), "marks")

    def candidates(left: pa.Table, marks_: pa.Table) -> tuple[Shard, tuple[np.ndarray, ...]]:
        shard_ = load({c: left.column(c)[0] for c in left.column_names})
        by = {b.as_py(): (s.as_py(), h.as_py()) for b, s, h in zip(*(marks_.column(c) for c in ("bucket", "shared", "hot")), strict=True)}
        shared, warm = [np.zeros(0, U)], [np.zeros(0, U)]
        for b, k, _ in keys_of(shard_):
            shared.append(k[bits(by[b][0], len(k))])
            warm.append(k[bits(by[b][1], len(k))])
        return shard_, shard_.strings(np.concatenate(shared), np.concatenate(warm))

    def send_strings(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("number", pa.binary()), ("size", pa.binary()), ("owner", pa.binary()), ("blob", pa.binary())])
        if not left.num_rows:
            return schema.empty_table()
        shard_, (_, _, _, start, size, owner, key_) = candidates(left, right)
        bucket = (key_ % U(n_keys)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_keys + 1))
        out = []
        for b in range(n_keys):
            at = order[cuts[b] : cuts[b + 1]]
            if len(at):
                out.append((left.column("shard")[0].as_py(), b, at.astype(np.int64).tobytes(), size[at].astype(np.int64).tobytes(), owner[at].tobytes(), gathered(shard_.blob, start[at], size[at]).tobytes()))
        return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def meet_strings(table: pa.Table) -> pa.Table:
        number, size, owner = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)]) for c in ("number", "size", "owner"))
        blob = np.frombuffer(b"".join([x.as_buffer() for x in table.column("blob")]), np.uint8)
        start = np.cumsum(size) - size
        message = np.repeat(np.arange(table.num_rows), [len(x.as_buffer()) // 8 for x in table.column("number")])
        # Equal strings are one; only strings that share a minimizer with another one can share a window.
        hashes = np.empty(len(size), U)
        least = np.empty(len(size), U)
        i, ends = 0, start + size
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(ends, start[i] + 1_000_000, "right")))
            a, b = int(start[i]), int(ends[j - 1])
            slices = Bytes(blob[a:b])
            hashes[i:j] = slices.hash(start[i:j] - a, ends[i:j] - a)
            at = np.arange(b - a - inner + 1)
            grams = slices.hash(at, at + inner)
            limits = np.stack([start[i:j] - a, ends[i:j] - a - inner + 1], 1).ravel()
            least[i:j] = np.minimum.reduceat(np.append(grams, ~U(0)), limits)[::2]
            i = j
        string, head = strings_of(blob, start, size, hashes, owner)
        s_start, s_size, s_owner, s_least = start[head], size[head], owner[head], least[head]
        _, group, many = np.unique(s_least, return_inverse=True, return_counts=True)
        at = np.flatnonzero(many[group] > 1)
        at = at[np.argsort(group[at], kind="stable")]
        found = window_owners(gathered(blob, s_start[at], s_size[at]), s_size[at], s_owner[at], length, part_bytes) if len(at) else np.zeros(0, np.int64)
        # Stretches of windows with one smallest owner, of every distinct string.
        count = s_size[at] - length + 1
        begin = np.cumsum(count) - count
        of = np.repeat(np.arange(len(at)), count)
        edge = np.ones(len(found), bool)
        edge[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
        edge = np.flatnonzero(edge)
        to = np.append(edge[1:], len(found))
        simple = np.setdiff1d(np.arange(len(head)), at)
        g_string = np.concatenate([at[of[edge]], simple])
        g_from = np.concatenate([edge - begin[of[edge]], np.zeros(len(simple), np.int64)])
        g_to = np.concatenate([to - begin[of[edge]], s_size[simple] - length + 1])
        g_least = np.concatenate([found[edge], s_owner[simple]])
        sort = np.argsort(g_string, kind="stable")
        g_string, g_from, g_to, g_least = (x[sort] for x in (g_string, g_from, g_to, g_least))
        lo, hi = (np.searchsorted(g_string, string, side) for side in ("left", "right"))
        n = hi - lo
        row = np.repeat(np.arange(len(string)), n)
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        useful = g_least[pick] < owner[row]
        row, pick = row[useful], pick[useful]
        cuts = np.searchsorted(message[row], np.arange(table.num_rows + 1))
        data = np.stack([number[row], g_from[pick], g_to[pick], g_least[pick]], 1)
        return pa.table({"shard": table.column("shard"), "found": pa.array([data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    asked = shards.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(send_strings, "shard long, bucket long, number binary, size binary, owner binary, blob binary")
    answers = scratch.save(asked.groupBy("bucket").applyInArrow(meet_strings, "shard long, found binary"), "answers")
    both = marks.select("shard", "bucket", "shared", "hot", F.lit(None).cast("binary").alias("found")).unionByName(answers.select("shard", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("shared"), F.lit(None).cast("binary").alias("hot"), "found"))
    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.name for f in fields]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        if not left.num_rows:
            return pa.schema(list(zip(names, kinds, strict=True))).empty_table()
        replies = [x.as_buffer() for x in right.column("found") if x.is_valid]
        shard_, (first, windows, number, _, size, owner, _) = candidates(left, right.filter(pc.is_valid(right.column("bucket"))))
        got = np.frombuffer(b"".join(replies), np.int64).reshape(-1, 4)
        count = size - length + 1
        begin = np.cumsum(count) - count
        least = np.repeat(owner, count)
        n = got[:, 2] - got[:, 1]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[got[:, 0]] + got[:, 1], n)
        least[at] = np.minimum(least[at], np.repeat(got[:, 3], n))
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(first, windows) + nth
        doc = np.searchsorted(shard_.ends, start, "right")
        start = start[least[np.repeat(begin[number], windows) + nth] < shard_.ids[doc]]
        change = np.zeros(len(shard_.blob) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = [[] for _ in names]
        a = 0
        for doc_id, b in zip(shard_.ids.tolist(), shard_.ends.tolist(), strict=True):
            cut = gone[a:b]
            kept = shard_.blob[a:b][~cut].tobytes()
            for x, v in zip(out, (None if doc_id == LAST else doc_id, b - a, int(cut.sum()), len(spans(cut)[0]), hashlib.sha256(kept).hexdigest(), kept if texts else None), strict=True):
                x.append(v)
            a = b
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    looked = shards.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(finish, T.StructType(fields))
    whole = F.expr(f"n_bytes >= {length}")
    # What isn't looked at: short texts, which stay, and copies, which go.
    rest = ids.where(f"n_bytes < {length} OR __id <> __first").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.lower(F.hex("__sha"))).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).cast("binary").alias("kept"),
    )
    if texts:
        short = rows.where(F.octet_length("__text") < length).select("doc_id", F.col("__text").cast("binary").alias("kept"))
        sized = short.select("doc_id", F.octet_length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
        rest = rest.where(whole).unionByName(sized)
    out = looked.unionByName(rest)
    return out if texts else out.drop("kept")
