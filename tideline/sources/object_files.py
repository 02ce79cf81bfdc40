"""Object files: record batches of the public log protocol (version 2) with an index at the end.

Files are read through Spark's ``binaryFile`` source, so any file system that
Spark knows will do, and decoded by Arrow batches in Python.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes_ import crc32c_bytes, decode_varint, encode_varint

#: Fixed values of the format: the batch header, the index entry, the trailer and its magic number, codecs by number.
HEADER = struct.Struct(">qiibIhiqqqhii")
ENTRY = struct.Struct(">qIIiqi")
TRAILER = struct.Struct(">II")
MAGIC = 0x4B4C4958
CODECS = ("none", "gzip", "snappy", "lz4", "zstd")
#: Attribute bits above the codec.
BY_APPEND, TRANSACTIONAL, CONTROL = 0x08, 0x10, 0x20

RECORDS = (
    "object_key string, topic string, topic_id string, part int, base_offset long, off long, ts_ms long, ts_type string, key binary, value binary, "
    "headers array<struct<key:string,value:binary>>, producer_id long, producer_epoch int, base_sequence int, is_txn boolean, is_control boolean, control_type string, codec string, error string"
)
FOOTERS = "object_key string, topic string, topic_id string, part int, base_offset long, byte_position long, batch_length long, last_offset long, max_ts long, num_records int, error string"
KEY = r"^(?:.*/)?([^/]+)-([0-9a-f]{32})/(\d+)/\d+\.obj$"


@dataclass
class Record:
    offset_delta: int
    ts_delta: int
    key: bytes | None
    value: bytes | None
    headers: list[tuple[str, bytes | None]] = field(default_factory=list)


def squeeze(data: bytes, codec: int) -> bytes:
    if codec == 0:
        return data
    if codec == 1:
        return gzip.compress(data, mtime=0)
    if codec == 2:
        return pa.Codec("snappy").compress(data, asbytes=True)
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, CODECS[codec]) as f:
        f.write(data)
    return sink.getvalue().to_pybytes()


def expand(data: bytes, codec: int) -> bytes:
    if codec == 0:
        return data
    if codec == 1:
        return gzip.decompress(data)
    if codec == 2:
        size = shift = 0
        for b in data:  # the block's size comes first, seven bits a byte
            size |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
        return pa.Codec("snappy").decompress(data, size, asbytes=True)
    if codec >= len(CODECS):
        raise ValueError(f"unknown codec {codec}")
    return pa.CompressedInputStream(pa.BufferReader(data), CODECS[codec]).read()


def sized(data: bytes | None) -> bytes:
    return encode_varint(-1) if data is None else encode_varint(len(data)) + data


def encode_record(r: Record) -> bytes:
    head = b"".join(sized(k.encode()) + sized(v) for k, v in r.headers)
    body = b"\0" + encode_varint(r.ts_delta) + encode_varint(r.offset_delta) + sized(r.key) + sized(r.value) + encode_varint(len(r.headers)) + head
    return encode_varint(len(body)) + body


def decode_records(data: bytes, n: int) -> Iterator[Record]:
    at = 0
    for _ in range(n):
        size, at = decode_varint(data, at)
        end = at + size
        if size < 0 or end > len(data):
            raise ValueError("a record runs past its batch")
        ts, at = decode_varint(data, at + 1)
        off, at = decode_varint(data, at)

        def blob(at: int) -> tuple[bytes | None, int]:
            size, at = decode_varint(data, at)
            return (None, at) if size < 0 else (data[at : at + size], at + size)

        key, at = blob(at)
        value, at = blob(at)
        count, at = decode_varint(data, at)
        headers = []
        for _ in range(count):
            name, at = blob(at)
            item, at = blob(at)
            headers.append(((name or b"").decode("utf-8", "replace"), item))
        yield Record(off, ts, key, value, headers)
        at = end


def encode_batch(base_offset: int, base_ts: int, records: list[Record], codec: int = 0, attributes: int = 0, producer: tuple[int, int, int] = (-1, -1, -1)) -> bytes:
    """A batch with its checksum; attributes beyond the codec as bits."""
    body = squeeze(b"".join(map(encode_record, records)), codec)
    largest = base_ts + max(r.ts_delta for r in records)
    tail = struct.pack(">hiqqqhii", attributes | codec, records[-1].offset_delta, base_ts, largest, *producer, len(records)) + body
    return struct.pack(">qiibI", base_offset, 9 + len(tail), 0, 2, crc32c_bytes(tail)) + tail


def encode_object(batches: list[bytes]) -> bytes:
    """Batches, an index entry for each, and the trailer."""
    index, at = [], 0
    for b in batches:
        h = HEADER.unpack_from(b)
        index.append(ENTRY.pack(h[0], at, len(b), h[6], h[8], h[12]))
        at += len(b)
    return b"".join([*batches, *index, TRAILER.pack(len(index), MAGIC)])


def read_index(data: bytes) -> list[tuple[int, ...]]:
    """(base offset, position, length, last offset delta, largest time, records) of each batch."""
    if len(data) < TRAILER.size:
        raise ValueError("no trailer")
    n, magic = TRAILER.unpack_from(data, len(data) - TRAILER.size)
    start = len(data) - TRAILER.size - n * ENTRY.size
    if magic != MAGIC or start < 0:
        raise ValueError("not an object file, or its index is cut off")
    return [ENTRY.unpack_from(data, start + i * ENTRY.size) for i in range(n)]


def decode_batch(data: bytes, check: bool = True) -> tuple[tuple, list[Record]]:
    head = HEADER.unpack_from(data)
    if head[3] != 2 or head[1] != len(data) - 12:
        raise ValueError("bad batch header")
    if check and crc32c_bytes(data[21:]) != head[4]:
        raise ValueError("bad checksum")
    return head, list(decode_records(expand(data[HEADER.size :], head[5] & 7), head[12]))


def batch_rows(place: tuple, base: int, data: bytes, check: bool = True) -> Iterator[tuple]:
    """Rows as in RECORDS of one batch; one with an error if it can't be read."""
    try:
        h, records = decode_batch(data, check)
    except (ValueError, IndexError, OSError, struct.error, EOFError) as e:
        yield *place, base, *[None] * 13, str(e) or type(e).__name__
        return
    a = h[5]
    stamp, control = bool(a & BY_APPEND), bool(a & CONTROL)
    for r in records:
        kind = {0: "abort", 1: "commit"}.get(int.from_bytes((r.key or b"")[2:4], "big")) if control else None
        ts = h[8] if stamp else h[7] + r.ts_delta
        headers = [{"key": k, "value": v} for k, v in r.headers]
        yield *place, base, base + r.offset_delta, ts, "LogAppendTime" if stamp else "CreateTime", r.key, r.value, headers, h[9], h[10], h[11], bool(a & TRANSACTIONAL), control, kind, CODECS[a & 7], None


def decoded(files: DataFrame, check: bool = True) -> DataFrame:
    """A row per record of object files (path, content).

    A batch that can't be read gives one row that says why in ``error``, with
    its base offset where known; the other batches are read all the same.
    """
    schema = files.sparkSession.createDataFrame([], RECORDS).schema
    names = schema.names

    def rows(path: str, topic: str, topic_id: str, part: int, content: bytes) -> Iterator[tuple]:
        place = (path, topic, topic_id, part)
        try:
            index = read_index(content)
        except ValueError as e:
            yield *place, *[None] * 14, str(e)
            return
        for base, at, size, *_ in index:
            yield from batch_rows(place, base, content[at : at + size], check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                found = list(rows(row["path"], row["topic"], row["topic_id"], row["part"], row["content"]))
                for i in range(0, len(found), 50_000):
                    columns = list(zip(*found[i : i + 50_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=names)

    return placed(files).mapInArrow(run, schema)


def footers(files: DataFrame) -> DataFrame:
    """A row per index entry of object files (path, content); one with ``error`` for a file without a readable index."""
    schema = files.sparkSession.createDataFrame([], FOOTERS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                place = tuple(row[c] for c in ("path", "topic", "topic_id", "part"))
                try:
                    out += [(*place, b, at, n, b + last, ts, k, None) for b, at, n, last, ts, k in read_index(row["content"])]
                except ValueError as e:
                    out.append((*place, *[None] * 6, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names=schema.names)

    return placed(files).mapInArrow(run, schema)


def placed(files: DataFrame) -> DataFrame:
    """Topic, id and partition from the object key."""
    part = lambda i: F.regexp_extract("path", KEY, i)
    return files.select("path", part(1).alias("topic"), part(2).alias("topic_id"), part(3).try_cast("int").alias("part"), "content")


def object_files(spark: SparkSession, folder: str) -> DataFrame:
    """Object files under a folder: path and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def encoded(log: DataFrame, topic: str, topic_id: str, per_batch: int = 16, per_object: int = 512, codec: int = 0) -> DataFrame:
    """(path, content): object files of a log (part, off, ts_ms, k, v)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, number = (x.as_py() for x in key)
        rows = sorted(table.select(["off", "ts_ms", "k", "v"]).to_pylist(), key=lambda r: r["off"])
        batches, i = [], 0
        while i < len(rows):
            base = rows[i]["off"] // per_batch * per_batch
            j = i
            while j < len(rows) and rows[j]["off"] < base + per_batch:
                j += 1
            first = rows[i]
            records = [Record(r["off"] - base, r["ts_ms"] - first["ts_ms"], *((x.encode() if isinstance(x, str) else x) for x in (r["k"], r["v"]))) for r in rows[i:j]]
            batches.append(encode_batch(base, first["ts_ms"], records, codec))
            i = j
        path = f"{topic}-{topic_id}/{part}/{number * per_object:020d}.obj"
        return pa.table({"path": [path], "content": [encode_object(batches)]})

    rows = log.select("part", F.floor(F.col("off") / per_object).cast("long").alias("object_no"), "off", "ts_ms", "k", "v")
    return rows.groupBy("part", "object_no").applyInArrow(run, "path string, content binary")
