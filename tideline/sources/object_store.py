"""Object files in a store that the executors reach by pyarrow (local, HDFS, S3, GCS): range reads, a sink, deletion, compaction in place.

``object_files`` reads whole files through Spark, from any store that Spark
knows; what is here needs random access or writes single files, which Spark's
sources don't offer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compaction import latest_per_key
from . import object_files as O

TAIL = 64 * 1024


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a bare path is local."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri if re.match(r"^\w+:/", uri) else f"file://{uri}"))


def read_tail(uri: str, tail: int = TAIL) -> list[tuple[int, ...]]:
    """The index of an object from its last bytes; a second read only if it is longer than ``tail``."""
    system, path = located(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        data = f.read_at(min(tail, size), size - min(tail, size))
        if len(data) >= O.TRAILER.size:
            n, magic = O.TRAILER.unpack_from(data, len(data) - O.TRAILER.size)
            whole = O.TRAILER.size + n * O.ENTRY.size
            if magic == O.MAGIC and len(data) < whole <= size:
                data = f.read_at(whole, size - whole)
        return O.read_index(data)


def tail_footers(paths: DataFrame, tail: int = TAIL) -> DataFrame:
    """As ``object_files.footers``, for paths (path), without reading the batches."""
    schema = paths.sparkSession.createDataFrame([], O.FOOTERS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                place = tuple(row[c] for c in ("path", "topic", "topic_id", "part"))
                try:
                    out += [(*place, b, at, n, b + last, ts, k, None) for b, at, n, last, ts, k in read_tail(row["path"], tail)]
                except (ValueError, OSError) as e:
                    out.append((*place, *[None] * 6, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names=schema.names)

    return O.placed(paths.select("path", F.lit(None).cast("binary").alias("content"))).drop("content").mapInArrow(run, schema)


def spans(wanted: list[tuple[int, int]], limit: int) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, start, end) of runs of neighbouring (position, length), in order, each of at most ``limit`` bytes or one batch."""
    out: list[tuple[int, int, int, int]] = []
    for i, (at, n) in enumerate(wanted):
        if out and out[-1][3] == at and at + n - out[-1][2] <= limit:
            out[-1] = (out[-1][0], i + 1, out[-1][2], at + n)
        else:
            out.append((i, i + 1, at, at + n))
    return out


def read_batches(index: DataFrame, check: bool = True, limit: int = 8 << 20) -> DataFrame:
    """Records of the batches that rows of an index (as in FOOTERS) name: one range read for each run of neighbours."""
    schema = index.sparkSession.createDataFrame([], O.RECORDS).schema
    columns = ["object_key", "topic", "topic_id", "part", "base_offset", "byte_position", "batch_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            by_key: dict[str, list[dict]] = {}
            for row in batch.to_pylist():
                by_key.setdefault(row["object_key"], []).append(row)
            for key, rows in by_key.items():
                system, path = located(key)
                with system.open_input_file(path) as f:
                    for i, j, start, end in spans([(r["byte_position"], r["batch_length"]) for r in rows], limit):
                        data, found = f.read_at(end - start, start), []
                        for r in rows[i:j]:
                            at = r["byte_position"] - start
                            found += O.batch_rows((key, r["topic"], r["topic_id"], r["part"]), r["base_offset"], data[at : at + r["batch_length"]], check)
                        if found:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f_.type) for c, f_ in zip(zip(*found, strict=True), arrow, strict=True)], names=schema.names)

    return index.where("error IS NULL").select(*columns).repartition("object_key").sortWithinPartitions("object_key", "byte_position").mapInArrow(run, schema)


def write_objects(files: DataFrame, folder: str) -> DataFrame:
    """Writes objects (path, content) below ``folder``; path and size of each. Run it by an action.

    A file appears under its name only when it is whole, so a task that runs
    again, or twice at once, leaves the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                uri = f"{folder.rstrip('/')}/{row['path']}"
                system, path = located(uri)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(part) as f:
                    f.write(row["content"])
                system.move(part, path)
                done.append((uri, len(row["content"])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size long")


def remove_objects(paths: DataFrame) -> DataFrame:
    """Deletes objects (path); path and removed (false where there was none). Run it by an action."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for uri in batch.column("path").to_pylist():
                system, path = located(uri)
                there = system.get_file_info(path).type == fs.FileType.File
                if there:
                    system.delete_file(path)
                gone.append(there)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(gone, pa.bool_())], names=["path", "removed"])

    return paths.select("path").mapInArrow(run, "path string, removed boolean")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the objects below a folder, not their contents."""
    return O.object_files(spark, folder).select("path")


def compact_objects(spark: SparkSession, folder: str, topic: str, topic_id: str, marks: str, per_object: int = 512, codec: int = 0) -> DataFrame:
    """Compacts the objects of a topic in place, keeping the latest record of each key; part, watermark.

    New objects are written first, then the watermarks (the last offset that
    is left, or that there was if nothing is left) as a table at ``marks``,
    and only then go the objects that no new one has replaced. A run that
    broke off is run again: it finds old and new objects, whose records are
    told apart by offset, and ends with the same.
    """
    folder = folder.rstrip("/")
    files = O.object_files(spark, folder).where(F.contains("path", F.lit(f"/{topic}-{topic_id}/")))
    records = O.decoded(files).where("error IS NULL").select("part", "off", "ts_ms", F.col("key").alias("k"), F.col("value").alias("v")).dropDuplicates(["part", "off"])
    kept = latest_per_key(records)
    written = write_objects(O.encoded(kept, topic, topic_id, per_object=per_object, codec=codec), folder)
    names = {re.sub(r"^file:/+", "/", r["path"]) for r in written.collect()}  # one row a file
    before = [r["path"] for r in files.select("path").collect()]
    had = records.groupBy("part").agg(F.max("off").alias("__had"))
    left = kept.groupBy("part").agg(F.max("off").alias("__left"))
    had.join(left, "part", "left").select("part", F.coalesce("__left", "__had").alias("watermark")).write.mode("overwrite").parquet(marks)
    old = [(p,) for p in before if re.sub(r"^file:/+", "/", p) not in names]
    if old:
        remove_objects(spark.createDataFrame(old, "path string")).collect()
    return spark.read.parquet(marks)
