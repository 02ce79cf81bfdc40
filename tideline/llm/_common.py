"""What several operators share: scratch tables, skew-safe joins, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts write it.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only a local session may run without
    that setting: there one machine holds everything and a temporary folder
    will do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tideline-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when its execution ends; its rows are on disk by then."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor rereads them.

    ``save`` writes a table and returns it as read back. ``drop`` removes
    tables that no later step reads; the rest go when the interpreter ends,
    because the frame an operator returns may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0
        atexit.register(self.close)

    def save(self, df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is over: nothing can be reached any more
            pass


def few_or_all(table: DataFrame, limit: int) -> DataFrame:
    """``table`` to be broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(table) if table.count() <= limit else table


def attach(rows: DataFrame, groups: DataFrame, key: list[str], size: str, values: list[str], n_rows: int, spread: list[str]) -> DataFrame:
    """Left join of ``values`` of ``groups`` (one row a key) to ``rows``, whatever the share of a key.

    A key that holds over a thousandth of ``n_rows`` is heavy; there can be a
    thousand of those at most, so their rows are broadcast. All other keys
    meet in a shuffle, where none is large; rows with a heavy key are dealt
    out there by a salt made of ``spread`` and match nothing.
    """
    if n_rows < 1000:
        return rows.join(groups.select(*key, *values), key, "left")
    heavy = groups.where(F.col(size) * 1000 > F.lit(n_rows))
    zero = F.shiftrightunsigned(F.col(size).cast("long"), 63)  # not a literal: Catalyst would drop it from the join's keys
    hot = heavy.select(*key, *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(1).alias("__hot"))
    cold = groups.where(F.col(size) * 1000 <= F.lit(n_rows)).select(*key, *[F.col(v).alias(f"__cold_{v}") for v in values], zero.alias("__salt"))
    salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(*spread), 1) + 1).cast("long")
    joined = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).join(cold, [*key, "__salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{v}", f"__cold_{v}").alias(v) for v in values])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """Connected components of ``edges`` (u, v long): node, component for each node that isn't its component's smallest.

    Alternating large-star and small-star rounds over DataFrames. Each round
    leaves one table in the shared folder and sends the driver three numbers.
    Every node ends on the smallest id that it can reach.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def settled(e: DataFrame) -> bool:
        """Whether each node has one edge, to a node that has none."""
        if e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            return False
        return not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()

    now = scratch.save(edges, "edges")
    for _ in range(rounds):
        if settled(now):
            break
        n = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = attach(both, least, ["u"], "n", ["m"], 2 * n, ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = attach(large, least, ["u"], "n", ["m"], n, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        then = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        scratch.drop(now, large)
        now = then
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def long_col(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def partitions(total: int, each: int) -> int:
    """How many parts of about ``each`` hold ``total``; one at least."""
    return max(1, -(-int(total) // each))
