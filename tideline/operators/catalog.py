"""Topics, configs and the metadata log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Topic configs and their defaults; fixed values.
DEFAULTS = {
    "cleanup.policy": "delete",
    "compression.type": "producer",
    "retention.ms": "604800000",
    "retention.bytes": "-1",
    "max.message.bytes": "1048588",
    "segment.bytes": "67108864",
    "message.timestamp.type": "CreateTime",
    "min.compaction.lag.ms": "0",
    "max.compaction.lag.ms": "9223372036854775807",
    "delete.retention.ms": "86400000",
}
#: Key, name, least and largest version of each call of the public protocol that a broker of this kind answers.
API_VERSIONS = (
    (0, "Produce", 3, 11),
    (1, "Fetch", 4, 16),
    (2, "ListOffsets", 1, 8),
    (3, "Metadata", 4, 12),
    (8, "OffsetCommit", 0, 9),
    (9, "OffsetFetch", 0, 9),
    (10, "FindCoordinator", 0, 6),
    (11, "JoinGroup", 0, 9),
    (12, "Heartbeat", 0, 4),
    (13, "LeaveGroup", 0, 5),
    (14, "SyncGroup", 0, 5),
    (15, "DescribeGroups", 0, 6),
    (16, "ListGroups", 0, 5),
    (17, "SASLHandshake", 1, 1),
    (18, "ApiVersions", 0, 4),
    (19, "CreateTopics", 2, 7),
    (20, "DeleteTopics", 0, 6),
    (21, "DeleteRecords", 0, 2),
    (22, "InitProducerID", 0, 5),
    (23, "OffsetForLeaderEpoch", 3, 4),
    (24, "AddPartitionsToTxn", 0, 4),
    (25, "AddOffsetsToTxn", 0, 3),
    (26, "EndTxn", 0, 4),
    (28, "TxnOffsetCommit", 0, 4),
    (32, "DescribeConfigs", 0, 4),
    (33, "AlterConfigs", 0, 2),
    (35, "DescribeLogDirs", 0, 4),
    (36, "SASLAuthenticate", 0, 2),
    (37, "CreatePartitions", 0, 3),
    (42, "DeleteGroups", 0, 2),
    (44, "IncrementalAlterConfigs", 0, 1),
    (47, "OffsetDelete", 0, 0),
    (50, "DescribeUserScramCredentials", 0, 0),
    (51, "AlterUserScramCredentials", 0, 0),
    (60, "DescribeCluster", 0, 2),
    (61, "DescribeProducers", 0, 0),
    (65, "DescribeTransactions", 0, 0),
    (66, "ListTransactions", 0, 1),
)
UNSUPPORTED_VERSION = 35


def valid_name(name: Column) -> Column:
    """Not empty, not . or .., at most 249 bytes, letters, digits, dot, underscore and dash only."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9._-]+\z") & ~name.isin(".", "..") & (F.octet_length(name) <= 249), F.lit(False))


def normal_name(name: Column) -> Column:
    """Names that differ in dots and underscores only collide."""
    return F.replace(name, F.lit("."), F.lit("_"))


def collisions(names: DataFrame) -> DataFrame:
    """Names that another name collides with; adds normal."""
    rows = names.select("name").distinct().withColumn("normal", normal_name(F.col("name")))
    return rows.join(rows.groupBy("normal").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("normal"), "normal", "left_semi")


def create_topics(requests: DataFrame, catalog: DataFrame, default_partitions: int = 1) -> DataFrame:
    """error_code and partitions for each request (seq, name, n_parts, config_name).

    In order: a name twice in the request fails all of it (42); a bad name
    (17); one that exists (36); a collision with the catalog or an earlier
    name (17); no partitions (37; negative: the default); an unknown config (40).
    """
    names = catalog.select("name").withColumn("normal", normal_name(F.col("name")))
    rows = requests.withColumn("normal", normal_name(F.col("name")))
    twice = requests.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    earlier = F.min("seq").over(Window.partitionBy("normal"))
    rows = rows.join(names.select("name", F.lit(True).alias("there")), "name", "left").join(names.select("normal").distinct().withColumn("close", F.lit(True)), "normal", "left")
    rows = rows.withColumn("__first", earlier).join(F.broadcast(twice))  # one row
    code = (
        F.when(F.col("most") > 1, 42)
        .when(~valid_name(F.col("name")), 17)
        .when(F.col("there"), 36)
        .when(F.col("close") | (F.col("__first") < F.col("seq")), 17)
        .when(F.col("n_parts") == 0, 37)
        .when(F.col("config_name").isNotNull() & ~F.col("config_name").isin(list(DEFAULTS)), 40)
        .otherwise(0)
    )
    n = F.when(code == 0, F.when(F.col("n_parts") < 0, default_partitions).otherwise(F.col("n_parts"))).otherwise(-1)
    return rows.select("seq", "name", code.alias("error_code"), n.cast("int").alias("partitions"))


def delete_topics(catalog: DataFrame, deletes: DataFrame) -> DataFrame:
    """The catalog without topics named by name or topic_id."""
    return catalog.join(deletes.where("name IS NOT NULL").select("name"), "name", "left_anti").join(deletes.where("topic_id IS NOT NULL").select("topic_id"), "topic_id", "left_anti")


def create_partitions(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """error_code and count for (name, count): 3 unknown, 37 unless it grows."""
    rows = requests.join(catalog.select("name", "partition_count"), "name", "left")
    code = F.when(F.col("partition_count").isNull(), 3).when(F.col("count") <= F.col("partition_count"), 37).otherwise(0)
    return rows.select("name", code.alias("error_code"), F.when(code == 0, F.col("count")).otherwise(F.col("partition_count")).alias("partition_count"))


def describe_configs(topics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """name, config, value, is_default: defaults overlaid with each topic's own configs (a string map)."""
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])
    own = F.coalesce("configs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k))
    rows = topics.select("name", own.alias("own"), F.explode(F.map_concat(kept, own)).alias("config", "value"))
    if names:
        rows = rows.where(F.col("config").isin(names))
    return rows.select("name", "config", "value", (~F.map_contains_key("own", F.col("config"))).alias("is_default"))


def api_versions(spark: SparkSession, asked: int) -> DataFrame:
    """api_key, name, min_version, max_version, and error_code and version of the answer: 0 and 35 if ``asked`` isn't known."""
    least, most = next((a, b) for k, _, a, b in API_VERSIONS if k == 18)
    known = least <= asked <= most
    rows = spark.createDataFrame(list(API_VERSIONS), "api_key int, name string, min_version int, max_version int")
    return rows.select("*", F.lit(0 if known else UNSUPPORTED_VERSION).alias("error_code"), F.lit(asked if known else 0).alias("version"))


def describe_cluster(spark: SparkSession, cluster_id: str, node_id: int, host: str, port: int) -> DataFrame:
    """The one broker, which is the controller too."""
    return spark.createDataFrame([(cluster_id, node_id, node_id, host, port)], "cluster_id string, controller_id int, node_id int, host string, port int")


def describe_broker(spark: SparkSession, node_id: int, names: list[str] | None = None) -> DataFrame:
    """name, config, value, is_default, read_only of the broker resource: its id alone."""
    rows = spark.range(1).select(F.lit(str(node_id)).alias("name"), F.lit("broker.id").alias("config"), F.lit(str(node_id)).alias("value"), F.lit(False).alias("is_default"), F.lit(True).alias("read_only"))
    return rows.where(F.col("config").isin(names)) if names else rows


def alter_configs(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """(name, config, value) after incremental changes (name, config, op, value, seq): the last SET or DELETE counts, other ops do nothing."""
    last = changes.where(F.col("op").isin("SET", "DELETE")).groupBy("name", "config").agg(F.max_by(F.struct("op", "value"), "seq").alias("x"))
    kept = configs.join(last.select("name", "config"), ["name", "config"], "left_anti")
    return kept.unionByName(last.where("x.op = 'SET'").select("name", "config", F.col("x.value").alias("value")))


def replace_configs(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """All configs of the named topics become the given ones."""
    return configs.join(changes.select("name").distinct(), "name", "left_anti").unionByName(changes.select("name", "config", "value"))


def readable_prefix(entries: DataFrame) -> DataFrame:
    """Entries before the first bad one (seq, good)."""
    first = entries.where("NOT good").agg(F.min("seq").alias("__bad"))
    return entries.join(F.broadcast(first)).where("__bad IS NULL OR seq < __bad").drop("__bad")  # one row


def fold_metadata(entries: DataFrame) -> DataFrame:
    """State from events (seq, kind, entity, value; null value: deleted): the last of each kind and entity, partition counts by their largest."""
    last = entries.where("kind <> 'PartitionCount'").groupBy("kind", "entity").agg(F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    largest = entries.where("kind = 'PartitionCount'").groupBy("kind", "entity").agg(F.max(F.col("value").try_cast("long")).cast("string").alias("value"))
    return last.unionByName(largest).where("value IS NOT NULL")


def stale_share(entries: DataFrame) -> DataFrame:
    """total, live, stale_ppm: bytes of all entries, of the last of each key, and the stale share in millionths."""
    live = entries.groupBy("kind", "entity").agg(F.max_by("bytes", "seq").alias("live"), F.sum("bytes").alias("total"))
    sums = live.agg(F.sum("total").cast("long").alias("total"), F.sum("live").cast("long").alias("live"))
    return sums.withColumn("stale_ppm", F.floor((F.col("total") - F.col("live")) * 1_000_000 / F.col("total")).cast("long"))


def infer_topics(paths: DataFrame) -> DataFrame:
    """name, topic_id, partition_count from object keys ``[prefix/]name-<32 hex>/partition/offset.obj``."""
    pattern = r"^(?:.*/)?([^/]+)-([0-9a-f]{32})/(\d+)/(\d+)\.obj$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = paths.where(F.col("path").rlike(pattern)).select(part(1).alias("name"), part(2).alias("topic_id"), part(3).cast("int").alias("part"))
    return rows.groupBy("name", "topic_id").agg((F.max("part") + 1).alias("partition_count"))


def replay_reasons(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """reason, n: why entries (topic, part, good, last_offset) are skipped or applied in a replay."""
    rows = entries.join(catalog.select(F.col("name").alias("topic"), "partition_count", "log_start"), "topic", "left")
    reason = (
        F.when(F.col("partition_count").isNull(), "unknown topic")
        .when((F.col("part") < 0) | (F.col("part") >= F.col("partition_count")), "partition out of range")
        .when(~F.col("good"), "bad header")
        .when(F.col("last_offset") < F.col("log_start"), "below log start")
        .otherwise("applied")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def raise_watermarks(state: DataFrame, probed: DataFrame) -> DataFrame:
    """hw after probing: never lower than before."""
    return state.join(probed.select("part", F.col("hw").alias("__hw")), "part", "left").withColumn("hw", F.greatest("hw", F.coalesce("__hw", F.lit(0)))).drop("__hw")


def replay_log_starts(state: DataFrame, starts: DataFrame) -> DataFrame:
    """state (part, log_start, hw) after a replay of log starts (part, log_start): the largest counts, and none lies above hw then."""
    last = starts.groupBy("part").agg(F.max("log_start").alias("__start"))
    rows = state.join(last, "part", "left").withColumn("log_start", F.greatest("log_start", "__start"))
    return rows.withColumn("hw", F.greatest("hw", "log_start")).drop("__start")


def promoted(batches: DataFrame, state: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a promoted broker starts from: state (part, hw) raised to the end of the log, and the batches not flushed yet (marks: part, wm)."""
    ends = batches.groupBy("part").agg((F.max("last_offset") + 1).alias("hw"))
    return raise_watermarks(state, ends), batches.join(marks, "part").where("last_offset >= wm").drop("wm")


def metadata(wanted: DataFrame | None, catalog: DataFrame, create: bool = False, default_partitions: int = 1) -> DataFrame:
    """name, topic_id, partition_count, error_code of the wanted names (null: all topics); 3 where unknown, unless they are created."""
    if wanted is None:
        return catalog.select("name", "topic_id", "partition_count", F.lit(0).alias("error_code"))
    rows = wanted.select("name").distinct().join(catalog.select("name", "topic_id", "partition_count"), "name", "left")
    new = F.col("topic_id").isNull() & F.lit(create) & valid_name(F.col("name"))
    code = F.when(~valid_name(F.col("name")), 17).when(F.col("topic_id").isNull() & ~new, 3).otherwise(0)
    return rows.select("name", F.when(new, F.md5("name")).otherwise(F.col("topic_id")).alias("topic_id"), F.when(new, default_partitions).otherwise(F.col("partition_count")).cast("long").alias("partition_count"), code.alias("error_code"))
