"""Consumer groups: offsets, membership, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def committed(commits: DataFrame) -> DataFrame:
    """The last commit of each group and partition."""
    return commits.groupBy("grp", "part").agg(F.max_by("committed", "commit_seq").alias("committed"))


def offset_fetch(wanted: DataFrame, commits: DataFrame) -> DataFrame:
    """Committed offsets of the wanted (grp, part); -1 where there is none."""
    return wanted.join(committed(commits), ["grp", "part"], "left").withColumn("committed", F.coalesce("committed", F.lit(-1)))


def offset_delete(offsets: DataFrame, deletes: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Offsets left after deleting (grp, part), but for partitions of subscribed (grp, part)."""
    return offsets.join(deletes.join(subscribed, ["grp", "part"], "left_anti"), ["grp", "part"], "left_anti")


def subscribed_topics(members: DataFrame) -> DataFrame:
    """Distinct (grp, topic) over all members' topics."""
    return members.select("grp", F.explode("topics").alias("topic")).distinct()


def elect_protocol(members: DataFrame) -> DataFrame:
    """grp, protocol: of the protocols that all members support, the one most members list first among these; of equals the first by name.

    members: grp, member_id, protocols in order of preference.
    """
    listed = members.select("grp", "member_id", F.posexplode("protocols").alias("pos", "protocol"))
    n = members.groupBy("grp").agg(F.count_distinct("member_id").alias("n"))
    common = listed.groupBy("grp", "protocol").agg(F.count_distinct("member_id").alias("m")).join(n, "grp").where("m = n").select("grp", "protocol")
    votes = listed.join(common, ["grp", "protocol"]).groupBy("grp", "member_id").agg(F.min_by("protocol", "pos").alias("protocol"))
    counts = votes.groupBy("grp", "protocol").agg(F.count(F.lit(1)).alias("votes"))
    best = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("votes"), "protocol"))
    return counts.withColumn("__r", best).where("__r = 1").drop("__r")


def live_members(heartbeats: DataFrame, now: int | DataFrame, timeout_ms: int) -> DataFrame:
    """grp, member_id, last_seen, expired: a session ends when the timeout has passed since the last heartbeat.

    now: the time, or one row with now_ms.
    """
    seen = heartbeats.groupBy("grp", "member_id").agg(F.max("ts_ms").alias("last_seen"))
    seen = seen.join(F.broadcast(now)) if isinstance(now, DataFrame) else seen.withColumn("now_ms", F.lit(now))
    return seen.withColumn("expired", F.col("now_ms") - F.col("last_seen") >= timeout_ms).drop("now_ms")


def sessions(heartbeats: DataFrame, gap_ms: int) -> DataFrame:
    """grp, member_id, session, began, ended, n: heartbeats no further apart than the gap."""
    order = Window.partitionBy("grp", "member_id").orderBy("ts_ms")
    new = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(order) >= gap_ms, F.lit(False)).cast("int")
    rows = heartbeats.withColumn("__new", new)
    rows = rows.withColumn("session", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("grp", "member_id", "session").agg(F.min("ts_ms").alias("began"), F.max("ts_ms").alias("ended"), F.count(F.lit(1)).alias("n"))


def list_groups(members: DataFrame, offsets: DataFrame, states: list[str] | None = None) -> DataFrame:
    """grp, state, n_members: Stable with live members, Empty with offsets alone."""
    live = members.where("NOT expired").groupBy("grp").agg(F.count(F.lit(1)).alias("n_members"))
    known = members.select("grp").union(offsets.select("grp")).distinct()
    out = known.join(live, "grp", "left").select("grp", F.when(F.col("n_members").isNull(), "Empty").otherwise("Stable").alias("state"), F.coalesce("n_members", F.lit(0)).alias("n_members"))
    return out.where(F.col("state").isin(states)) if states else out


def describe_groups(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """The wanted groups' state; Dead, without an error, where unknown."""
    return wanted.join(listed, "grp", "left").select("grp", F.coalesce("state", F.lit("Dead")).alias("state"), F.coalesce("n_members", F.lit(0)).alias("n_members"))


def delete_groups(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds error_code: only empty groups go (68 if not), unknown ones give 69."""
    return wanted.join(listed, "grp", "left").select("grp", F.when(F.col("state").isNull(), 69).when(F.col("state") == "Stable", 68).otherwise(0).alias("error_code"))


def sync(members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each member's assignment as the leader gave it; null for members that it left out."""
    return members.join(assignments, ["grp", "member_id"], "left")


def commit_errors(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Adds error_code to commits (grp, member_id, generation): 25 for an unknown member, 22 for another generation; none without a member id."""
    known = members.select("grp", "member_id", F.col("generation").alias("__generation"))
    code = F.when(F.coalesce(F.col("member_id"), F.lit("")) == "", 0).when(F.col("__generation").isNull(), 25).when(F.col("generation") != F.col("__generation"), 22).otherwise(0)
    return requests.join(known, ["grp", "member_id"], "left").withColumn("error_code", code).drop("__generation")


def range_assign(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """Partitions dealt to members in turn, both in order: grp, member_id, part."""
    ranked = members.select("grp", "member_id", (F.row_number().over(Window.partitionBy("grp").orderBy("member_id")) - 1).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("grp")).alias("n"))
    return ranked.join(partitions.select("grp", "part"), "grp").where(F.col("part") % F.col("n") == F.col("r")).select("grp", "member_id", "part")


def find_coordinator(requests: DataFrame, node_id: int, host: str, port: int) -> DataFrame:
    """Where the coordinator of each (key, kind) is: the one broker; 42 for a kind other than 0 (group) and 1 (transaction)."""
    known = F.col("kind").isin(0, 1)
    return requests.select("key", "kind", F.when(known, 0).otherwise(42).alias("error_code"), F.when(known, node_id).alias("node_id"), F.when(known, host).alias("host"), F.when(known, port).alias("port"))


def member_id(client_id: Column, instance_id: Column) -> Column:
    """A new member's id: its instance id, or else its client id, and a random UUID."""
    return F.concat(F.coalesce(instance_id, client_id), F.lit("-"), F.uuid())
