"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, Scratch, attach


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, carry: list[str] | None = None, prefix: int = 128, broadcast_keys: int = 500_000, digest: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the ``carry`` columns, keep_id, group_size, kept (and ``digest``, the SHA-256 of the normalised text).

    Rows are equal when their normalised texts are. First rows are counted by
    length, then rows of shared lengths by a hash of their first ``prefix``
    characters; only rows whose (length, prefix hash) is shared are compared
    by their full hash (SHA-256), and equal hashes make the groups. The
    surviving keys meet the rows by a broadcast while there are at most
    ``broadcast_keys`` of them (16 bytes each), else by a shuffle that deals
    hot keys out. Groups of any size are counted by map-side aggregation.

    Without ``digest`` texts are read twice: whole ones only of rows that
    survive. A caller who wants every row's full hash names a column for it:
    then one scan makes length, prefix hash and full hash, and the refinement
    goes over these numbers.

    Of a group the smallest doc_id stays. Null doc_ids count as larger than
    any other; a group of nothing else keeps null. Rows that repeat a doc_id
    and a text are kept or dropped together; rows that repeat a doc_id with
    another text belong to that text's group. Empty texts are equal to one
    another, and so are texts of white space only to " ". An empty table gives
    no rows; columns of ``docs`` not in ``carry`` are left out, whatever their
    names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    carry = [c for c in carry or [] if c not in ("doc_id", digest)]
    norm = docs.select("doc_id", *carry, normalised(F.col("text")).alias("__norm"))
    refined = [F.octet_length("__norm").alias("__len"), F.xxhash64(F.left("__norm", F.lit(prefix))).alias("__ph")]
    if digest:
        rows = scratch.save(norm.select("doc_id", *carry, *refined, F.sha2("__norm", 256).alias("__hash")), "rows")
    else:
        rows = norm.select("doc_id", *carry, *refined, "__norm")

    keys = scratch.save(rows.groupBy("__len", "__ph").agg(F.count(F.lit(1)).alias("__n")), "keys")
    lengths = keys.groupBy("__len").agg(F.sum("__n").alias("__rows")).where("__rows > 1").select("__len")
    shared = keys.join(lengths, "__len", "left_semi").where("__n > 1")
    if shared.count() <= broadcast_keys:
        found = rows.join(F.broadcast(shared), ["__len", "__ph"], "left")
    else:
        found = attach(rows, shared, ["__len", "__ph"], "__n", ["__n"], keys.agg(F.sum("__n")).first()[0], ["doc_id"])
    full = F.col("__hash") if digest else F.sha2("__norm", 256)
    named = [F.col("__hash").alias(digest)] if digest else []
    hashed = scratch.save(found.select("doc_id", *carry, *named, F.when(F.col("__n").isNotNull(), F.unhex(full)).alias("__full")), "hashed")

    many = hashed.where("__full IS NOT NULL")
    groups = many.groupBy("__full").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = attach(many, groups, ["__full"], "group_size", ["keep_id", "group_size"], many.count(), ["doc_id", *carry])
    alone = hashed.where("__full IS NULL").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    both = grouped.unionByName(alone.select(*grouped.columns))
    return both.select("doc_id", *carry, *([digest] if digest else []), "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"))
