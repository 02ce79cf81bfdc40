"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``documents``; ``run`` writes each stage as Parquet
and reads it again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, langid, minhash, mixing, packing
from tideline.llm._common import Scratch, few_or_all

#: Tokenizers and the parallel sums of SQL have no common ground: bin packing can't be stated in SQL.
ORACLE_SQL = None


#: Stretches of the mix that are packed by themselves, so that sequences follow its order.
STRETCHES = 16


def one_of_each(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], few: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that ``decide`` (doc_id, kept) keeps: one of each of its groups.

    Where doc_ids repeat or are null, rows are numbered in the order of their
    doc_id, null last, and decided on by these numbers; else by doc_id. Texts
    meet the ids that go, not those that stay: these are fewer, and up to
    ``few`` of them are broadcast, so that no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")

    def without(rows: DataFrame, key: str) -> DataFrame:
        gone = decide(rows.withColumn("doc_id", F.col(key))).where("NOT kept").select(F.col("doc_id").alias(key))
        return rows.join(few_or_all(scratch.save(gone, "gone"), few), key, "left_anti").select(*docs.columns)

    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        return without(docs, "doc_id")
    row = next(f"row{i}" for i in range(len(docs.columns) + 1) if f"row{i}" not in docs.columns)
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_last(), "text").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    numbered = scratch.save(ordered.withColumn(row, F.monotonically_increasing_id()), "numbered")
    return without(numbered, row)


def stretch(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with __stretch: which of ``n`` stretches of the stored order a row lies in.

    The order is that of the table's files by name, and of the rows in each;
    a table that isn't read from files keeps the order of its partitions.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        placed = docs.select("*", F.lpad(F.shiftright(at, 33).cast("string"), 10, "0").alias("__file"), at.bitwiseAND((1 << 33) - 1).alias("__row"))
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))  # a row for each file
    sums = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__file", F.coalesce(F.sum("__n").over(sums), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    at = F.floor((F.col("__before") + F.col("__row")) * n / F.col("__all"))
    return placed.join(few_or_all(files, 200_000), "__file").select(*docs.columns, at.alias("__stretch"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labels teach.

    Labels of two thirds of the documents train the model; texts without a
    letter (``und``) are rejected, all others have a learned language.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.train(docs, ~held_out)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = langid.identify(docs.select("doc_id", "text", F.struct(*[F.col(c) for c in rest], F.lit(0).alias("__none")).alias("__rest")), model, carry=["text", "__rest"])
    kept = found.where("lang_pred <> 'und'")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts, the one with the smallest doc_id."""
    return one_of_each(docs, exact_dedup.exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, similarity 0.8."""
    return one_of_each(docs, minhash.near_duplicates)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources by weights 1, 2, 3, repeating; a document comes as often as the mix uses it, in the order of the curriculum."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs everything into sequences of 1024 tokens; their numbers follow the order of the mix, stretch by stretch."""
    import public_tokenizers

    return packing.pack(stretch(docs, STRETCHES), public_tokenizers.path("byte_bpe_50k.json"), part=F.col("__stretch"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
