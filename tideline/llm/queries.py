"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, langid, lines, minhash, mixing, packing, suffixes, toxicity, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chat(turns.unionByName(more)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    rows = docs.select("doc_id", "text", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))
    scored = toxicity.score(rows, model, carry=["held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), room=1024, end_id=2)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.fuzzy_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=5, share=(85, 100))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(remainder(3) == 1, F.lit(False))
    model = langid.train(docs, ~out)
    return langid.identify(docs.select("doc_id", "text", out.alias("held_out")), model, carry=["held_out"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)
    plan = plan.withColumn("position", F.round(F.get("uses", F.lit(0))["position"], 9)).orderBy(F.col("position").asc_nulls_last(), "doc_id")
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest="text_sha256")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_substrings(table(spark, sf_dir, "documents"), length=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.insert(0, top)
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), controls AS (
  SELECT unnest(['<|turn|>', '<|end|>', '<|im_start|>', '<|im_end|>', '<|endoftext|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>']) AS c
), sized AS (
  SELECT conv_id, turn, role, text,
    (SELECT sum((length(role || chr(0) || text) - length(replace(role || chr(0) || text, c, ''))) // length(c)) FROM controls) AS n_control,
    length(role || text) - length(replace(role || text, chr(92), '')) + length(role) - length(replace(role, chr(10), '')) AS n_other
  FROM said
), placed AS (
  SELECT *, length('<|turn|>') + length('<|end|>') + 2 + length(role) + length(text) + n_control + n_other AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM placed
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

OP5_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a, good b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT DISTINCT u, u AS v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), degree AS (SELECT u, count(*) AS n FROM links GROUP BY u), least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(l.c, e.vec_id) AS component_id, coalesce(l.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.u = e.vec_id LEFT JOIN least l ON l.u = e.vec_id
"""

OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)
), reach AS (
  SELECT DISTINCT u, u AS v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.u = d.doc_id
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT *, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 16) AS k FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0 * CAST(sum(size) AS DOUBLE) AS cap,
    CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source) AS r,
    CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(w) OVER (ORDER BY cap / w DESC, source DESC) AS free
  FROM sources
), level AS (SELECT left_, free FROM ranked WHERE left_ * w / free <= cap ORDER BY r LIMIT 1
), targets AS (SELECT source, source_size, w, least(cap, level.left_ * w / level.free) AS target FROM ranked, level
), placed AS (
  SELECT doc_id, size, source_size, target, w, CAST(floor(target + 0.5) AS BIGINT) AS goal,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k.k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size END AS whole FROM placed
), cut AS (
  SELECT *, least(greatest(goal - whole * source_size - start, 0), size) AS rest FROM passes
), due AS (
  SELECT *, CASE WHEN size > 0 AND (whole > 0 OR rest > 0) THEN (start + CASE WHEN whole > 0 THEN size ELSE rest END / 2.0) / goal END AS share FROM cut
)
SELECT doc_id, size, source_size, target, CAST(whole * size + rest AS BIGINT) AS taken,
  round(CASE WHEN share >= 1 THEN 1.0 WHEN w = 1 THEN 1.5 - sqrt(2.25 - 2 * share) WHEN w = 2 THEN share ELSE sqrt(0.25 + 2 * share) - 0.5 END, 9) AS position
FROM due
"""

OP9_SQL = r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (SELECT t, min(doc_id) AS keep_id, count(*) AS n FROM normal GROUP BY t)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM normal JOIN grouped USING (t)
"""

QUERIES = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_toxicity, op3_best_fit_packing, op4_fuzzy_lines, op5_embedding_near_dedup, op6_minhash_near_dedup, op7_language_id, op8_mixing, op9_exact_dedup, op10_suffix_array_dedup, pipeline)
}
ORACLES = {"op1_chat_formatting": OP1_SQL, "op5_embedding_near_dedup": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op9_exact_dedup": OP9_SQL}
