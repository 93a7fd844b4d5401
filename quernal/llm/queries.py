"""One query for each operator, on its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm import bpe, embedding_dedup, exact_dedup, html_text, licences, mixing, near_dedup, pii, quality, sharding

#: Where the vocabulary lies on every machine: the folder and the file.
TOKENIZERS, VOCABULARY = os.path.split(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.annotate(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.annotate(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), os.path.join(TOKENIZERS, VOCABULARY))
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select(F.col("id").alias("doc_id"), n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(mixing.sizes(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.annotate(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it stands beside the driver's entry and imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_exact_dedup, op3_bpe, op4_mixing, op5_licences, op6_quality, op7_html_text, op8_pii, op9_near_dedup, op10_sharding, pipeline)
}

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (
  SELECT vec_id AS v, vec_id AS r FROM v
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = v.vec_id
"""

OP2_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {UPPER}, {LOWER})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP4_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
o AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 3 / weight, source NULLS LAST) AS place FROM s),
p AS (
  SELECT *, total - coalesce(sum(source_size * 3) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM o),
l AS (SELECT place AS at, CAST(words_left AS DOUBLE) AS words_left, weight_left FROM p WHERE words_left * weight <= source_size * 3 * weight_left ORDER BY place LIMIT 1),
t AS (
  SELECT p.source, p.source_size, CASE WHEN l.at IS NULL OR p.place < l.at THEN CAST(p.source_size * 3 AS DOUBLE) ELSE p.weight * l.words_left / l.weight_left END AS target
  FROM p LEFT JOIN l ON TRUE),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
f AS (SELECT *, target - whole * source_size AS extra FROM e),
a AS (
  SELECT d.doc_id, d.source, d.size, d.key, f.source_size, f.target, f.whole, f.extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) <= f.extra AS one
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
m AS (SELECT *, extra - coalesce(sum(size) FILTER (WHERE one) OVER (PARTITION BY source), 0) AS missed FROM a),
n AS (
  SELECT *, NOT one AND size <= missed / 4 AS may FROM m),
r AS (
  SELECT *, may AND coalesce(sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING), 0) <= missed AS two FROM n)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN one OR two THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

OP9_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS h FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE na.n * 100 >= nb.n * 75 AND nb.n * 100 >= na.n * 75
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = n.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_mixing": OP4_SQL, "op9_near_dedup": OP9_SQL}
