"""The queries of this subpackage, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, ctw, imatch, packing, quality, sharding, simhash, substring, warc, word_bpe
from .common import load


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(load(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(load(spark, sf_dir, "documents"))


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(load(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(load(spark, sf_dir, "documents"), rules=quality.CLEAN).drop("reason")


def op6_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_bpe.encode(load(spark, sf_dir, "documents"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(load(spark, sf_dir, "documents"))


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(load(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_imatch_fingerprints, op2_simhash_near_dedup, op3_substring_dedup, op4_histogram_sharding, op5_quality_rules, op6_distinct_word_bpe, op7_warc_round_trip, op8_token_attribution, op9_context_tree_weighting, op10_best_fit_packing)}

#: All rows of a payload of at least 1000 bytes but those of the largest page_id are revisits.
OP7 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m
  FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND m <> page_id THEN m END AS refers_to
FROM p
"""

#: A window's word sequence is one string of 20 words; it goes if it is not the first of its sequence by document and start.
OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
h AS (
  SELECT doc_id, j, word, sha256(string_agg(word, ' ') OVER o) AS seq, count(*) OVER o AS n
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
g AS (SELECT doc_id, j, word, n = 20 AND row_number() OVER (PARTITION BY seq, n ORDER BY doc_id, j) > 1 AS again FROM h),
r AS (SELECT doc_id, j, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM g),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": OP3, "op7_warc_round_trip": OP7}
