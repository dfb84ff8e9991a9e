"""A corpus pipeline of four stages; each reads what the one before has written and decides on all of it.

Documents that the quality rules reject go; of each component of near-duplicates one document stays; passages that also occur
earlier go from texts; what is left is packed into sequences, which is the result. All stages but the last keep the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ramify.llm import packing, quality, simhash, substring
from ramify.llm.common import load, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands of clean prose."""
    return quality.keep_good(docs, rules=quality.CLEAN)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; SimHash of 5-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that also start earlier."""
    return substring.remove_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]

#: Neither the compressed sizes nor XXH64 nor the tokenizer are in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, f"pipeline-{name}")
    return docs
