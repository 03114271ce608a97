"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns
the shard of every row of the mix. All stages: columns may have any names, an empty table gives no rows, texts of any length are
read whole, and a null doc_id or source is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import decontaminate, mixing, ngram_join, quality, sharding
from factweave.llm.common import materialize, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects. A null text counts as empty and is rejected; equal rows fare
    alike."""
    return quality.keep_documents(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the smallest doc_id (null last); of equal rows one. Texts without
    words link with nothing and stay."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item. Rows are judged by their own text; null and empty texts and items
    match nothing; without items all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words are never taken; equal rows share what the mix takes of
    them."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row. A null text has size 1 and crc32 0; equal rows are interchangeable."""
    return sharding.digest(sharding.interleave(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("shards", shards),
]
#: Word hashing, alignment and the shuffled mix have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = materialize(out)
            if before is not None:
                release(before)
            before = out
        docs = out
    return docs
