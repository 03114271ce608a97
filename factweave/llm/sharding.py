"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash and ranked within their source; sorting all rows by fractional
rank ``(rank + 0.5) / rows of the source`` interleaves the sources in proportion, so any contiguous
cut of that order has the mixture of the whole. ``shards`` equal cuts give counts at most one apart.

Ranks are distributed (``common.running``): a source with a third of all rows is spread over as many
ranges as its rows need. Defined cases: a null source is a source of its own; a null doc_id is a value like any other; a null text has size 1
and crc32 0; equal rows are interchangeable; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import materialize, n_buckets, running, table, unit

SHARDS = 8
SEED = 20


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, text_crc32, position, shard, slot`` for every row of ``docs``."""
    body = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("src"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    slim = materialize(slim.withColumn("u", unit(F.col("doc_id"), F.col("text_crc32"), F.col("size"), seed=seed)))
    total = slim.count()
    buckets = n_buckets(total)
    ranked = running(slim, ["src"], "u", ["doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "rank", buckets)
    sizes = slim.groupBy("src").agg(F.count("*").alias("rows"))
    frac = ranked.join(sizes, "src").withColumn("f", (F.col("rank") - 0.5) / F.col("rows")).withColumn("all", F.lit(0))
    frac = materialize(frac.select("doc_id", "src", "size", "text_crc32", "rank", "f", "all"))
    placed = running(frac, ["all"], "f", ["src", "rank"], F.lit(1).cast("long"), "place", buckets)
    pos = F.col("place") - 1
    cut = placed.withColumn("position", pos).withColumn("shard", F.floor(F.expr(f"(place - 1) * {shards} div {max(total, 1)}")).cast("int"))
    first = F.expr(f"(cast(shard as long) * {max(total, 1)} + {shards - 1}) div {shards}")
    return cut.select(
        "doc_id", F.when(F.col("src") != "n", F.expr("substring(src, 2)")).alias("source"), "size", "text_crc32", "position", "shard", (F.col("position") - first).alias("slot")
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return digest(interleave(table(spark, sf_dir, "documents")))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
