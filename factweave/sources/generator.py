"""Synthetic configuration corpora with planted rogues, as facts or as files' text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORE_KEYS, OWN_KEYS, ROGUE_CORE, ROGUE_OWN = 40, 2, 3, 30


def generated_corpus(spark: SparkSession, n: int, rogues: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(artifacts, facts)`` of ``n`` members of which ``rogues`` deviate. Rogue positions are the members
    with the smallest seeded hash, found by one top-k."""
    ids = spark.range(n).withColumnRenamed("id", "artifact_id")
    bad = ids.orderBy(F.xxhash64(F.lit(seed), "artifact_id"), "artifact_id").limit(rogues).withColumn("rogue", F.lit(True))
    marked = ids.join(F.broadcast(bad) if rogues <= 200_000 else bad, "artifact_id", "left").na.fill(False, ["rogue"])
    name = F.concat(F.when(F.col("rogue"), "rogue").otherwise("host"), F.format_string("-%08d.yaml", "artifact_id"))
    artifacts = marked.select("artifact_id", name.alias("path"), F.lit("yaml").alias("kind"), F.lit(0).cast("long").alias("size"))
    shared = F.transform(F.sequence(F.lit(0), F.when(F.col("rogue"), ROGUE_CORE - 1).otherwise(CORE_KEYS - 1)), lambda k: F.concat(F.lit("core.key"), k.cast("string"), F.lit("=value"), k.cast("string")))
    own = F.transform(F.sequence(F.lit(0), F.when(F.col("rogue"), ROGUE_OWN - 1).otherwise(OWN_KEYS - 1)), lambda k: F.concat(F.lit("own.m"), F.col("artifact_id").cast("string"), F.lit(".k"), k.cast("string"), F.lit("=x")))
    rows = marked.select("artifact_id", F.posexplode(F.concat(shared, own)).alias("ord", "canonical"))
    return artifacts, rows.select("artifact_id", "ord", F.lit("kv").alias("kind"), "canonical", (F.col("ord") + 1).alias("line"))


def rendered(facts: DataFrame, kind: str = "yaml") -> DataFrame:
    """``artifact_id, content``: the facts of each member written as ``yaml``, ``json`` or ``conf`` text."""
    key, value = F.substring_index("canonical", "=", 1), F.substring_index("canonical", "=", -1)
    line = {"conf": F.concat(key, F.lit(" = "), value), "yaml": F.concat(key, F.lit(": "), value), "json": F.concat(F.lit('"'), key, F.lit('": "'), value, F.lit('"'))}[kind]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), ",\n" if kind == "json" else "\n")
    body = F.concat(F.lit("{\n"), body, F.lit("\n}\n")) if kind == "json" else F.concat(body, F.lit("\n"))
    return facts.groupBy("artifact_id").agg(F.encode(body, "UTF-8").alias("content"))
