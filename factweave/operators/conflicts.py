"""Conflicts: scalar keys whose holders disagree while a plurality exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_pairs(members: DataFrame) -> DataFrame:
    """``artifact_id, key, value`` of ``kv`` facts with a scalar key (one not ending in ``[]``)."""
    at = F.instr("canonical", "=")
    pairs = members.where((F.col("kind") == "kv") & (at > 0)).select("artifact_id", F.expr("substring(canonical, 1, instr(canonical, '=') - 1)").alias("key"), F.expr("substring(canonical, instr(canonical, '=') + 1)").alias("value"))
    return pairs.where(~F.col("key").endswith("[]"))


def value_groups(members: DataFrame) -> DataFrame:
    """``key, value, n, rank`` of disputed keys: rank 1 is the plurality (most holders, then value). A key is
    disputed with two values or more and at least two holders of the first."""
    counts = split_pairs(members).groupBy("key", "value").agg(F.count("*").alias("n"))
    disputed = counts.groupBy("key").agg(F.count("*").alias("n_values"), F.max("n").alias("top")).where("n_values >= 2 and top >= 2").select("key")
    order = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    return counts.join(disputed, "key", "left_semi").withColumn("rank", F.row_number().over(order))


def conflicts(members: DataFrame) -> DataFrame:
    """``key, n_values, plurality, holders, deviants``. An artifact holding both the plurality and another
    value is a deviant too."""
    groups = value_groups(members)
    rows = split_pairs(members).join(groups, ["key", "value"]).groupBy("key", "artifact_id").agg(F.max("rank").alias("worst"))
    people = rows.groupBy("key").agg(F.count("*").alias("holders"), F.count_if(F.col("worst") > 1).alias("deviants"))
    values = groups.groupBy("key").agg(F.count("*").alias("n_values"), F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("plurality"))
    return values.join(people, "key")


def value_holders(members: DataFrame) -> DataFrame:
    """``key, value, rank, n, artifact_id``: a row per holder of every value of every disputed key."""
    return split_pairs(members).join(value_groups(members), ["key", "value"]).select("key", "value", "rank", "n", "artifact_id")


def first_holders(members: DataFrame, shown: int) -> DataFrame:
    """``key, value, rank, n, artifacts``: the count of holders and the first ``shown`` of them, so that a value which
    every artifact holds is still a short row."""
    first = Window.partitionBy("key", "value").orderBy("artifact_id")
    few = value_holders(members).withColumn("at", F.row_number().over(first)).where(F.col("at") <= shown)
    return few.groupBy("key", "value", "rank", "n").agg(F.sort_array(F.collect_list("artifact_id")).alias("artifacts"))


def by_clarity(found: DataFrame) -> DataFrame:
    """Reading order: fewest deviants, most holders, key."""
    return found.orderBy("deviants", F.desc("holders"), "key")
