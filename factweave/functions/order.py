"""Global ranks without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.graph import materialize


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the row's place, from 0, in the order ``order`` of the whole table (which should be total).

    Rows are dealt to sampled ranges and ranked inside; only the ranges' counts, one row a range, meet in a window."""
    return global_sums(df, order, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1)


def global_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums (each row included) in the order ``order`` of the whole table, by ranges like ``global_rank``."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(*(F.sum(v).alias(f"_sum_{k}") for k, v in sums.items()))
    starts = starts.select("_range", *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_start_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(starts), "_range").select("*", *((F.col(f"_start_{k}") + F.sum(v).over(inside)).alias(k) for k, v in sums.items()))
    return placed.drop("_range", *(f"_start_{k}" for k in sums))
