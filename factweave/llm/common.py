"""Shared plumbing of the training-data operators: word classes, distributed ranks and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions.graph import components, materialize, release, shared_dir, small
from factweave.functions.order import global_rank, global_sums

__all__ = ["components", "materialize", "release", "shared_dir", "small", "global_rank", "global_sums", "lower_ascii", "table", "unit", "n_buckets", "running"]

#: Java and RE2 class of word characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_AZ = UPPER.lower()


#: Totals of so many ranges meet in one window.
SPAN = 1000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER_AZ)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*cols: Column, seed: int = 0) -> Column:
    """A seeded hash of ``cols`` as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *cols), 11) / F.lit(float(1 << 53))


def n_buckets(rows: int, per_bucket: int = 20_000) -> int:
    """How many hash or key ranges hold ``rows`` rows at about ``per_bucket`` each."""
    return max(1, -(-rows // per_bucket))


def running(df: DataFrame, keys: list[str], position: str, order: list[str], value: Column, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` up to and including this
    one, by ``(position, *order)``. No task sorts a whole key: ``position`` (a double in [0, 1), part
    of the order) is cut into ``buckets`` ranges, range totals are summed first (by spans of ``SPAN`` ranges, and the spans), and
    only rows of one range meet in a window. ``keys`` must not be null."""
    b = df.withColumn("_bucket", F.floor(F.col(position) * buckets)).withColumn("_value", value)
    totals = b.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total")).withColumn("_span", F.expr(f"_bucket div {SPAN}"))
    spans = totals.groupBy(*keys, "_span").agg(F.sum("_total").alias("_all"))
    earlier = lambda cut, order: Window.partitionBy(*keys, *cut).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    spans = spans.select(*keys, "_span", F.coalesce(F.sum("_all").over(earlier([], "_span")), none).alias("_before"))
    starts = totals.withColumn("_here", F.coalesce(F.sum("_total").over(earlier(["_span"], "_bucket")), none)).join(spans, [*keys, "_span"])
    starts = starts.select(*keys, "_bucket", (F.col("_before") + F.col("_here")).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(position, *order).rowsBetween(Window.unboundedPreceding, 0)
    return b.join(starts, [*keys, "_bucket"]).withColumn(out, F.col("_start") + F.sum("_value").over(inside)).drop("_bucket", "_value", "_start")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of ``text``, which is not empty and whose code points are below U+0800."""
    octets = "CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END"
    bits = f"flatten(list_transform(flatten(list_transform(string_split({text}, ''), lambda ch: {octets})), lambda o: [CAST(o AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, o: xor(xor(c, o) >> 1, 3988292384 * (xor(c, o) & 1)), CAST(4294967295 AS BIGINT)), 4294967295)"
