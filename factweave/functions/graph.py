"""Cut lineage in the shared folder, and connected components without neighbour lists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for cut lineage. Without one, a local session takes its own temp folder; on a
    cluster, where executors would write to their own disks, this is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return str(named or f"{tempfile.gettempdir()}/factweave-checkpoints").rstrip("/")


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, so a lost executor costs
    a re-read, and several consumers share one computation. The shuffle files behind it go at once. Filters on the column ``by`` read their folders only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of ``materialize`` results that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` (a materialized table of a few narrow columns) marked for broadcast if it has at most ``rows`` rows;
    beyond that it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _all_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and no ``v`` is a ``u``: then each ``v`` names a component."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("role")), F.struct(F.col("v").alias("id"), F.lit(2).alias("role")))).alias("x"))
    mixed = roles.groupBy("x.id").agg(F.bit_or("x.role").alias("roles"), F.count_if(F.col("x.role") == 1).alias("n")).where("roles = 3 or n > 1")
    return mixed.isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of every id in ``edges``: component is the smallest id reachable.

    Alternating large-star and small-star passes: each pass is one ``min`` per node and one equi-join,
    neighbour lists are never collected, and the edge list never grows. Each round is written to the
    shared folder and the former one deleted."""
    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        if _all_stars(cur):
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.where("m < u").select("u", F.col("m").alias("v"))
        ).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(small)
        release(cur)
        cur = nxt
    else:
        raise RuntimeError("connected components did not converge")
    roots = cur.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
