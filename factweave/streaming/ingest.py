"""Facts from an unbounded stream of artifacts.

Extraction is stateless, so it runs as is on a streaming DataFrame. Membership is merged batch by batch into
a table keyed by artifact and identity; consensus is recomputed from that table, because every new artifact
changes N and with it any bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.operators.consensus import membership
from factweave.plans.corpus import Corpus


def ingest(stream: DataFrame, extract, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``extract`` (artifacts -> facts) over ``stream`` (with ``artifact_id, path, kind, size``) and append
    each batch's artifacts and membership under ``folder``, in a directory per batch: a batch replayed after a
    failure overwrites its own directory, so results are exactly-once."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.select("artifact_id", "path", "kind", "size").write.mode("overwrite").parquet(f"{folder}/artifacts/batch={batch_id}")
        membership(extract(batch)).write.mode("overwrite").parquet(f"{folder}/members/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def corpus_of(spark: SparkSession, folder: str) -> Corpus:
    """The corpus ingested so far."""
    artifacts = spark.read.parquet(f"{folder}/artifacts").drop("batch").dropDuplicates(["artifact_id"])
    members = spark.read.parquet(f"{folder}/members").drop("batch")
    facts = members.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("artifact_id", "ord", "kind", "canonical", F.lit(0).alias("line"))
    return Corpus(artifacts, facts)
