"""Consensus kept up to date batch by batch.

What a batch adds is small and can be summed: per identity how many artifacts newly hold it, how often it occurs and
its first holder; per artifact and identity a membership row that says whether the pair is new. Each batch writes these
as folders of its own; nothing that is already there is read again but the ids of known artifacts and, for
artifacts that come again, their membership. ``N``, the buckets, the core and the drift depend on the whole corpus and
are applied when the state is read. Every ``COMPACT`` batches the identity sums so far are merged into one table.

A batch that is replayed overwrites its folders and is computed against the batches before it, so results are
exactly-once. An artifact that comes again adds its facts to those it has; a pair that it already holds is not counted as another holder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.functions.graph import materialize, release, small
from factweave.operators.consensus import artifact_stats, bucket, membership, with_outliers

COMPACT = 16
#: So many artifacts that come again are sent to the membership before it is dealt.
FEW = 200_000
_ARTIFACTS = "artifact_id long, path string, kind string, size long"
_MEMBERS = "artifact_id long, kind string, canonical string, n long, ord int, fresh boolean"
_IDENTITIES = "kind string, canonical string, k long, occurrences long, first struct<holder: long, holder_ord: int>"


class IncrementalConsensus:
    """State below ``folder``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, compact: int = COMPACT):
        self.spark, self.folder, self.compact = spark, folder.rstrip("/"), compact

    def _done(self, table: str) -> list[int]:
        """Numbers of the folders of ``table`` that were written to their end."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName().partition("=")[2]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, table: str, schema: str, below: int | None) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={b}" for b in self._done("identities") if below is None or b < below]  # written last
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _sums(self, below: int | None = None) -> DataFrame:
        """Identity sums of all batches before ``below``: the last merged table and the batches after it."""
        merged = [b for b in self._done("merged") if below is None or b < below]
        paths = [f"{self.folder}/merged/upto={merged[-1]}"] if merged else []
        paths += [f"{self.folder}/identities/batch={b}" for b in self._done("identities") if (not merged or b > merged[-1]) and (below is None or b < below)]
        parts = self.spark.read.schema(_IDENTITIES).parquet(*paths) if paths else self.spark.createDataFrame([], _IDENTITIES)
        return parts.groupBy("kind", "canonical").agg(F.sum("k").alias("k"), F.sum("occurrences").alias("occurrences"), F.min("first").alias("first"))

    def update(self, batch_id: int, artifacts: DataFrame, facts: DataFrame) -> None:
        """Add a batch: ``artifacts`` (``artifact_id, path, kind, size``) and their ``facts``."""
        put = lambda df, table, name=f"batch={batch_id}": df.write.mode("overwrite").parquet(f"{self.folder}/{table}/{name}")
        seen = materialize(artifacts.select("artifact_id", "path", "kind", "size").dropDuplicates(["artifact_id"]))
        pairs = membership(facts).withColumn("fresh", F.lit(True))
        known = self._read("artifacts", _ARTIFACTS, batch_id).select("artifact_id")
        again = materialize(known.join(small(seen.select("artifact_id")), "artifact_id", "left_semi"))
        put(seen.join(small(again), "artifact_id", "left_anti"), "artifacts")
        n = again.count()
        if n:
            held = self._read("members", _MEMBERS, batch_id).where("fresh")
            if n <= FEW:  # of more, the membership is dealt once, for the pairs
                held = held.join(F.broadcast(again), "artifact_id", "left_semi")
            held = held.select("artifact_id", "kind", "canonical", F.lit(True).alias("held"))
            pairs = pairs.join(held, ["artifact_id", "kind", "canonical"], "left").withColumn("fresh", F.col("held").isNull())
        put(pairs.select(*(c.split()[0] for c in _MEMBERS.split(", "))), "members")
        pairs = self.spark.read.schema(_MEMBERS).parquet(f"{self.folder}/members/batch={batch_id}")
        first = F.min(F.struct(F.col("artifact_id").alias("holder"), F.col("ord").alias("holder_ord"))).alias("first")
        put(pairs.groupBy("kind", "canonical").agg(F.count_if("fresh").alias("k"), F.sum("n").alias("occurrences"), first), "identities")
        release(seen, again)
        merged = [b for b in self._done("merged") if b < batch_id]
        if len([b for b in self._done("identities") if b <= batch_id and (not merged or b > merged[-1])]) >= self.compact:
            put(self._sums(batch_id + 1), "merged", f"upto={batch_id}")

    def ingest(self, stream: DataFrame, extract: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Run ``extract`` (artifacts to facts) over each batch of ``stream`` and add it."""
        writer = stream.writeStream.foreachBatch(lambda batch, batch_id: self.update(batch_id, batch, extract(batch))).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    @property
    def artifacts(self) -> DataFrame:
        return self._read("artifacts", _ARTIFACTS, None)

    @property
    def members(self) -> DataFrame:
        """Distinct ``artifact_id, kind, canonical``, with the order of the first batch that had the pair."""
        return self._read("members", _MEMBERS, None).where("fresh").drop("fresh", "n")

    @property
    def identities(self) -> DataFrame:
        """The columns of ``consensus.identities``."""
        n, k = F.col("N"), F.col("k")
        ids = self._sums().crossJoin(F.broadcast(self.artifacts.agg(F.count("*").alias("N"))))
        return ids.select("kind", "canonical", "k", "occurrences", "first.holder", "first.holder_ord", bucket(k, n).alias("bucket"), (2 * k > n).alias("is_core"), ((k == 1) & (n > 1)).alias("is_unique"))

    @property
    def stats(self) -> DataFrame:
        """The columns of ``Corpus.stats``; the membership meets the core, which is small, and is not shuffled by identity."""
        return with_outliers(artifact_stats(self.artifacts, self.members, self.identities))


def in_batches(state: IncrementalConsensus, artifacts: DataFrame, facts: DataFrame, batches: int) -> IncrementalConsensus:
    """Feed a corpus in ``batches`` parts by a hash of the fact, so that most artifacts come again in every part. The facts
    are extracted once and each part is read by itself."""
    part = F.pmod(F.xxhash64("artifact_id", "ord", "canonical"), F.lit(batches)).cast("int")
    fed = materialize(facts.withColumn("_part", part), by="_part")
    for b in range(batches):
        some = fed.where(F.col("_part") == b).drop("_part")
        here = artifacts if b == 0 else artifacts.join(some.select("artifact_id").distinct(), "artifact_id", "left_semi")
        state.update(b, here, some)
    release(fed)
    return state
