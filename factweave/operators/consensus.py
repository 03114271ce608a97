"""Consensus, drift and outliers over the artifact x identity incidence relation.

``artifacts`` has one row per member (also those without facts: they count in N), ``facts`` the extracted
primitives. Grouping uses the logical key ``(kind, canonical)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.graph import materialize, small

#: An outlier needs this many artifacts, this much spread, and a drift this many deviations above the mean.
MIN_ARTIFACTS, MIN_SPREAD, DEVIATIONS = 4, 0.005, 1.5
BUCKETS = ("universal", "majority", "minority", "unique")


def membership(facts: DataFrame) -> DataFrame:
    """Distinct ``artifact_id, kind, canonical`` with ``n`` occurrences and the first ``ord``."""
    return facts.groupBy("artifact_id", "kind", "canonical").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))


def corpus_size(artifacts: DataFrame) -> DataFrame:
    """One row ``N``: members counted from the artifacts, never from the facts."""
    return artifacts.agg(F.count("*").alias("N"))


def bucket(k: Column, n: Column) -> Column:
    """Universal, unique, majority or minority, tested in that order."""
    return F.when(k == n, "universal").when(k == 1, "unique").when(2 * k > n, "majority").otherwise("minority")


def identities(artifacts: DataFrame, facts: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``kind, canonical, k, occurrences, holder, bucket, is_core, is_unique``; ``holder`` is the first artifact.

    Partial aggregation twice, so an identity held by every artifact is one row per task."""
    m = membership(facts) if members is None else members
    ids = m.groupBy("kind", "canonical").agg(F.count("*").alias("k"), F.sum("n").alias("occurrences"), F.min("artifact_id").alias("holder"), F.min_by("ord", "artifact_id").alias("holder_ord"))
    ids = ids.crossJoin(F.broadcast(corpus_size(artifacts)))
    k, n = F.col("k"), F.col("N")
    return ids.select("kind", "canonical", "k", "occurrences", "holder", "holder_ord", bucket(k, n).alias("bucket"), (2 * k > n).alias("is_core"), ((k == 1) & (n > 1)).alias("is_unique"))


def bucket_counts(ids: DataFrame) -> DataFrame:
    """All four buckets with their number of identities, zeros included."""
    labels = ids.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return labels.join(ids.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").na.fill(0, ["n"])


def bucket_rollup(ids: DataFrame) -> DataFrame:
    """``kind, bucket, identities, holders, occurrences`` per kind and bucket, per kind, per bucket and over all (null where
    summed over): one pass over the identities."""
    sets = [[F.col("kind"), F.col("bucket")], [F.col("kind")], [F.col("bucket")], []]
    return ids.groupingSets(sets, F.col("kind"), F.col("bucket")).agg(F.count("*").alias("identities"), F.sum("k").alias("holders"), F.sum("occurrences").alias("occurrences"))


def occurrences(facts: DataFrame) -> DataFrame:
    """Every occurrence as a row ``kind, canonical, artifact_id, ord, line``, one identity's together and in feed order:
    a range sort, so the index of a fact that every artifact holds is spread over as many tasks as it needs."""
    return facts.select("kind", "canonical", "artifact_id", "ord", "line").orderBy("kind", "canonical", "artifact_id", "ord")


def occurrence_index(facts: DataFrame, shown: int) -> DataFrame:
    """``kind, canonical, total, occurrences``: per identity the number of its occurrences and the first ``shown`` of
    them, ``(artifact_id, line)`` in feed order. Both pre-aggregate per task, a row limit within the window's sort."""
    total = facts.groupBy("kind", "canonical").agg(F.count("*").alias("total"))
    feed = Window.partitionBy("kind", "canonical").orderBy("artifact_id", "ord")
    few = facts.select("kind", "canonical", "artifact_id", "ord", "line").withColumn("at", F.row_number().over(feed)).where(F.col("at") <= shown)
    lists = few.groupBy("kind", "canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("artifact_id", "ord", "line"))), lambda x: F.struct(x["artifact_id"].alias("artifact_id"), x["line"].alias("line"))).alias("occurrences"))
    return total.join(lists, ["kind", "canonical"])


def artifact_stats(artifacts: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """``artifact_id, path, total, in_core, n_unique, drift`` of every artifact.

    The core (keys of a strict majority) is at most twice the mean artifact's size, whatever the corpus: it is written
    first and, up to a checked size, sent to the membership, which is then not shuffled by identity at all; unique
    facts are counted from their one holder, without touching the membership again."""
    core = small(materialize(ids.where("is_core").select("kind", "canonical", F.lit(1).alias("hit"))))
    n_core = F.lit(core.count())
    per = members.join(core, ["kind", "canonical"], "left").groupBy("artifact_id").agg(F.count("*").alias("total"), F.count("hit").alias("in_core"))
    unique = ids.where("is_unique").groupBy(F.col("holder").alias("artifact_id")).agg(F.count("*").alias("n_unique"))
    all_ = artifacts.join(per, "artifact_id", "left").join(unique, "artifact_id", "left").na.fill(0, ["total", "in_core", "n_unique"])
    union = F.col("total") + n_core - F.col("in_core")
    drift = F.when(union == 0, F.lit(0.0)).otherwise(1 - F.col("in_core") / union)
    return all_.select("artifact_id", "path", "total", "in_core", "n_unique", drift.alias("drift"))


def with_outliers(stats: DataFrame) -> DataFrame:
    """Adds ``is_outlier``: drift beyond mean and spread of the whole corpus."""
    s = stats.agg(F.count("*").alias("n"), F.avg("drift").alias("mean"), F.stddev_pop("drift").alias("sd"))
    flag = (F.col("n") >= MIN_ARTIFACTS) & (F.col("sd") > MIN_SPREAD) & (F.col("drift") > F.col("mean") + DEVIATIONS * F.col("sd"))
    return stats.crossJoin(F.broadcast(s)).select(*stats.columns, flag.alias("is_outlier"))


def corpus_summary(artifacts: DataFrame, facts: DataFrame, ids: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: artifacts, observations, identities, core size, mean and spread of drift."""
    one = corpus_size(artifacts).select(F.col("N").alias("artifacts"))
    parts = [
        facts.agg(F.count("*").alias("observations")),
        ids.agg(F.count("*").alias("identities"), F.count_if("is_core").alias("core")),
        stats.agg(F.coalesce(F.avg("drift"), F.lit(0.0)).alias("mean_drift"), F.coalesce(F.stddev_pop("drift"), F.lit(0.0)).alias("sd_drift")),
    ]
    for p in parts:
        one = one.crossJoin(F.broadcast(p))
    return one


def drift_ranking(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """Artifacts by falling drift, then id; with ``limit`` a top-k, else a range-partitioned global sort."""
    ranked = stats.orderBy(F.desc("drift"), "artifact_id")
    return ranked.limit(limit) if limit is not None else ranked


def unique_evidence(stats: DataFrame, ids: DataFrame, artifacts_shown: int = 3, facts_shown: int = 5) -> DataFrame:
    """For the most drifted artifacts (outliers only, if there are any) their first unique facts."""
    flagged = with_outliers(stats)
    some = flagged.agg(F.max("is_outlier").alias("some"))
    top = flagged.crossJoin(F.broadcast(some)).where("is_outlier or not some").where("n_unique > 0").orderBy(F.desc("drift"), "artifact_id").limit(artifacts_shown)
    own = ids.where("is_unique").join(F.broadcast(top.select(F.col("artifact_id").alias("holder"), "drift")), "holder")
    rank = Window.partitionBy("holder").orderBy("canonical", "kind")
    return own.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= facts_shown).select(F.col("holder").alias("artifact_id"), "drift", "rank", "kind", "canonical")


def missing_core(artifact_id: int, members: DataFrame, ids: DataFrame, limit: int | None = 25) -> DataFrame:
    """Core facts that one artifact lacks."""
    held = members.where(F.col("artifact_id") == artifact_id).select("kind", "canonical")
    out = ids.where("is_core").join(held, ["kind", "canonical"], "left_anti").orderBy("canonical", "kind").select("kind", "canonical", "k")
    return out.limit(limit) if limit is not None else out
