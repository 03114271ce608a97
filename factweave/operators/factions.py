"""Factions: artifacts that deviate together.

Distinctive identities (minority bucket, at most ``PAIR_CAP`` holders) pair their holders; pairs whose
shared share of distinctive identities reaches ``THRESHOLD`` are edges; components of two or more are factions.
The cap is part of the definition that the registered queries and their SQL state. Without it (``cap=None``) every minority
identity counts, and ``class_edges`` finds the same edges between classes of artifacts with equal sets, without pairing all holders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.graph import components, materialize, release
from factweave.functions.order import global_rank
from factweave.operators.dictionary import dictionary

PAIR_CAP, THRESHOLD, SIGNATURE = 1024, 0.5, 8


def distinctive(ids: DataFrame, written: bool = False, cap: int | None = PAIR_CAP) -> DataFrame:
    """The distinctive identities, numbered: ``kind, canonical, identity``; ``written``: ``ids`` is a written table."""
    rare = ids.where("bucket = 'minority'")
    return dictionary(rare if cap is None else rare.where(F.col("k") <= cap), written)


def minority_pairs(rare: DataFrame) -> DataFrame:
    """``a, b, shared`` with a < b from ``artifact_id, identity``: holders of one identity (bounded by the cap) meet in a
    self-join whose two sides are one shuffle of longs; counts combine before the next."""
    pairs = rare.select("identity", F.col("artifact_id").alias("a")).join(rare.select("identity", F.col("artifact_id").alias("b")), "identity").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def similarity_edges(rare: DataFrame) -> DataFrame:
    """``a, b, similarity``: pairs at or above the threshold."""
    size = rare.groupBy("artifact_id").agg(F.count("*").alias("m"))
    j = minority_pairs(rare).join(size.toDF("a", "ma"), "a").join(size.toDF("b", "mb"), "b")
    sim = F.col("shared") / (F.col("ma") + F.col("mb") - F.col("shared"))
    return j.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= THRESHOLD)


def classes(rare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rep, n, m, ids`` (classes of artifacts with the same set of identities, named by the smallest; n artifacts, m sorted
    identities) and ``artifact_id, rep``. A set is no longer than its artifact. Both are written tables."""
    sets = materialize(rare.groupBy("artifact_id").agg(F.sort_array(F.collect_list("identity")).alias("ids")))
    groups = materialize(sets.groupBy("ids").agg(F.min("artifact_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", F.size("ids").cast("long").alias("m"), "ids"))
    named = materialize(sets.join(groups.select("ids", "rep"), "ids").select("artifact_id", "rep"))
    release(sets)
    return groups, named


def class_edges(groups: DataFrame) -> DataFrame:
    """``a, b, similarity, pairs``: the edges between all artifacts of two classes (a < b) or inside one (a = b), so many ``pairs``.

    Identities are ordered by the classes that hold them, rarest first. Two sets that reach the threshold have their first
    common identity in the first m - ceil(THRESHOLD m) + 1 of both, with enough of both sets behind it; classes that meet so are
    compared whole. The rule drops no edge."""
    held = groups.select("rep", "m", F.explode("ids").alias("identity"))
    ranked = held.join(held.groupBy("identity").agg(F.count("*").alias("k")).where("k > 1"), "identity")
    # Identities of one class are the rarest and come first: those left have places after them.
    alone = F.col("m") - F.count("*").over(Window.partitionBy("rep"))
    place = alone + F.row_number().over(Window.partitionBy("rep").orderBy("k", "identity"))
    first = ranked.select("rep", "m", "identity", place.alias("i")).where(F.col("i") <= F.col("m") - F.ceil(F.col("m") * THRESHOLD) + 1)
    prefix = materialize(first.select("identity", "rep", "m", (F.col("m") - F.col("i") + 1).alias("rest")))
    most = F.least("x.rest", "y.rest")
    near = prefix.alias("x").join(prefix.alias("y"), "identity").where(F.col("x.rep") < F.col("y.rep")).where(most * (1 + THRESHOLD) >= (F.col("x.m") + F.col("y.m")) * THRESHOLD)
    met = near.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    both = met.join(groups.toDF("a", "na", "ma", "ids_a"), "a").join(groups.toDF("b", "nb", "mb", "ids_b"), "b")
    shared = F.size(F.array_intersect("ids_a", "ids_b"))
    sim = both.withColumn("shared", shared).select("a", "b", (F.col("shared") / (F.col("ma") + F.col("mb") - F.col("shared"))).alias("similarity"), (F.col("na") * F.col("nb")).alias("pairs"))
    inside = groups.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"), F.expr("n * (n - 1) div 2").alias("pairs"))
    edges = materialize(sim.where(F.col("similarity") >= THRESHOLD).union(inside))
    release(prefix)
    return edges


def class_members(edges: DataFrame, named: DataFrame) -> DataFrame:
    """``artifact_id, root`` from edges between classes and the class of each artifact."""
    roots = components(edges.where("a <> b"))
    whole = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    best = roots.union(whole).groupBy("id").agg(F.min("component").alias("root"))
    return named.join(best, named["rep"] == best["id"]).select("artifact_id", "root")


def faction_members(edges: DataFrame) -> DataFrame:
    """``artifact_id, root``: every artifact of a component with at least two members."""
    return components(edges).select(F.col("id").alias("artifact_id"), F.col("component").alias("root"))


def faction_signature(labels: DataFrame, rare: DataFrame, names: DataFrame, top: int = SIGNATURE) -> DataFrame:
    """Per faction the distinctive identities most of its members share: ``root, rank, kind, canonical, present``. Only
    the identities shown are named."""
    held = rare.join(labels, "artifact_id").groupBy("root", "identity").agg(F.count("*").alias("present")).where("present >= 2")
    order = Window.partitionBy("root").orderBy(F.desc("present"), "identity")
    shown = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return shown.join(names, "identity").select("root", "rank", "kind", "canonical", "present")


def faction_cohesion(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``root, size, cohesion``: members and mean similarity of the edges inside (edges between classes count by their ``pairs``)."""
    size = labels.groupBy("root").agg(F.count("*").alias("size"))
    mean = F.sum(F.col("similarity") * F.col("pairs")) / F.sum("pairs") if "pairs" in edges.columns else F.avg("similarity")
    mean = edges.join(labels.withColumnRenamed("artifact_id", "a"), "a").groupBy("root").agg(mean.alias("cohesion"))
    return size.join(mean, "root", "left").na.fill(0.0, ["cohesion"])


def faction_table(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``faction_id, root, size, cohesion``; factions are numbered by size, then first member."""
    table = global_rank(faction_cohesion(labels, edges), [F.desc("size"), F.col("root")], "faction_id").withColumn("faction_id", F.col("faction_id").cast("int"))
    return table.select("faction_id", "root", "size", "cohesion")
