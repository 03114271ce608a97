"""Discriminative signatures: facts held by all members of a faction and by nobody else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.order import global_rank

#: Fact prefix -> column of a kit signature.
KIT_LISTS = {"field": "fields", "formfields": "field_sets", "formaction": "actions", "resource": "resources", "path": "paths", "title": "brand", "heading": "brand", "meta": "brand"}
#: Fact prefix -> atom kind, in rank order; chunks come last.
ATOMS = {"imports": "import", "needs": "needs", "exports": "export", "strings": "string", "sections": "section"}
ATOM_CAP = 24


def exclusive_facts(members: DataFrame, ids: DataFrame, labels: DataFrame) -> DataFrame:
    """``root, kind, canonical``: the identity's holders are exactly the faction's members. Holder sets are
    compared by size and single label, so no set is gathered."""
    size = labels.groupBy("root").agg(F.count("*").alias("size"))
    held = members.join(labels, "artifact_id").groupBy("root", "kind", "canonical").agg(F.count("*").alias("inside"))
    return held.join(size, "root").where("inside = size").join(ids.select("kind", "canonical", "k"), ["kind", "canonical"]).where("k = size").select("root", "kind", "canonical")


def kit_signatures(exclusive: DataFrame, factions: DataFrame) -> DataFrame:
    """One row per faction with page features: six sorted lists, ``shape_count``, ``functional``, ``rank``."""
    prefix = F.substring_index("canonical", "[]=", 1)
    value = F.expr("substring(canonical, instr(canonical, '[]=') + 3)")
    rows = exclusive.where("kind = 'kv' and canonical like '%[]=%'").select("root", prefix.alias("p"), value.alias("v"))
    lists = dict.fromkeys(KIT_LISTS.values())
    aggs = [F.sort_array(F.collect_set(F.when(F.col("p").isin(*[p for p, c in KIT_LISTS.items() if c == name]), F.col("v")))).alias(name) for name in lists]
    kits = rows.groupBy("root").agg(*aggs, F.count_if(F.col("p") == "shape").alias("shape_count"))
    filled = sum((F.size(c) for c in lists), F.col("shape_count"))
    functional = F.size("fields") + F.size("field_sets") + F.size("actions") + F.size("resources") > 0
    kits = kits.where(filled > 0).join(factions, "root").withColumn("functional", functional)
    return global_rank(kits, [F.desc("functional"), F.desc("size"), F.col("faction_id")], "rank").withColumn("rank", F.col("rank").cast("int"))


def yara_atoms(exclusive: DataFrame, factions: DataFrame, cap: int = ATOM_CAP) -> DataFrame:
    """``faction_id, rank, atom, text``: the best exclusive binary features of each faction."""
    prefix = F.substring_index("canonical", "[]=", 1)
    which = F.when(F.col("kind") == "chunk", len(ATOMS))
    for i, p in enumerate(ATOMS):
        which = which.when((F.col("kind") == "kv") & F.col("canonical").contains("[]=") & (prefix == p), i)
    names = F.array(*[F.lit(a) for a in (*ATOMS.values(), "chunk")])
    text = F.when(F.col("kind") == "chunk", F.col("canonical")).otherwise(F.expr("substring(canonical, instr(canonical, '[]=') + 3)"))
    rows = exclusive.select("root", which.alias("w"), text.alias("text")).where("w is not null").join(factions.select("root", "faction_id"), "root")
    order = Window.partitionBy("faction_id").orderBy("w", "text")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("faction_id", "rank", F.get(names, F.col("w")).alias("atom"), "text")
