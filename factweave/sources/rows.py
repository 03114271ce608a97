"""Rows of tables as artifacts: native extractors and table-to-fact adapters.

Facts have the fixed schema ``artifact_id, ord, kind, canonical, line``; keys are never pivoted into
columns. Everything here is Catalyst-only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTS = "artifact_id long, ord int, kind string, canonical string, line int"
_BLANK = " \t\r"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("artifact_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("at", "raw"))
    return rows.select("artifact_id", (F.col("at") + 1).alias("line"), trimmed(F.col("raw")).alias("t")).where("t <> ''")


def text_facts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One ``line`` fact per line that is not blank."""
    return _lines(df, id_col, text_col).select("artifact_id", F.col("line").alias("ord"), F.lit("line").alias("kind"), F.col("t").alias("canonical"), "line")


def markdown_facts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``heading`` facts ``h1:...`` to ``h6:...``; other lines as ``line``."""
    hashes, rest = F.regexp_extract("t", r"(?s)^(#{1,6})([^#].*)$", 1), trimmed(F.regexp_extract("t", r"(?s)^(#{1,6})([^#].*)$", 2))
    is_heading = rest != ""
    return _lines(df, id_col, text_col).select(
        "artifact_id",
        F.col("line").alias("ord"),
        F.when(is_heading, "heading").otherwise("line").alias("kind"),
        F.when(is_heading, F.concat(F.lit("h"), F.length(hashes).cast("string"), F.lit(":"), rest)).otherwise(F.col("t")).alias("canonical"),
        "line",
    )


def config_facts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """INI, env and properties text: ``section.key=value``. The section of a line is the last header
    above it in its artifact, carried forward by a window."""
    t = F.col("t")
    rows = _lines(df, id_col, text_col).where(~t.startswith("#") & ~t.startswith(";"))
    is_section = t.startswith("[") & t.endswith("]") & (F.length(t) >= 2)
    section = F.when(is_section, F.regexp_replace(F.expr("substring(t, 2, length(t) - 2)"), r"^[ \t]+|[ \t]+$", ""))
    above = Window.partitionBy("artifact_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("is_section", is_section).withColumn("section", F.last(section, ignorenulls=True).over(above)).where("not is_section")
    has_pair = t.rlike("[=:]")
    key = trimmed(F.regexp_extract("t", r"(?s)^([^=:]*)[=:]", 1))
    key = F.when(key.startswith("export "), trimmed(F.substr(key, F.lit(8)))).otherwise(key)
    value = F.regexp_replace(F.regexp_extract("t", r"(?s)^[^=:]*[=:](.*)$", 1), "^[ \t\"']+|[ \t\"']+$", "")
    path = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat("section", F.lit("."), key)).otherwise(key)
    rows = rows.where(~has_pair | (key != ""))
    return rows.select("artifact_id", F.col("line").alias("ord"), F.when(has_pair, "kv").otherwise("line").alias("kind"), F.when(has_pair, F.concat(path, F.lit("="), value)).otherwise(t).alias("canonical"), "line")


def table_facts(df: DataFrame, id_col: str, keys: dict[str, Column | str]) -> DataFrame:
    """Each row adds ``key=value`` facts to the artifact named by ``id_col``; a key ending in ``[]`` is a bag.
    Null values give no fact."""
    pairs = [F.struct(F.lit(k).alias("k"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("v")) for k, c in keys.items()]
    rows = df.select(F.col(id_col).alias("artifact_id"), F.posexplode(F.array(*pairs)).alias("ord", "p")).where("p.v is not null")
    return rows.select("artifact_id", "ord", F.lit("kv").alias("kind"), F.concat("p.k", F.lit("="), "p.v").alias("canonical"), F.lit(0).alias("line"))


def table_artifacts(df: DataFrame, id_col: str, path: Column | None = None, kind: str = "text") -> DataFrame:
    """``artifact_id, path, kind, size`` with one row per distinct id."""
    ids = df.select(F.col(id_col).alias("artifact_id"), (path if path is not None else F.col(id_col).cast("string")).alias("path"))
    return ids.groupBy("artifact_id").agg(F.min("path").alias("path")).select("artifact_id", "path", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("size"))


def keys_only(facts: DataFrame) -> DataFrame:
    """Values removed: ``kv`` keeps its key, a ``line`` becomes ``line#`` and a digest, others stay."""
    from factweave.functions.blake3 import hex_digest

    mark = hex_digest(6)(F.when(F.col("kind") == "line", F.col("canonical")))  # nothing else is digested, and facts are read once
    bare = F.when(F.col("kind") == "kv", F.substring_index("canonical", "=", 1)).when(F.col("kind") == "line", F.concat(F.lit("line#"), mark))
    return facts.withColumn("canonical", bare.otherwise(F.col("canonical")))
