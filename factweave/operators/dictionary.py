"""Dense numbers for identities, so that joins and groups after the first carry longs instead of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.graph import materialize, release
from factweave.functions.order import global_rank


def dictionary(keys: DataFrame, written: bool = False) -> DataFrame:
    """``kind, canonical, identity`` for distinct ``kind, canonical``: ``identity`` counts from 0 in order of canonical, then
    kind, so it stands for both in any ordering too. Numbers are ranks over sampled ranges, not hashes: none can meet. Keys are
    read twice, so they are written first unless they are read from a written table (``written``)."""
    listed = keys.select("kind", "canonical") if written else materialize(keys.select("kind", "canonical"))
    out = materialize(global_rank(listed, [F.col("canonical"), F.col("kind")], "identity"))
    if not written:
        release(listed)
    return out


def encoded(members: DataFrame, names: DataFrame) -> DataFrame:
    """``artifact_id, identity`` of the membership in the identities of ``names``."""
    return members.join(names, ["kind", "canonical"]).select("artifact_id", "identity")
