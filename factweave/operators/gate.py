"""Policy gate: ``metric[>number]`` conditions, comma-separated, against one row of metrics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = {"conflicts": "conflicts", "outliers": "outliers", "drift": "max_drift", "credential-forms": "credential_forms"}
EXIT_OK, EXIT_ERROR, EXIT_USAGE, EXIT_GATE = 0, 1, 2, 3


class GateError(ValueError):
    """A policy that does not parse."""


@dataclass(frozen=True)
class Condition:
    metric: str
    threshold: float


def parse(spec: str) -> list[Condition]:
    """Conditions of a policy; count metrics default to 0, ``drift`` needs a threshold."""
    out = []
    for token in spec.split(","):
        name, mark, number = (x.strip(" \t") for x in token.partition(">"))
        if not name and not mark:
            raise GateError("empty condition")
        if name not in METRICS:
            raise GateError(f"unknown metric {name!r}")
        if not mark:
            if name == "drift":
                raise GateError("drift needs a threshold")
            out.append(Condition(name, 0.0))
            continue
        try:
            value = float(number)
        except ValueError:
            raise GateError(f"bad threshold {number!r}") from None
        if math.isnan(value) or value < 0:
            raise GateError(f"bad threshold {number!r}")
        out.append(Condition(name, value))
    return out


def metrics(conflicts: DataFrame, stats: DataFrame, forms: DataFrame) -> DataFrame:
    """One row ``conflicts, outliers, max_drift, credential_forms``; ``stats`` carries ``is_outlier``."""
    one = conflicts.agg(F.count("*").alias("conflicts"))
    one = one.crossJoin(F.broadcast(stats.agg(F.count_if("is_outlier").alias("outliers"), F.coalesce(F.max("drift"), F.lit(0.0)).alias("max_drift"))))
    return one.crossJoin(F.broadcast(forms.agg(F.count("*").alias("credential_forms"))))


def evaluate(row: DataFrame, conditions: list[Condition]) -> DataFrame:
    """``position, metric, threshold, observed, tripped`` per condition: tripped when observed exceeds it."""
    items = [F.struct(F.lit(i).alias("position"), F.lit(c.metric).alias("metric"), F.lit(float(c.threshold)).alias("threshold"), F.col(METRICS[c.metric]).cast("double").alias("observed")) for i, c in enumerate(conditions)]
    return row.select(F.explode(F.array(*items)).alias("c")).select("c.*", (F.col("c.observed") > F.col("c.threshold")).alias("tripped"))
