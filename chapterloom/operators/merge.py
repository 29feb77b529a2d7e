"""Upserts on plain tables: tag sides, union, and one grouped aggregate with a rule for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str], arrival: list[str] | None = None) -> DataFrame:
    """Rows of both by key. Rules: min, max, sum; incoming (the last arrival), existing (the first), coalesce_existing
    (the first that is not null). `arrival` orders rows of a side; without it a side has one row a key."""
    order = F.struct("side", *(arrival or []))
    both = existing.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)), allowMissingColumns=True)

    def one(name: str, rule: str) -> Column:
        c = F.col(name)
        found = {"min": F.min(c), "max": F.max(c), "sum": F.sum(c), "incoming": F.max_by(c, order), "existing": F.min_by(c, order), "coalesce_existing": F.min_by(c, F.when(c.isNotNull(), order))}
        return found[rule].alias(name)

    return both.groupBy(*keys).agg(*(one(n, r) for n, r in rules.items()))


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()
