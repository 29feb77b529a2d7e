"""Name -> (plan, oracle SQL) for every query of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import events, glossary, graph, ingest, narrative, packets

FLAGSHIP = "chapter_packet_overview"
MODULES = (events, glossary, narrative, graph, packets, ingest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for m in MODULES for name, (plan, _) in m.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.PLANS.items() if sql}
