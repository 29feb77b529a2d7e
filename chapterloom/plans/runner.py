"""A driver-side runner of stages: each is one Spark job, in a fixed order that only goes forward, with a run log to resume from.

The log is append-only; the state of a run is its latest row (`max_by`), so a lost driver loses no finished stage.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("preprocess-glossary", "preprocess-summaries", "preprocess-idioms", "preprocess-graph", "packets-build", "translate-range", "epub-rebuild")
#: Stages that can follow any other.
ASIDE = ("translate-chapter", "reset")
LOG = "run_id string, stage string, status string, message string, at_us long"


def legal(current: str | None, target: str) -> bool:
    """Whether a stage may follow another: forward or again; stages on the side always may."""
    if current is None or current == target:
        return True
    if current not in ORDER:
        return False
    return target in ASIDE or target in ORDER and ORDER.index(target) >= ORDER.index(current)


def following(current: str | None) -> str | None:
    if current is None:
        return ORDER[0]
    return dict(zip(ORDER, ORDER[1:], strict=False)).get(current)


def note(spark: SparkSession, log: str, run: str, stage: str, status: str, message: str = "") -> None:
    spark.createDataFrame([(run, stage, status, message, time.time_ns() // 1000)], LOG).coalesce(1).write.mode("append").parquet(log)


def states(spark: SparkSession, log: str) -> DataFrame:
    """The latest status of every run and stage."""
    latest = F.max_by(F.struct("status", "message", "at_us"), F.col("at_us")).alias("s")
    return spark.read.schema(LOG).parquet(log).groupBy("run_id", "stage").agg(latest).select("run_id", "stage", "s.*")


def run(spark: SparkSession, log: str, run_id: str, stages: dict[str, Callable[[], None]], stop: Callable[[], bool] = lambda: False) -> list[str]:
    """Run what is left of `stages` in order: finished ones are skipped, the first failure or a wish to stop ends the run.
    Returns the stages that completed this time."""
    try:
        done = {r.stage for r in states(spark, log).where((F.col("run_id") == run_id) & (F.col("status") == "completed")).collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    completed, current = [], None
    for stage, work in stages.items():
        if not legal(current, stage):
            note(spark, log, run_id, stage, "transition_denied", f"after {current}")
            break
        current = stage
        if stage in done:
            continue
        if stop():
            note(spark, log, run_id, stage, "stopped")
            break
        note(spark, log, run_id, stage, "started")
        try:
            work()
        except Exception as e:
            note(spark, log, run_id, stage, "failed", str(e)[:500])
            break
        note(spark, log, run_id, stage, "completed")
        completed.append(stage)
    return completed
