"""Event operators on streams: watermarked windows and dedupe, sessions, sampling and status with custom state.

Each takes a streaming (or batch) DataFrame of tracking events with a timestamp `at` and returns one. `replay` runs a
stream to its end over a folder of Parquet files and returns what it wrote, so batch checks apply to streams.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.levels import is_critical, is_progress

LATE = "1 hour"


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.timestamp_micros("event_us"))


def windows(events: DataFrame, length: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and severity; late events count until the watermark passes."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    out = events.withWatermark("at", LATE).groupBy(w.alias("w"), "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("score"))
    return out.select(F.unix_micros("w.start").alias("window_us"), "severity", "n", "score")


def deduped(events: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Repeats within the watermark dropped; state is bounded by it."""
    return events.withWatermark("at", LATE).dropDuplicatesWithinWatermark(list(keys)).select("event_id", "event_us", "run_id", "event_type")


def sessions(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    out = events.withWatermark("at", LATE).groupBy(F.session_window("at", gap).alias("s"), "run_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("run_id", F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "n")


def sampled(events: DataFrame, every: int = 25) -> DataFrame:
    """Critical events as they are, of progress events of a run and type the first and every `every`-th, by counters in state."""
    progress = is_progress(F.col("event_type")) & ~is_critical(F.col("event_type"), F.col("severity"))

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(["event_us", "event_id"])
            n = seen + 1 + pd.RangeIndex(len(frame))
            seen += len(frame)
            yield frame[(n == 1) | (n % every == 0)][["event_id", "run_id", "event_type"]]
        state.update((seen,))

    kept = events.where(progress).groupBy("run_id", "event_type").applyInPandasWithState(keep, "event_id long, run_id string, event_type string", "seen long", "append", GroupStateTimeout.NoTimeout)
    return kept.unionByName(events.where(~progress).select("event_id", "run_id", "event_type"))


def enriched(events: DataFrame, authority: DataFrame) -> DataFrame:
    """Stream-static join with a table of stages."""
    return events.join(authority, "stage_name", "left").select("event_id", "stage_name", "position")


def replay(spark: SparkSession, source: str, schema, plan: Callable[[DataFrame], DataFrame], mode: str = "append", files: int = 1) -> DataFrame:
    """Run `plan` over a folder (or file) of Parquet as a stream until all of it is read; what it wrote.

    In append mode only what the watermark has passed is written, so windows at the end stay open, as on any stream.
    """
    base = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="stream-")).rstrip("/") + f"/replay-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    out = plan(stream)
    if mode == "append":
        out.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    else:
        def save(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(base + "/out")

        out.writeStream.foreachBatch(save).option("checkpointLocation", base + "/state").trigger(availableNow=True).outputMode(mode).start().awaitTermination()
    return spark.read.parquet(base + "/out")
