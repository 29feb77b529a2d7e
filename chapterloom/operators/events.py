"""Event-stream analytics over tracking events (see plans.adapters for the schema). Every function is DataFrame to DataFrame.

Latest-per-key operators use max_by, an aggregate that combines map-side, instead of a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import default_message, elapsed, event_level, is_critical, is_progress

AT = F.struct


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _ends(suffix: str) -> Column:
    return F.col("event_type").endswith(suffix)


def _order() -> Column:
    return F.struct("event_us", "event_id")


def signal_text() -> Column:
    return F.lower(F.concat_ws(" ", "event_type", F.coalesce("message", F.lit(""))))


def with_message(events: DataFrame) -> DataFrame:
    total = F.when(F.col("k") % 2 == 0, F.col("k"))
    return events.withColumn("message", default_message(F.col("event_type"), F.col("chapter_number"), F.col("block_id"), total))


def stage_summary(events: DataFrame, completed: str = ".completed", failed: str = ".failed", errors: str = ".validation_failed") -> DataFrame:
    """Per stage the events of three kinds; a stage without any has no row."""
    kept = events.where(_ends(completed) | _ends(failed) | _ends(errors))
    return kept.groupBy("stage_name").agg(_count(_ends(completed), "completed"), _count(_ends(failed), "failed"), _count(_ends(errors), "errors"))


def metric_totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        _count(F.col("severity") == "warning", "warnings"),
        _count(F.col("severity") == "error", "errors"),
        F.countDistinct(F.when(F.col("event_type").startswith("preprocess-"), F.col("stage_name"))).alias("stages"),
    )


def observability_counters(events: DataFrame) -> DataFrame:
    text, kind = signal_text(), F.lower("event_type")
    return with_message(events).groupBy("run_id").agg(
        _count((F.col("severity") == "warning") | kind.isin("validation_failed", "risk_detected") | kind.endswith(".validation_failed"), "warnings"),
        _count((F.col("severity") == "error") | text.contains("fail"), "failures"),
        _count(kind.endswith("_skipped"), "skips"),
        _count(kind.endswith("_retry") | kind.endswith(".retry") | text.contains("retry"), "retries"),
        _count((kind == "artifact_written") | kind.endswith(".artifact_written"), "artifacts"),
    )


def quick_stats(events: DataFrame) -> DataFrame:
    done = F.when(_ends(".completed"), _order())
    return events.groupBy("run_id").agg(
        _count(_ends(".term_found"), "terms"),
        F.max_by(F.when(_ends(".completed"), F.col("k")), done).cast("long").alias("promoted"),
        _count(_ends(".entity_extracted"), "entities"),
        _count(F.lower("event_type").contains("retry"), "retries"),
        F.round(F.avg(F.when(F.lower("event_type").contains("risk_detected"), F.col("score"))), 4).alias("avg_risk"),
    )


def block_progress(events: DataFrame) -> DataFrame:
    touches = F.col("event_type").contains("paragraph_") | F.col("event_type").contains("block")
    return events.groupBy("run_id").agg(
        F.countDistinct(F.when(touches, F.col("block_id"))).alias("seen_blocks"),
        F.countDistinct(F.when(_ends(".paragraph_completed"), F.col("block_id"))).alias("completed_blocks"),
        _count(F.col("severity") == "warning", "warnings"),
        _count(F.col("severity") == "error", "failures"),
        elapsed(F.floor((F.max("event_us") - F.min("event_us")) / 1000000)).alias("elapsed"),
    )


def recent(events: DataFrame, n: int = 100, run_id: str | None = None, release_id: str | None = None) -> DataFrame:
    """The newest n events (a top-k: one bounded heap a task), with optional equality filters."""
    for name, value in (("run_id", run_id), ("release_id", release_id)):
        events = events.where(F.col(name) == value) if value else events
    return events.orderBy(F.desc("event_us"), F.desc("event_id")).limit(n).select("event_id", "event_us", "run_id", "event_type", "severity")


def filtered(events: DataFrame, *, max_level: int, severities: tuple[str, ...], stage: str | None = None, chapter: int | None = None) -> DataFrame:
    out = events.withColumn("level", event_level(F.col("event_type"), F.lower("severity"))).where(F.col("level") <= max_level)
    out = out.where(F.col("severity").isin(*severities)) if severities else out
    out = out.where(F.col("stage_name") == stage) if stage else out
    out = out.where(F.col("chapter_number") == chapter) if chapter is not None else out
    return out.select("event_id", "level", "severity", "stage_name", "chapter_number")


def subscribed(events: DataFrame, level: int) -> DataFrame:
    """Live delivery: an event goes to a subscriber whose level it reaches from above (the opposite of `filtered`)."""
    out = events.withColumn("level", event_level(F.col("event_type"), F.col("severity")))
    return out.where(F.col("level") >= level).select("event_id", "level")


def warning_trends(events: DataFrame, n: int = 50) -> DataFrame:
    return recent(events.where(F.col("severity").isin("warning", "error")), n)


def latest_failure(events: DataFrame) -> DataFrame:
    failures = with_message(events).where((F.col("severity") == "error") | signal_text().contains("fail"))
    return failures.groupBy("run_id").agg(F.max(F.struct("event_us", "message", "event_id")).alias("m")).select("run_id", "m.event_us", "m.message", "m.event_id")


def persisted(events: DataFrame, every: int = 25) -> DataFrame:
    """Reduced persistence: critical events, and of each run's progress events of a type the first and every `every`-th."""
    kind, severity = F.col("event_type"), F.col("severity")
    sampled = is_progress(kind) & ~is_critical(kind, severity)
    nth = F.row_number().over(Window.partitionBy("run_id", "event_type").orderBy("event_us", "event_id"))
    kept = events.where(sampled).withColumn("n", nth).where((F.col("n") == 1) | (F.col("n") % every == 0)).drop("n")
    return events.where(~sampled).unionByName(kept).select("event_id", "run_id", "event_type")


SIGNATURE = ("run_id", "release_id", "stage_name", "chapter_number", "event_type", "severity")


def deduped(live: DataFrame, stored: DataFrame, signature: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """Union of live and stored events, of each signature the first (live before stored, then by time)."""
    both = live.withColumn("side", F.lit(0)).unionByName(stored.withColumn("side", F.lit(1)))
    first = F.min(F.struct("side", "event_us", "event_id")).alias("first")
    return both.groupBy(*signature).agg(first).select(*signature, "first.event_id", F.col("first.side").alias("side"))


def tail_deduped(events: DataFrame, signature: tuple[str, ...] = (*SIGNATURE, "block_id", "k", "event_us")) -> DataFrame:
    """First by event_id, then by a wide signature; the earliest stays."""
    by_id = events.groupBy("event_id").agg(F.min(F.struct("event_us", *(c for c in signature if c != "event_us"))).alias("e")).select("event_id", "e.*")
    return by_id.groupBy(*signature).agg(F.min("event_id").alias("event_id")).select("event_id", "event_us", "run_id", "event_type")


def available_filters(events: DataFrame) -> DataFrame:
    stages = events.select(F.lit("stage").alias("kind"), F.col("stage_name").alias("value"))
    numbers = events.select(F.lit("chapter").alias("kind"), F.col("chapter_number").cast("string").alias("value"))
    return stages.unionByName(numbers).where("value IS NOT NULL").distinct()


def chapter_status(events: DataFrame) -> DataFrame:
    """The ordered state fold: the last completion decides (failed if its payload says so, high-risk after an earlier
    skipped paragraph), else the first start or failure."""
    done, skipped = _ends(".chapter_completed"), _ends(".paragraph_skipped")
    start, fail = _ends(".chapter_started"), F.lower("event_type").contains("fail") & ~_ends(".paragraph_skipped")
    state = F.when(start, "in-progress").when(fail, "failed")
    out = events.where("chapter_number IS NOT NULL").groupBy("run_id", "chapter_number").agg(
        F.max(F.when(done, F.struct("event_us", "event_id", "k"))).alias("last"),
        F.min(F.when(skipped, _order())).alias("risk"),
        F.min_by(state, F.when(state.isNotNull(), _order())).alias("open"),
    )
    final = F.when(F.col("last").isNull(), F.col("open")).when(F.col("last.k") % 10 == 0, "failed").when(F.col("risk") < F.struct("last.event_us", "last.event_id"), "high-risk").otherwise("complete")
    return out.select("run_id", "chapter_number", final.alias("status")).where("status IS NOT NULL")


def block_status(events: DataFrame) -> DataFrame:
    done, fail = F.col("event_type").contains("complete"), F.lower("event_type").contains("fail")
    final = F.when(done, "done").when(fail, "failed")
    out = events.where("chapter_number IS NOT NULL AND block_id IS NOT NULL").groupBy("run_id", "chapter_number", "block_id")
    return out.agg(F.coalesce(F.max_by(final, F.when(done | fail, _order())), F.lit("in-progress")).alias("status"))


def stage_progress(events: DataFrame) -> DataFrame:
    """Per run and stage: total of the last start, chapters done (at most the total), and the chapter still at work."""
    done = _ends(".chapter_completed") | _ends(".chapter_skipped")
    per_chapter = events.groupBy("run_id", "stage_name", "chapter_number").agg(F.max(F.when(done, _order())).alias("done_at"), F.max(F.when(_ends(".chapter_started"), _order())).alias("start_at"))
    starts = events.where(_ends(".started")).groupBy("run_id", "stage_name").agg(F.max_by("k", _order()).alias("total"))
    per_stage = per_chapter.groupBy("run_id", "stage_name").agg(
        F.countDistinct(F.when(F.col("done_at").isNotNull(), F.col("chapter_number"))).alias("done"),
        F.max(F.when(F.col("start_at").isNotNull(), F.struct("start_at", "chapter_number", "done_at"))).alias("last"),
    )
    active = F.when(F.col("last.done_at").isNull() | (F.col("last.done_at") < F.col("last.start_at")), F.col("last.chapter_number"))
    return starts.join(per_stage, ["run_id", "stage_name"]).select("run_id", "stage_name", "total", F.least(F.col("done"), F.col("total")).cast("long").alias("completed"), active.alias("active_chapter"))


def pulse_histogram(events: DataFrame, buckets: int = 30) -> DataFrame:
    """Per run, completed paragraphs in equal parts of its time, all parts present, and a glyph level from 0 to 7."""
    span = events.groupBy("run_id").agg(F.min("event_us").alias("low"), F.max("event_us").alias("high"))
    length = F.greatest(F.col("high") - F.col("low"), F.lit(1000000))
    hits = events.where(_ends(".paragraph_completed")).join(span, "run_id")
    part = F.least(F.lit(buckets - 1), F.floor((F.col("event_us") - F.col("low")) * buckets / length)).cast("int")
    counts = hits.groupBy("run_id", part.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    axis = span.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    full = axis.join(counts, ["run_id", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    most = F.max("n").over(Window.partitionBy("run_id"))
    return full.select("run_id", "bucket", "n", F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") * 7 / most))).cast("long").alias("level"))


def stale_runs(events: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Per run: sessions parted by silences of `gap_seconds` or more, and whether it is silent at the stream's end."""
    w = Window.partitionBy("run_id").orderBy("event_us", "event_id")
    gap = F.col("event_us") - F.lag("event_us").over(w)
    now = events.agg(F.max("event_us").alias("now"))
    per_run = events.withColumn("gap", gap).groupBy("run_id").agg((F.count_if(F.col("gap") >= gap_seconds * 1000000) + 1).alias("sessions"), F.max("event_us").alias("last_us"))
    return per_run.join(F.broadcast(now)).select("run_id", "sessions", "last_us", (F.col("now") - F.col("last_us") >= gap_seconds * 1000000).alias("is_stale"))


def stage_latency(events: DataFrame) -> DataFrame:
    """Start of a stage in a run to the next event that starts or ends it, where that is an end."""
    ends = _ends(".completed") | _ends(".failed")
    w = Window.partitionBy("run_id", "stage_name").orderBy("event_us", "event_id")
    marked = events.where(_ends(".started") | ends).withColumn("is_end", ends)
    follow = marked.withColumns({"next_us": F.lead("event_us").over(w), "next_end": F.lead("is_end").over(w)})
    return follow.where(~F.col("is_end") & F.col("next_end")).select("event_id", "run_id", "stage_name", (F.col("next_us") - F.col("event_us")).alias("latency_us"))


def stage_readiness(events: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Per run and stage in order: done, failed, ready (all before it done) or blocked; and the next stage to start."""
    seen = events.groupBy("run_id", "stage_name").agg(F.max(F.when(_ends(".completed"), F.col("event_us"))).alias("done"), F.max(F.when(_ends(".failed"), F.col("event_us"))).alias("fail"))
    position = F.array_position(F.array(*map(F.lit, stages)), F.col("stage_name")).cast("int")
    state = F.when(F.col("done").isNotNull() & (F.col("fail").isNull() | (F.col("done") >= F.col("fail"))), "done").when(F.col("fail").isNotNull(), "failed")
    states = seen.select("run_id", "stage_name", position.alias("position"), state.alias("state"))
    before = Window.partitionBy("run_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.count_if(F.coalesce(F.col("state") != "done", F.lit(True))).over(before), F.lit(0))
    out = states.withColumn("open_before", open_).withColumn("readiness", F.coalesce("state", F.when(F.col("open_before") == 0, "ready").otherwise("blocked")))
    todo = F.when((F.coalesce(F.col("state"), F.lit("")) != "done") & (F.col("open_before") == 0), F.col("stage_name"))
    return out.withColumn("next_stage", F.max(todo).over(Window.partitionBy("run_id"))).select("run_id", "stage_name", "position", "readiness", "next_stage")


def run_elapsed(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(elapsed(F.floor((F.max("event_us") - F.min("event_us")) / 1000000)).alias("elapsed"))


def run_status_labels(events: DataFrame, stale_seconds: int = 300) -> DataFrame:
    now = events.agg(F.max("event_us").alias("now"))
    last = events.groupBy("run_id").agg(F.max_by("event_type", _order()).alias("last_type"), F.max("event_us").alias("last_us")).join(F.broadcast(now))
    age = F.floor((F.col("now") - F.col("last_us")) / 1000000)
    label = F.when(F.col("last_type").endswith(".failed"), "FAILED").when(age >= stale_seconds, "STALE").otherwise("RUNNING")
    return last.select("run_id", label.alias("label"), F.format_string("%dh %02dm ago", F.floor(age / 3600), F.floor(age % 3600 / 60)).alias("age"))


def record_lines(events: DataFrame, most: int = 180) -> DataFrame:
    line = F.concat_ws(" | ", F.col("event_us").cast("string"), F.upper("severity"), "stage_name", F.concat(F.lit("ch"), F.col("chapter_number").cast("string")), "event_type", F.nullif("message", F.lit("")))
    return with_message(events).select("event_id", F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line).alias("line"))


def recent_runs(events: DataFrame, n: int = 5) -> DataFrame:
    runs = events.groupBy("run_id").agg(F.min("event_us").alias("started_us"), F.count(F.lit(1)).alias("events"))
    return runs.orderBy(F.desc("started_us"), "run_id").limit(n)


def checkpoint_progress(events: DataFrame) -> DataFrame:
    """The furthest chapter in any of the lists of done chapters of a run's checkpoint."""
    lists = [F.collect_set(F.when(_ends(s), F.col("chapter_number"))) for s in (".chapter_completed", ".chapter_skipped", ".paragraph_completed")]
    return events.groupBy("run_id").agg(F.coalesce(F.array_max(F.concat(*lists)), F.lit(0)).alias("chapter_index"))


def usage_delta(events: DataFrame) -> DataFrame:
    """Growth of a counter between readings, never below zero, summed by run."""
    w = Window.partitionBy("run_id", "stage_name").orderBy("event_us", "event_id")
    grown = F.greatest(F.lit(0), F.col("k") - F.coalesce(F.lag("k").over(w), F.lit(0)))
    return events.withColumn("delta", grown).groupBy("run_id", "stage_name").agg(F.sum("delta").alias("delta"))


def completed_prefix(events: DataFrame) -> DataFrame:
    """Per run: the range of chapters, the first that failed, and how many completed ones lie before it."""
    done, fail = _ends(".chapter_completed"), F.col("severity") == "error"
    per = events.groupBy("run_id", "chapter_number").agg(F.bool_or(done).alias("done"), F.bool_or(fail).alias("fail"))
    first = per.groupBy("run_id").agg(F.min("chapter_number").alias("low"), F.max("chapter_number").alias("high"), F.min(F.when(F.col("fail"), F.col("chapter_number"))).alias("first_failed"))
    out = per.join(first, "run_id").groupBy("run_id", "low", "high", "first_failed")
    return out.agg(F.count_if(F.col("done") & (F.col("first_failed").isNull() | (F.col("chapter_number") < F.col("first_failed")))).alias("completed_before"))


def tumbling(events: DataFrame, minutes: int = 360) -> DataFrame:
    start = F.floor(F.col("event_us") / (minutes * 60_000_000)) * (minutes * 60_000_000)
    return events.groupBy(start.alias("window_us"), "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("score"))
