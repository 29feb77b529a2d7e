"""Event levels, criticality and default messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What event types of each level end with, by level.
LEVEL_PATTERNS = {
    1: ("started", "completed", "failed", "transition_denied", "finalized"),
    2: ("chapter_started", "chapter_completed", "chapter_skipped"),
    3: ("paragraph_started", "paragraph_completed", "paragraph_skipped"),
    4: ("retry", "risk_detected", "term_found", "entity_extracted", "draft_generated", "validation_"),
}
VERBOSITY = {"normal": 2, "verbose": 3, "debug": 4}
CRITICAL_ENDS = (".validation_failed", ".risk_detected", ".failed", ".stopped", ".chapter_skipped", ".artifact_written")


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def event_level(event_type: Column, severity: Column) -> Column:
    """0 (error) to 4 (token): by severity first, then the most specific level whose pattern ends the type, else is in it."""
    kind = F.lower(event_type)
    level = F.when(severity == "error", 0).when(severity == "debug", 4)
    for n in (4, 3, 2, 1):
        level = level.when(any_of([kind.endswith("." + p) for p in LEVEL_PATTERNS[n]]), n)
    for n in (4, 3, 2, 1):
        level = level.when(any_of([kind.contains(p) for p in LEVEL_PATTERNS[n]]), n)
    return level.otherwise(1)


def is_progress(event_type: Column) -> Column:
    return event_type.contains(".paragraph_") | event_type.contains(".chapter_")


def is_critical(event_type: Column, severity: Column) -> Column:
    ends = any_of([event_type.endswith(e) for e in CRITICAL_ENDS])
    edge = (event_type.endswith(".started") | event_type.endswith(".completed")) & ~is_progress(event_type)
    return severity.isin("warning", "error") | ends | edge


def stage_label(stage: Column) -> Column:
    return F.initcap(F.regexp_replace(stage, "[.-]", " "))


def default_message(event_type: Column, chapter: Column, block: Column, total: Column) -> Column:
    """The message of an event that brings none, by the end of its type; the first that fits counts."""
    stage = F.regexp_replace(event_type, r"\.[^.]*$", "")
    label, low, ch = stage_label(stage), F.lower(stage_label(stage)), chapter.cast("string")
    ends = event_type.endswith
    block_or = F.coalesce(block, F.lit("?"))
    started = F.when(total.isNotNull(), F.concat(label, F.lit(" started for "), total.cast("string"), F.lit(" chapters"))).otherwise(F.concat(label, F.lit(" started")))
    return (
        F.when(ends(".started"), started)
        .when(ends(".chapter_started"), F.coalesce(F.concat(F.lit("Processing "), low, F.lit(" in chapter "), ch), F.lit("")))
        .when(ends(".chapter_skipped"), F.coalesce(F.concat(F.lit("Skipped "), low, F.lit(" for chapter "), ch), F.lit("")))
        .when(ends(".chapter_completed"), F.coalesce(F.concat(F.lit("Completed "), low, F.lit(" for chapter "), ch), F.lit("")))
        .when(ends(".completed"), F.concat(label, F.lit(" completed")))
        .when(ends(".failed"), F.concat(label, F.lit(" failed")))
        .when(ends(".stopped"), F.concat(label, F.lit(" stopped")))
        .when(ends(".artifact_written"), F.lit("Artifact written"))
        .when(ends(".retry"), F.coalesce(F.concat(F.lit("Retrying "), block), F.lit("Retrying step")))
        .when(ends(".paragraph_started"), F.concat(F.lit("Translating paragraph "), block_or))
        .when(ends(".paragraph_completed"), F.concat(F.lit("Translated paragraph "), block_or))
        .when(ends(".validation_failed"), F.concat(F.lit("Validation failed for "), F.coalesce(F.concat(F.lit("paragraph "), block), F.concat(F.lit("chapter "), ch)), F.lit(": Unknown error")))
        .when(ends(".risk_detected"), F.concat(F.lit("Risk detected in paragraph "), block_or, F.lit(": High drift")))
        .otherwise("")
    )


def elapsed(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


# The same rules as SQL, for checks in another engine.


def _ends(patterns: tuple[str, ...], column: str) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{p}')" for p in patterns) + ")"


LEVEL_SQL = (
    "CASE WHEN severity = 'error' THEN 0 WHEN severity = 'debug' THEN 4 "
    + " ".join(f"WHEN {_ends(tuple('.' + p for p in LEVEL_PATTERNS[n]), 'lower(event_type)')} THEN {n}" for n in (4, 3, 2, 1))
    + " "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(event_type), '{p}')" for p in LEVEL_PATTERNS[n]) + f" THEN {n}" for n in (4, 3, 2, 1))
    + " ELSE 1 END"
)
PROGRESS_SQL = "(contains(event_type, '.paragraph_') OR contains(event_type, '.chapter_'))"
CRITICAL_SQL = f"(severity IN ('warning', 'error') OR {_ends(CRITICAL_ENDS, 'event_type')} OR ({_ends(('.started', '.completed'), 'event_type')} AND NOT {PROGRESS_SQL}))"
