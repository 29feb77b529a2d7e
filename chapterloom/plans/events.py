"""Queries over tracking events, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels
from ..operators import events as ops
from .adapters import STAGES, TEV, tracking_events

W = f"WITH {TEV}"
TEXT = "lower(event_type || ' ' || message)"
_LABEL = "array_to_string(list_transform(string_split(replace(stage_name, '-', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
_MESSAGE = f"""CASE WHEN ends_with(event_type, '.started') THEN {_LABEL} || ' started' || CASE WHEN k % 2 = 0 THEN ' for ' || k || ' chapters' ELSE '' END
  WHEN ends_with(event_type, '.chapter_started') THEN 'Processing ' || lower({_LABEL}) || ' in chapter ' || chapter_number
  WHEN ends_with(event_type, '.chapter_skipped') THEN 'Skipped ' || lower({_LABEL}) || ' for chapter ' || chapter_number
  WHEN ends_with(event_type, '.chapter_completed') THEN 'Completed ' || lower({_LABEL}) || ' for chapter ' || chapter_number
  WHEN ends_with(event_type, '.completed') THEN {_LABEL} || ' completed'
  WHEN ends_with(event_type, '.failed') THEN {_LABEL} || ' failed'
  WHEN ends_with(event_type, '.artifact_written') THEN 'Artifact written'
  WHEN ends_with(event_type, '.retry') THEN 'Retrying ' || block_id
  WHEN ends_with(event_type, '.paragraph_started') THEN 'Translating paragraph ' || block_id
  WHEN ends_with(event_type, '.paragraph_completed') THEN 'Translated paragraph ' || block_id
  WHEN ends_with(event_type, '.validation_failed') THEN 'Validation failed for paragraph ' || block_id || ': Unknown error'
  WHEN ends_with(event_type, '.risk_detected') THEN 'Risk detected in paragraph ' || block_id || ': High drift' ELSE '' END"""
M = f"{W}, msg AS (SELECT *, {_MESSAGE} AS message FROM tev)"
_E = "ends_with(event_type, '{}')"


def e(suffix: str) -> str:
    return _E.format(suffix)


def on(f):
    return lambda spark, sf_dir: f(tracking_events(spark, sf_dir))


PLANS = {
    "stage_summary": (on(ops.stage_summary), f"""{W} SELECT stage_name, count(*) FILTER ({e('.completed')}) AS completed, count(*) FILTER ({e('.failed')}) AS failed, count(*) FILTER ({e('.validation_failed')}) AS errors
      FROM tev WHERE {e('.completed')} OR {e('.failed')} OR {e('.validation_failed')} GROUP BY 1"""),
    "metric_totals": (on(ops.metric_totals), f"""{W} SELECT count(*) AS total_events, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') AS errors,
      count(DISTINCT CASE WHEN event_type LIKE 'preprocess-%' THEN stage_name END) AS stages FROM tev"""),
    "observability_counters": (on(ops.observability_counters), f"""{M} SELECT run_id, count(*) FILTER (severity = 'warning' OR {e('.validation_failed')}) AS warnings,
      count(*) FILTER (severity = 'error' OR contains({TEXT}, 'fail')) AS failures, count(*) FILTER ({e('_skipped')}) AS skips,
      count(*) FILTER (contains({TEXT}, 'retry')) AS retries, count(*) FILTER ({e('.artifact_written')}) AS artifacts FROM msg GROUP BY 1"""),
    "quick_stats": (on(ops.quick_stats), f"""{W}, l AS (SELECT run_id, k FROM tev WHERE {e('.completed')} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_us DESC, event_id DESC) = 1),
      g AS (SELECT run_id, count(*) FILTER ({e('.term_found')}) AS terms, count(*) FILTER ({e('.entity_extracted')}) AS entities, count(*) FILTER (contains(event_type, 'retry')) AS retries,
        round(avg(score) FILTER (contains(event_type, 'risk_detected')), 4) AS avg_risk FROM tev GROUP BY 1)
      SELECT run_id, terms, CAST(k AS BIGINT) AS promoted, entities, retries, avg_risk FROM g LEFT JOIN l USING (run_id)"""),
    "block_progress": (on(ops.block_progress), f"""{W} SELECT run_id, count(DISTINCT block_id) FILTER (contains(event_type, 'paragraph_') OR contains(event_type, 'block')) AS seen_blocks,
      count(DISTINCT block_id) FILTER ({e('.paragraph_completed')}) AS completed_blocks, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') AS failures,
      printf('%d:%02d:%02d', (max(event_us) - min(event_us)) // 1000000 // 3600, (max(event_us) - min(event_us)) // 1000000 % 3600 // 60, (max(event_us) - min(event_us)) // 1000000 % 60) AS elapsed FROM tev GROUP BY 1"""),
    "events_recent": (on(ops.recent), f"{W} SELECT event_id, event_us, run_id, event_type, severity FROM tev ORDER BY event_us DESC, event_id DESC LIMIT 100"),
    "event_filter": (on(lambda t: ops.filtered(t, max_level=levels.VERBOSITY["verbose"], severities=("warning", "error"), stage="preprocess-glossary")),
      f"{W} SELECT * FROM (SELECT event_id, {levels.LEVEL_SQL} AS level, severity, stage_name, chapter_number FROM tev) WHERE level <= 3 AND severity IN ('warning', 'error') AND stage_name = 'preprocess-glossary'"),
    "event_subscription": (on(lambda t: ops.subscribed(t, 3)), f"{W} SELECT * FROM (SELECT event_id, {levels.LEVEL_SQL} AS level FROM tev) WHERE level >= 3"),
    "event_levels": (on(lambda t: t.select("event_id", levels.event_level(F.col("event_type"), F.col("severity")).alias("level"))), f"{W} SELECT event_id, {levels.LEVEL_SQL} AS level FROM tev"),
    "event_message": (on(lambda t: ops.with_message(t).select("event_id", "message")), f"{M} SELECT event_id, message FROM msg"),
    "warning_trends": (on(ops.warning_trends), f"{W} SELECT event_id, event_us, run_id, event_type, severity FROM tev WHERE severity IN ('warning', 'error') ORDER BY event_us DESC, event_id DESC LIMIT 50"),
    "latest_failure": (on(ops.latest_failure), f"""{M} SELECT run_id, event_us, message, event_id FROM msg WHERE severity = 'error' OR contains({TEXT}, 'fail')
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_us DESC, message DESC, event_id DESC) = 1"""),
    "event_sampling": (on(ops.persisted), f"""{W}, p AS (SELECT *, {levels.PROGRESS_SQL} AND NOT {levels.CRITICAL_SQL} AS sampled FROM tev),
      n AS (SELECT *, row_number() OVER (PARTITION BY run_id, event_type, sampled ORDER BY event_us, event_id) AS n FROM p)
      SELECT event_id, run_id, event_type FROM n WHERE NOT sampled OR n = 1 OR n % 25 = 0"""),
    "event_dedupe": (on(lambda t: ops.deduped(t.where("event_id % 3 <> 0 OR event_id % 2 = 0"), t.where("event_id % 3 = 0"))), f"""{W}, b AS (SELECT *, 0 AS side FROM tev WHERE event_id % 3 <> 0 OR event_id % 2 = 0 UNION ALL SELECT *, 1 FROM tev WHERE event_id % 3 = 0)
      SELECT {', '.join(ops.SIGNATURE)}, event_id, side FROM b QUALIFY row_number() OVER (PARTITION BY {', '.join(ops.SIGNATURE)} ORDER BY side, event_us, event_id) = 1"""),
    "event_tail_dedupe": (on(lambda t: ops.tail_deduped(t.unionByName(t.where("event_id % 7 = 0")))), f"{W} SELECT min(event_id) AS event_id, event_us, run_id, event_type FROM tev GROUP BY {', '.join(ops.SIGNATURE)}, block_id, k, event_us"),
    "available_filters": (on(ops.available_filters), f"{W} SELECT DISTINCT 'stage' AS kind, stage_name AS value FROM tev UNION SELECT DISTINCT 'chapter', CAST(chapter_number AS VARCHAR) FROM tev"),
    "chapter_status": (on(ops.chapter_status), f"""{W}, d AS (SELECT run_id, chapter_number, event_us, event_id, k FROM tev WHERE {e('.chapter_completed')} QUALIFY row_number() OVER (PARTITION BY run_id, chapter_number ORDER BY event_us DESC, event_id DESC) = 1),
      s AS (SELECT run_id, chapter_number, event_us AS s_us, event_id AS s_id FROM tev WHERE {e('.paragraph_skipped')} QUALIFY row_number() OVER (PARTITION BY run_id, chapter_number ORDER BY event_us, event_id) = 1),
      o AS (SELECT run_id, chapter_number, CASE WHEN {e('.chapter_started')} THEN 'in-progress' ELSE 'failed' END AS open FROM tev WHERE {e('.chapter_started')} OR contains(event_type, 'fail') QUALIFY row_number() OVER (PARTITION BY run_id, chapter_number ORDER BY event_us, event_id) = 1),
      a AS (SELECT DISTINCT run_id, chapter_number FROM tev)
      SELECT run_id, chapter_number, CASE WHEN k IS NULL THEN open WHEN k % 10 = 0 THEN 'failed' WHEN s_us < event_us OR (s_us = event_us AND s_id < event_id) THEN 'high-risk' ELSE 'complete' END AS status
      FROM a LEFT JOIN d USING (run_id, chapter_number) LEFT JOIN s USING (run_id, chapter_number) LEFT JOIN o USING (run_id, chapter_number) WHERE k IS NOT NULL OR open IS NOT NULL"""),
    "block_status": (on(ops.block_status), f"""{W}, f AS (SELECT run_id, chapter_number, block_id, CASE WHEN contains(event_type, 'complete') THEN 'done' ELSE 'failed' END AS status FROM tev WHERE contains(event_type, 'complete') OR contains(event_type, 'fail')
        QUALIFY row_number() OVER (PARTITION BY run_id, chapter_number, block_id ORDER BY event_us DESC, event_id DESC) = 1)
      SELECT run_id, chapter_number, block_id, coalesce(status, 'in-progress') AS status FROM (SELECT DISTINCT run_id, chapter_number, block_id FROM tev) LEFT JOIN f USING (run_id, chapter_number, block_id)"""),
    "stage_progress": (on(ops.stage_progress), f"""{W}, t AS (SELECT run_id, stage_name, k AS total FROM tev WHERE {e('.started')} QUALIFY row_number() OVER (PARTITION BY run_id, stage_name ORDER BY event_us DESC, event_id DESC) = 1),
      d AS (SELECT run_id, stage_name, count(DISTINCT chapter_number) AS done FROM tev WHERE {e('.chapter_completed')} OR {e('.chapter_skipped')} GROUP BY 1, 2),
      l AS (SELECT run_id, stage_name, chapter_number, event_us, event_id FROM tev WHERE {e('.chapter_started')} QUALIFY row_number() OVER (PARTITION BY run_id, stage_name ORDER BY event_us DESC, event_id DESC) = 1)
      SELECT run_id, stage_name, total, least(coalesce(done, 0), CAST(total AS BIGINT)) AS completed, CASE WHEN NOT EXISTS (SELECT 1 FROM tev x WHERE x.run_id = l.run_id AND x.stage_name = l.stage_name AND x.chapter_number = l.chapter_number
        AND ({e('.chapter_completed').replace('event_type', 'x.event_type')} OR {e('.chapter_skipped').replace('event_type', 'x.event_type')}) AND (x.event_us, x.event_id) > (l.event_us, l.event_id)) THEN l.chapter_number END AS active_chapter
      FROM t LEFT JOIN d USING (run_id, stage_name) LEFT JOIN l USING (run_id, stage_name)"""),
    "pulse_histogram": (on(ops.pulse_histogram), f"""{W}, s AS (SELECT run_id, min(event_us) AS low, max(event_us) AS high FROM tev GROUP BY 1),
      c AS (SELECT run_id, least(29, (event_us - low) * 30 // greatest(high - low, 1000000)) AS bucket, count(*) AS n FROM tev JOIN s USING (run_id) WHERE {e('.paragraph_completed')} GROUP BY 1, 2),
      f AS (SELECT s.run_id, CAST(b AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM s CROSS JOIN range(30) r(b) LEFT JOIN c ON c.run_id = s.run_id AND c.bucket = b)
      SELECT run_id, bucket, n, CASE WHEN n = 0 THEN 0 ELSE CAST(greatest(1, ceil(n * 7 / max(n) OVER (PARTITION BY run_id))) AS BIGINT) END AS level FROM f"""),
    "stale_runs": (on(ops.stale_runs), f"""{W}, g AS (SELECT run_id, event_us, event_us - lag(event_us) OVER (PARTITION BY run_id ORDER BY event_us, event_id) AS gap FROM tev)
      SELECT run_id, count(*) FILTER (gap >= 300000000) + 1 AS sessions, max(event_us) AS last_us, (SELECT max(event_us) FROM tev) - max(event_us) >= 300000000 AS is_stale FROM g GROUP BY 1"""),
    "stage_latency": (on(ops.stage_latency), f"""{W}, m AS (SELECT *, NOT {e('.started')} AS is_end FROM tev WHERE {e('.started')} OR {e('.completed')} OR {e('.failed')}),
      f AS (SELECT *, lead(event_us) OVER w AS next_us, lead(is_end) OVER w AS next_end FROM m WINDOW w AS (PARTITION BY run_id, stage_name ORDER BY event_us, event_id))
      SELECT event_id, run_id, stage_name, next_us - event_us AS latency_us FROM f WHERE NOT is_end AND next_end"""),
    "stage_readiness": (on(lambda t: ops.stage_readiness(t, STAGES)), f"""{W}, s AS (SELECT run_id, stage_name, max(event_us) FILTER ({e('.completed')}) AS done, max(event_us) FILTER ({e('.failed')}) AS fail FROM tev GROUP BY 1, 2),
      p AS (SELECT run_id, stage_name, CAST(list_position({list(STAGES)}, stage_name) AS INTEGER) AS position, CASE WHEN done IS NOT NULL AND (fail IS NULL OR done >= fail) THEN 'done' WHEN fail IS NOT NULL THEN 'failed' END AS state FROM s),
      o AS (SELECT *, coalesce(sum(CASE WHEN state = 'done' THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_before FROM p)
      SELECT run_id, stage_name, position, coalesce(state, CASE WHEN open_before = 0 THEN 'ready' ELSE 'blocked' END) AS readiness,
        max(CASE WHEN coalesce(state, '') <> 'done' AND open_before = 0 THEN stage_name END) OVER (PARTITION BY run_id) AS next_stage FROM o"""),
    "run_elapsed": (on(ops.run_elapsed), f"""{W}, s AS (SELECT run_id, (max(event_us) - min(event_us)) // 1000000 AS n FROM tev GROUP BY 1) SELECT run_id, printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) AS elapsed FROM s"""),
    "run_status_labels": (on(ops.run_status_labels), f"""{W}, l AS (SELECT run_id, event_type, ((SELECT max(event_us) FROM tev) - event_us) // 1000000 AS age FROM tev QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_us DESC, event_id DESC) = 1)
      SELECT run_id, CASE WHEN {e('.failed')} THEN 'FAILED' WHEN age >= 300 THEN 'STALE' ELSE 'RUNNING' END AS label, printf('%dh %02dm ago', age // 3600, age % 3600 // 60) AS age FROM l"""),
    "record_lines": (on(ops.record_lines), f"""{M}, r AS (SELECT event_id, event_us || ' | ' || upper(severity) || ' | ' || stage_name || ' | ch' || chapter_number || ' | ' || event_type || CASE WHEN message = '' THEN '' ELSE ' | ' || message END AS line FROM msg)
      SELECT event_id, CASE WHEN length(line) > 180 THEN left(line, 177) || '...' ELSE line END AS line FROM r"""),
    "recent_runs": (on(ops.recent_runs), f"{W} SELECT run_id, min(event_us) AS started_us, count(*) AS events FROM tev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "checkpoint_progress": (on(ops.checkpoint_progress), f"{W} SELECT run_id, coalesce(max(chapter_number) FILTER ({e('.chapter_completed')} OR {e('.chapter_skipped')} OR {e('.paragraph_completed')}), 0) AS chapter_index FROM tev GROUP BY 1"),
    "usage_delta": (on(ops.usage_delta), f"""{W}, d AS (SELECT run_id, stage_name, greatest(0, k - coalesce(lag(k) OVER (PARTITION BY run_id, stage_name ORDER BY event_us, event_id), 0)) AS delta FROM tev)
      SELECT run_id, stage_name, CAST(sum(delta) AS BIGINT) AS delta FROM d GROUP BY 1, 2"""),
    "completed_prefix": (on(ops.completed_prefix), f"""{W}, p AS (SELECT run_id, chapter_number, bool_or({e('.chapter_completed')}) AS done, bool_or(severity = 'error') AS fail FROM tev GROUP BY 1, 2),
      f AS (SELECT run_id, min(chapter_number) AS low, max(chapter_number) AS high, min(chapter_number) FILTER (fail) AS first_failed FROM p GROUP BY 1)
      SELECT run_id, low, high, first_failed, count(*) FILTER (done AND (first_failed IS NULL OR chapter_number < first_failed)) AS completed_before FROM p JOIN f USING (run_id) GROUP BY ALL"""),
    "event_windows": (on(ops.tumbling), f"{W} SELECT event_us // 21600000000 * 21600000000 AS window_us, severity, count(*) AS n, round(sum(score), 2) AS score FROM tev GROUP BY 1, 2"),
}
