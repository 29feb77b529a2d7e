"""Queries over sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, udfs
from ..sources import html
from ..streaming import events as st
from . import adapters as A


def stream(plan, mode="append"):
    def run(spark, sf_dir):
        source = A.table(spark, sf_dir, "events")
        return st.replay(spark, f"{sf_dir}/events.parquet*", source.schema, lambda s: plan(st.timed(A.as_tracking(s))), mode)

    return run


def html_tags(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count("html", F.lit("<br")).cast("long").alias("breaks"))


def round_trip(spark, sf_dir):
    """Placeholders made of markup and turned back: the rows that differ are counted, none should."""
    talk = A.pairs(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit('<b class="x"><i>'), F.regexp_replace("source_text", "[<>&]", ""), F.lit("</i> and</b> more")).alias("markup"))
    placed = talk.withColumn("p", udfs.extract_placeholders("markup"))
    return placed.select("conv_id", "turn", F.col("p.text").alias("text"), (udfs.restore_placeholders("p.text", "p.tags") == F.col("markup")).alias("same"))


def generated(spark, sf_dir):
    """The generator seam with a deterministic client."""
    rows = A.table(spark, sf_dir, "benchmark")
    return rows.select("item_id", udfs.generator(lambda: lambda p: f"out: {p}")(F.col("text")).alias("output"))


def raw_answers(spark, sf_dir):
    """Model answers in their usual disguises."""
    n, t = F.col("doc_id") % 4, F.regexp_replace("text", r"[\s`:]+", " ")
    answer = F.when(n == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(n == 1, F.concat(F.lit("thinking\nTranslation: "), t)).when(n == 2, F.concat(F.col("source"), F.lit(" -> "), F.col("source"), F.lit(" = "), t)).otherwise(t)
    return A.table(spark, sf_dir, "documents").select("doc_id", "source", answer.alias("answer"))


def cleaned_answers(spark, sf_dir):
    r = raw_answers(spark, sf_dir)
    return r.select("doc_id", answers.without_fence(F.col("answer")).alias("unfenced"), answers.last_line(F.col("answer")).alias("last_line"), answers.without_echo(F.col("answer"), F.col("source")).alias("unechoed"))


_T = "trim(regexp_replace(text, '[\\s`:]+', ' ', 'g'))"
_RAW = "regexp_replace(text, '[\\s`:]+', ' ', 'g')"
_RT = """SELECT conv_id, turn, '⟦B_1⟧⟦I_1⟧' || regexp_replace(source_text, '[<>&]', '', 'g') || '⟦/I_1⟧ and⟦/B_1⟧ more' AS text, true AS same FROM pairs"""

PLANS = {
    "page_blocks": (lambda s, d: html.page_blocks(A.table(s, d, "pages")), None),
    "page_tags": (html_tags, "SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<br')) AS breaks FROM pages"),
    "placeholder_round_trip": (round_trip, f"WITH {A.PAIRS} {_RT}"),
    "generator_seam": (generated, "SELECT item_id, 'out: ' || text AS output FROM benchmark"),
    "answer_cleanup": (cleaned_answers, f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {_T} WHEN 1 THEN trim('thinking' || chr(10) || 'Translation: ' || {_RAW}) WHEN 2 THEN trim(source || ' -> ' || source || ' = ' || {_RAW}) ELSE {_T} END AS unfenced,
      CASE doc_id % 4 WHEN 0 THEN '```' WHEN 2 THEN trim(source || ' -> ' || source || ' = ' || {_RAW}) ELSE {_T} END AS last_line,
      CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || {_RAW} || chr(10) || '```' WHEN 1 THEN 'thinking' || chr(10) || 'Translation: ' || {_RAW} WHEN 2 THEN trim('= ' || {_RAW}) ELSE {_RAW} END AS unechoed FROM documents"""),
    "stream_windows": (stream(st.windows, "complete"), f"WITH {A.TEV} SELECT event_us // 21600000000 * 21600000000 AS window_us, severity, count(*) AS n, round(sum(score), 2) AS score FROM tev GROUP BY 1, 2"),
    "stream_dedupe": (stream(lambda e: st.deduped(e)), f"WITH {A.TEV} SELECT event_id, event_us, run_id, event_type FROM tev"),
    "stream_sampling": (stream(st.sampled), None),
    "stream_counters": (stream(lambda e: e.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "error").alias("errors")), "complete"), f"WITH {A.TEV} SELECT run_id, count(*) AS n, count(*) FILTER (severity = 'error') AS errors FROM tev GROUP BY 1"),
    "event_sessions": (lambda s, d: st.sessions(st.timed(A.tracking_events(s, d)), "30 minutes"), f"""WITH {A.TEV}, g AS (SELECT run_id, event_us, CASE WHEN event_us - lag(event_us) OVER w >= 1800000000 THEN 1 ELSE 0 END AS cut FROM tev WINDOW w AS (PARTITION BY run_id ORDER BY event_us, event_id)),
      s AS (SELECT run_id, event_us, sum(coalesce(cut, 0)) OVER (PARTITION BY run_id ORDER BY event_us ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT run_id, min(event_us) AS start_us, max(event_us) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY run_id, k"""),
}
