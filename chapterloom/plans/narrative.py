"""Queries over chapter texts and summaries, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import summaries as ops
from . import adapters as A

C = f"WITH {A.CHAPTERS}"
B = f"WITH {A.BLOCKS}"
SHORTS = f"{C}, shorts AS (SELECT release_id, chapter_number, left(replace(text, chr(10), ' '), 80) AS content, chapter_hash FROM chapters)"


def shorts(spark, sf_dir):
    """Summaries of chapters, cut before the chapters are numbered, so no texts are sorted."""
    cut = ops.short_summaries(A.unnumbered(spark, sf_dir).withColumnRenamed("doc_id", "chapter_number"))
    return cut.withColumn("chapter_number", A.number("release_id", "chapter_number"))


def flags(spark, sf_dir):
    return A.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_story"))


def chunks(spark, sf_dir):
    """Blocks as partial summaries of their document."""
    b = A.blocks(spark, sf_dir)
    return b.select("doc_id", F.col("block_order").alias("part"), F.slice(T.words(F.col("block_text")), 1, 2).alias("terms"), F.when(F.col("block_order") % 2 == 0, F.col("lang")).alias("setting"), F.substring("block_text", 1, 10).alias("narrative"), (F.length("block_text") > 200).alias("is_story"))


def segments(spark, sf_dir, width=400):
    """Blocks cut to pieces of fixed width."""
    b = A.blocks(spark, sf_dir)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("block_text") - 1) / width).cast("int")), lambda i: F.substring("block_text", i * width + 1, F.lit(width)))
    s = b.select("doc_id", "block_id", F.posexplode(cut).alias("pos", "t"))
    n = F.col("pos") % 3
    return s.select("doc_id", "block_id", (F.col("pos") + 1).alias("segment_order"), F.when(n == 0, F.col("t")).alias("final_text"), F.when(n == 1, F.col("t")).alias("restored_text"), F.col("t").alias("draft_text"))


SEGMENTS = f"""{B}, sg AS (SELECT doc_id, block_id, CAST(i + 1 AS INTEGER) AS segment_order, block_text[i * 400 + 1 : i * 400 + 400] AS t FROM (SELECT doc_id, block_id, block_text, unnest(range((length(block_text) - 1) // 400 + 1)) AS i FROM blocks))"""


def structured(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    full = F.to_json(F.struct(F.col("doc_id").alias("chapter_number"), F.array("lang").alias("characters_mentioned"), F.array("lang").alias("key_events"), F.array("lang").alias("new_terms"), F.array("lang").alias("relationships_changed"), F.col("lang").alias("setting"), F.col("lang").alias("tone"), F.col("lang").alias("narrative_progression"), F.lit(True).alias("is_story_chapter")))
    typed = F.replace(full, F.lit('"key_events":["en"]'), F.lit('"key_events":"en"'))
    return d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, '{"tone":"x","setting":"y"}').when(F.col("doc_id") % 4 == 1, typed).when(F.col("doc_id") % 4 == 2, "broken").otherwise(full).alias("payload"))


def paths(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"))


def numbered(spark, sf_dir):
    c = A.chapters(spark, sf_dir)
    n = F.col("chapter_number")
    said = F.concat(F.lit("As in Chapter "), (n + F.col("doc_id") % 5 - 2).cast("string"), F.lit(" and 第 "), (n + F.col("doc_id") % 3 - 1).cast("string"), F.lit(" 章: "), "text")
    return c.select("doc_id", "chapter_number", said.alias("said"))


_MISSING = "; ".join(f"missing: {c}" for c in ops.REQUIRED)
_PART = "; ".join(f"missing: {c}" for c in ops.REQUIRED if c not in ("setting", "tone"))

def checked(spark, sf_dir):
    """Structured summaries of the documents with the faults that the checks look for."""
    d = A.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    item = F.struct(F.col("lang").alias("entity"), F.when(n % 5 == 0, " ").otherwise(F.col("text")).alias("change"))
    full = F.to_json(F.struct(F.when(n % 3 == 0, n + 1).otherwise(n).alias("chapter_number"), F.array("lang").alias("characters_mentioned"), F.array(F.concat(F.lit("see Chapter "), (n + n % 4 - 1).cast("string"))).alias("key_events"), F.array("lang").alias("new_terms"), F.array(item).alias("relationships_changed"), F.when(n % 7 == 0, " ").otherwise(F.col("lang")).alias("setting"), F.col("lang").alias("tone"), F.col("lang").alias("narrative_progression"), (n % 11 != 0).alias("is_story_chapter")))
    return d.select("doc_id", F.when(n % 13 == 0, '{"tone":"x"}').otherwise(full).alias("payload"))


_NOT_TONE = ", ".join(sorted(c for c in ops.REQUIRED if c != "tone"))

PLANS = {
    "chapter_text": (lambda s, d: ops.chapter_text(A.blocks(s, d)), f"""{B}, t AS (SELECT release_id, chapter_number, doc_id, string_agg(trim(regexp_replace(block_text, '⟦/?[A-Z]+_[0-9]+⟧', '', 'g'), ' '), chr(10) ORDER BY block_order) AS text FROM blocks GROUP BY 1, 2, 3)
      SELECT release_id, chapter_number, doc_id, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_hash FROM t"""),
    "chapter_metadata": (lambda s, d: ops.chapter_metadata(A.blocks(s, d)), f"{B} SELECT release_id, chapter_number, count(*) AS record_count, count(DISTINCT block_text) AS distinct_blocks FROM blocks GROUP BY 1, 2"),
    "previous_three": (lambda s, d: ops.previous_three(shorts(s, d)), f"""{SHORTS} SELECT release_id, chapter_number, coalesce(string_agg(content, '|') OVER (PARTITION BY release_id ORDER BY chapter_number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS previous FROM shorts"""),
    "story_so_far": (lambda s, d: ops.story_so_far(shorts(s, d)), f"""{SHORTS}, st AS (SELECT release_id, chapter_number, string_agg('第' || chapter_number || '章：' || content, chr(10)) OVER (PARTITION BY release_id ORDER BY chapter_number ROWS UNBOUNDED PRECEDING) AS story FROM shorts WHERE content <> '')
      SELECT release_id, chapter_number, CAST(length(story) AS INTEGER) AS n_chars, sha256(story) AS story_hash FROM st"""),
    "lineage_hash": (lambda s, d: ops.lineage_hash(shorts(s, d)), f"""{SHORTS}, l AS (SELECT release_id, chapter_number, list(chapter_hash) OVER (PARTITION BY release_id ORDER BY chapter_number ROWS UNBOUNDED PRECEDING) AS h FROM shorts)
      SELECT release_id, chapter_number, sha256(array_to_string(list_sort(list_distinct(h)), '|')) AS lineage FROM l"""),
    "story_chapters": (lambda s, d: ops.story_chapters(A.chapters(s, d), flags(s, d).where("NOT is_story")), f"{C} SELECT release_id, chapter_number, doc_id FROM chapters WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    "story_guardrail": (lambda s, d: ops.story_guardrail(A.chapters(s, d), flags(s, d)), f"{C} SELECT c.doc_id, coalesce(quality = 1, true) OR length(text) > 500 AS is_story FROM chapters c LEFT JOIN labels l ON l.doc_id = c.doc_id"),
    "chapter_exclusion": (lambda s, d: ops.chapter_exclusion(paths(s, d), "path", (r"/\d*1\b", "about", r"3\.html")), r"SELECT page_id AS doc_id, url AS path FROM pages WHERE NOT regexp_matches(url, '(?:/\d*1\b)|(?:about)|(?:3\.html)')"),
    "future_knowledge": (lambda s, d: ops.future_knowledge(numbered(s, d), "said", "chapter_number").select("doc_id", "chapter_number", F.array_join(F.transform("ahead", lambda x: x.cast("string")), "|").alias("ahead")), rf"""{C}, n AS (SELECT doc_id, chapter_number, 'As in Chapter ' || (chapter_number + doc_id % 5 - 2) || ' and 第 ' || (chapter_number + doc_id % 3 - 1) || ' 章: ' || text AS said FROM chapters),
      x AS (SELECT doc_id, chapter_number, list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(said, '第\s*(\d+)\s*章', 1), regexp_extract_all(lower(said), '\bchapter\s+(\d+)\b', 1)), lambda v: TRY_CAST(v AS INTEGER)), lambda v: v > chapter_number))) AS ahead FROM n)
      SELECT doc_id, chapter_number, array_to_string(ahead, '|') AS ahead FROM x WHERE len(ahead) > 0"""),
    "summary_schema_errors": (lambda s, d: ops.schema_errors(structured(s, d), "payload"), f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{_PART}' WHEN 2 THEN '{_MISSING}' WHEN 1 THEN CASE WHEN lang = 'en' THEN 'key_events: not a list' ELSE '' END ELSE '' END AS errors FROM documents"""),
    "summary_validation": (lambda s, d: ops.validated_summaries(checked(s, d), "payload", "doc_id"), rf"""WITH x AS (SELECT doc_id, list_distinct([TRY_CAST(v AS BIGINT) FOR v IN list_concat(CASE WHEN doc_id % 5 <> 0 THEN regexp_extract_all(text, '第\s*(\d+)\s*章', 1) ELSE [] END, regexp_extract_all('chapter ' || (doc_id + doc_id % 4 - 1), '\bchapter\s+(\d+)\b', 1), CASE WHEN doc_id % 5 <> 0 THEN regexp_extract_all(lower(text), '\bchapter\s+(\d+)\b', 1) ELSE [] END)]) AS said FROM documents),
      e AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN ['schema_invalid: missing fields: {_NOT_TONE}'] ELSE list_filter(list_concat([CASE WHEN doc_id % 11 = 0 THEN 'non_story_chapter_flagged' END, CASE WHEN doc_id % 3 = 0 THEN 'continuity_conflict: chapter_number does not match extracted chapter number' END,
        CASE WHEN doc_id % 5 = 0 THEN 'schema_invalid: relationships_changed[0].change must be a non-empty string' END, CASE WHEN doc_id % 7 = 0 THEN 'schema_invalid: setting must be a non-empty string' END],
        [CASE WHEN v > doc_id THEN 'future_knowledge: references chapter ' || v || ' while validating chapter ' || doc_id END FOR v IN list_sort(said)]), lambda z: z IS NOT NULL) END AS errors FROM x)
      SELECT doc_id, CASE WHEN len(errors) > 0 THEN 'failed' ELSE 'success' END AS status, array_to_string(errors, '; ') AS errors FROM e"""),
    "chunk_combine": (lambda s, d: ops.chunk_combine(chunks(s, d)), rf"""{B}, ch AS (SELECT doc_id, block_order, list_filter(regexp_split_to_array(block_text, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')[1:2] AS terms, CASE WHEN block_order % 2 = 0 THEN lang END AS setting, left(block_text, 10) AS narrative, length(block_text) > 200 AS is_story FROM blocks),
      w AS (SELECT doc_id, block_order, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM ch), f AS (SELECT doc_id, term, min(block_order * 10 + i) AS place FROM w GROUP BY 1, 2), t AS (SELECT doc_id, string_agg(term, '|' ORDER BY place) AS terms FROM f GROUP BY 1),
      g AS (SELECT doc_id, coalesce(min(setting), '') AS setting, string_agg(narrative, ' ' ORDER BY block_order) AS narrative, bool_or(is_story) AS is_story FROM ch GROUP BY 1)
      SELECT g.doc_id, coalesce(t.terms, '') AS terms, setting, narrative, is_story FROM g LEFT JOIN t USING (doc_id)"""),
    "segment_reassembly": (lambda s, d: ops.segment_reassembly(segments(s, d)), f"{SEGMENTS} SELECT doc_id, block_id, string_agg(t, '' ORDER BY segment_order) AS text FROM sg GROUP BY 1, 2"),
    "prior_segments": (lambda s, d: ops.prior_segments(segments(s, d)), f"{SEGMENTS} SELECT doc_id, block_id, segment_order, coalesce(string_agg(t, chr(10)) OVER (PARTITION BY doc_id, block_id ORDER BY segment_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM sg"),
    "order_regression": (lambda s, d: ops.order_regressions(A.table(s, d, "documents").select("source", "doc_id", F.length("text").alias("n")), ["source"], "doc_id", "n"), "SELECT * FROM (SELECT source, doc_id, CAST(length(text) AS INTEGER) AS n, lag(CAST(length(text) AS INTEGER)) OVER (PARTITION BY source ORDER BY doc_id) AS previous FROM documents) WHERE n < previous"),
    "chapter_range": (lambda s, d: A.chapters(s, d).groupBy("release_id").agg(F.greatest(F.lit(1), F.min("chapter_number")).alias("low"), F.max("chapter_number").alias("high")), f"{C} SELECT release_id, greatest(1, min(chapter_number)) AS low, max(chapter_number) AS high FROM chapters GROUP BY 1"),
    "chapter_scan": (lambda s, d: A.chapters(s, d).where("chapter_number BETWEEN 3 AND 12").select("release_id", "chapter_number", "doc_id", "chapter_hash"), f"{C} SELECT release_id, chapter_number, doc_id, chapter_hash FROM chapters WHERE chapter_number BETWEEN 3 AND 12"),
    "sentence_segments": (lambda s, d: A.table(s, d, "documents").select("doc_id", F.posexplode(T.sentence_pieces(F.col("text"), 1500)).alias("pos", "piece")).select("doc_id", "pos", "piece"), None),
    "retry_segments": (lambda s, d: A.table(s, d, "documents").select("doc_id", F.posexplode(T.sentence_pieces(F.replace("text", F.lit(","), F.lit("\\")), 750, T.RETRY_STOPS)).alias("pos", "piece")), None),
}
