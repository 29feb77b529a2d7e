"""Queries over the temporal graph, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as ops
from . import adapters as A

W = f"WITH {A.OBSERVATIONS}"
#: The fold, one observation after another.
REL = f"""WITH RECURSIVE {A.OBSERVATIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY edge_type, source_id ORDER BY chapter_number, target_id, row_index) AS rn FROM obs),
  walk AS (SELECT edge_type, source_id, rn, target_id AS cur, chapter_number AS start, 1 AS island FROM o WHERE rn = 1
    UNION ALL SELECT o.edge_type, o.source_id, o.rn, CASE WHEN o.target_id = w.cur OR o.chapter_number = w.start THEN w.cur ELSE o.target_id END, CASE WHEN o.target_id = w.cur OR o.chapter_number = w.start THEN w.start ELSE o.chapter_number END,
      w.island + CASE WHEN o.target_id = w.cur OR o.chapter_number = w.start THEN 0 ELSE 1 END FROM walk w JOIN o ON o.edge_type = w.edge_type AND o.source_id = w.source_id AND o.rn = w.rn + 1),
  isl AS (SELECT edge_type, source_id, island, any_value(cur) AS target_id, any_value(start) AS start_chapter, arg_min(lore_text, rn) FILTER (lore_text IS NOT NULL) AS lore_text, bool_or(is_masked) AS is_masked, max(confidence) AS confidence FROM walk JOIN o USING (edge_type, source_id, rn) GROUP BY 1, 2, 3),
  rel AS (SELECT 'rel_' || left(sha256('r:' || edge_type || ':' || source_id || ':' || target_id || ':' || start_chapter), 24) AS relationship_id, edge_type, source_id, target_id, start_chapter, lead(start_chapter) OVER (PARTITION BY edge_type, source_id ORDER BY island) - 1 AS end_chapter,
    start_chapter AS revealed, lore_text, is_masked, confidence FROM isl),
  ent AS (SELECT entity_id, min(chapter_number) AS first_seen, max(chapter_number) AS last_seen, min(chapter_number) AS revealed, count(*) AS mentions FROM (SELECT source_id AS entity_id, chapter_number FROM obs UNION ALL SELECT target_id, chapter_number FROM obs) GROUP BY 1)"""
VISIBLE = "start_chapter <= {n} AND (end_chapter IS NULL OR end_chapter >= {n}) AND revealed <= {n}"
AT = 24
SEEN = VISIBLE.format(n=AT)
IDS = "entity_id LIKE '%5'"


def obs(spark, sf_dir):
    return A.observations(spark, sf_dir)


def rel(spark, sf_dir):
    return ops.relationship_intervals(obs(spark, sf_dir))


def ent(spark, sf_dir):
    return ops.entities(obs(spark, sf_dir))


def some(spark, sf_dir):
    return ent(spark, sf_dir).where(F.col("entity_id").endswith("5"))


def months(spark, sf_dir):
    return spark.range(1, 85).select(F.col("id").cast("int").alias("chapter_number"))


def names(spark, sf_dir):
    return ent(spark, sf_dir).where("mentions % 2 = 0").select("entity_id", F.upper("entity_id").alias("name"))


def spoiled(spark, sf_dir):
    """Relationships with faults put in."""
    r = rel(spark, sf_dir)
    h = F.col("start_chapter")
    return r.withColumns({
        "edge_type": F.when(h % 13 == 0, "BAD").otherwise(F.col("edge_type")),
        "revealed": F.when(h % 7 == 0, h - 1).when(h % 11 == 0, h + 40).otherwise(F.col("revealed")),
        "lore_text": F.when(h % 5 == 0, "  ").when(h % 17 == 0, "see chapter 80").otherwise(F.col("lore_text")),
        "target_id": F.when(h % 19 == 0, "ent_gone").otherwise(F.col("target_id")),
    })


SPOILED = f"""{REL}, sp AS (SELECT relationship_id, CASE WHEN start_chapter % 13 = 0 THEN 'BAD' ELSE edge_type END AS edge_type, source_id, CASE WHEN start_chapter % 19 = 0 THEN 'ent_gone' ELSE target_id END AS target_id, start_chapter, end_chapter,
  CASE WHEN start_chapter % 7 = 0 THEN start_chapter - 1 WHEN start_chapter % 11 = 0 THEN start_chapter + 40 ELSE revealed END AS revealed, CASE WHEN start_chapter % 5 = 0 THEN '  ' WHEN start_chapter % 17 = 0 THEN 'see chapter 80' ELSE lore_text END AS lore_text FROM rel)"""


def named(spark, sf_dir):
    return A.mentions(spark, sf_dir).select("norm", "category", "chapter_number", "row_index", "release_id", F.concat_ws(":", "release_id", "norm").alias("entity_id"))


def neighbours(spark, sf_dir):
    """Neighbouring mentions as relationships between their entities, in every release."""
    m = A.mentions(spark, sf_dir)
    place = ["release_id", "chapter_number", "row_index"]
    after = m.select("release_id", "chapter_number", (F.col("row_index") - 1).alias("row_index"), F.col("norm").alias("target_name"))
    pairs = m.select(*place, F.col("norm").alias("source_name")).join(after, place)
    return ops.resolved_relationships(pairs, m.withColumn("entity_id", F.concat_ws(":", "release_id", "category", "norm")), tuple(place))


def context(spark, sf_dir):
    """As of every chapter: how many relationships are visible, and of how many entities."""
    v = ops.chapter_view(rel(spark, sf_dir), ent(spark, sf_dir), months(spark, sf_dir))
    return v.groupBy("n").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


PLANS = {
    "graph_entities": (ent, f"{REL} SELECT * FROM ent"),
    "graph_appearances": (lambda s, d: ops.appearances(obs(s, d)), f"{W} SELECT source_id AS entity_id, chapter_number, arg_min(lore_text, row_index) FILTER (lore_text IS NOT NULL) AS snippet FROM obs GROUP BY 1, 2"),
    "relationship_intervals": (rel, f"{REL} SELECT * FROM rel"),
    "chapter_view": (lambda s, d: ops.chapter_view(rel(s, d), ent(s, d), months(s, d)), f"""{REL} SELECT CAST(n AS INTEGER) AS n, relationship_id, edge_type, source_id, target_id FROM rel JOIN range(1, 85) r(n) ON {VISIBLE.format(n='n')} JOIN ent a ON a.entity_id = source_id AND a.first_seen <= n AND a.last_seen >= n JOIN ent b ON b.entity_id = target_id AND b.first_seen <= n AND b.last_seen >= n""".replace("AND revealed <= n", "AND rel.revealed <= n")),
    "graph_context": (context, f"""{REL} SELECT CAST(n AS INTEGER) AS n, count(*) AS edges, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM rel JOIN range(1, 85) r(n) ON {VISIBLE.format(n='n')} JOIN ent a ON a.entity_id = source_id AND a.first_seen <= n AND a.last_seen >= n JOIN ent b ON b.entity_id = target_id AND b.first_seen <= n AND b.last_seen >= n GROUP BY 1""".replace("AND revealed <= n", "AND rel.revealed <= n")),
    "safe_subgraph": (lambda s, d: ops.safe_subgraph(rel(s, d), ent(s, d), AT), f"{REL} SELECT relationship_id, source_id, target_id, edge_type FROM rel WHERE {SEEN} AND source_id IN (SELECT entity_id FROM ent WHERE revealed <= {AT}) AND target_id IN (SELECT entity_id FROM ent WHERE revealed <= {AT})"),
    "hierarchy_context": (lambda s, d: ops.hierarchy_context(rel(s, d), AT, A.EDGE_TYPES[:3]), f"{REL} SELECT relationship_id, edge_type, source_id, target_id FROM rel WHERE {SEEN} AND edge_type IN {A.EDGE_TYPES[:3]}"),
    "revealed_lore": (lambda s, d: ops.revealed_lore(rel(s, d), AT, True), f"{REL} SELECT relationship_id, lore_text, is_masked FROM rel WHERE {SEEN} AND trim(lore_text) <> '' AND is_masked"),
    "local_world_edges": (lambda s, d: ops.local_both(rel(s, d).where(ops.visible(F.lit(AT))), some(s, d)).select("relationship_id"), f"{REL} SELECT relationship_id FROM rel WHERE {SEEN} AND source_id IN (SELECT entity_id FROM ent WHERE {IDS}) AND target_id IN (SELECT entity_id FROM ent WHERE {IDS})"),
    "local_relationships_any": (lambda s, d: ops.local_any(rel(s, d).select("relationship_id", "source_id", "target_id"), some(s, d)), f"{REL} SELECT relationship_id, source_id, target_id FROM rel WHERE source_id IN (SELECT entity_id FROM ent WHERE {IDS}) OR target_id IN (SELECT entity_id FROM ent WHERE {IDS})"),
    "local_relationships_both": (lambda s, d: ops.local_both(rel(s, d), some(s, d)).select("relationship_id", "source_id", "target_id"), f"{REL} SELECT relationship_id, source_id, target_id FROM rel WHERE source_id IN (SELECT entity_id FROM ent WHERE {IDS}) AND target_id IN (SELECT entity_id FROM ent WHERE {IDS})"),
    "local_entities": (lambda s, d: some(s, d).select("entity_id").unionByName(obs(s, d).where("chapter_number = 24").select(F.col("source_id").alias("entity_id"))).unionByName(obs(s, d).where("lore_text LIKE '%7'").select(F.col("target_id").alias("entity_id"))).distinct(), f"{REL} SELECT entity_id FROM ent WHERE {IDS} UNION SELECT source_id FROM obs WHERE chapter_number = 24 UNION SELECT target_id FROM obs WHERE lore_text LIKE '%7'"),
    "relationship_names": (lambda s, d: ops.relationship_names(rel(s, d), names(s, d)), f"{REL}, nm AS (SELECT entity_id, upper(entity_id) AS name FROM ent WHERE mentions % 2 = 0) SELECT relationship_id, coalesce(a.name, source_id) AS source_name, coalesce(b.name, target_id) AS target_name FROM rel LEFT JOIN nm a ON a.entity_id = source_id LEFT JOIN nm b ON b.entity_id = target_id"),
    "relationship_resolution": (neighbours, f"""WITH {A.MENTIONS}, f AS (SELECT release_id, norm, arg_min(release_id || ':' || category || ':' || norm, CAST(chapter_number AS BIGINT) * 1000000 + row_index) AS entity_id FROM mentions GROUP BY 1, 2)
      SELECT a.release_id, a.chapter_number, a.row_index, s.entity_id AS source_id, t.entity_id AS target_id FROM mentions a JOIN mentions b ON b.release_id = a.release_id AND b.chapter_number = a.chapter_number AND b.row_index = a.row_index + 1
      JOIN f s ON s.release_id = a.release_id AND s.norm = a.norm JOIN f t ON t.release_id = b.release_id AND t.norm = b.norm"""),
    "type_conflicts": (lambda s, d: ops.type_conflicts(named(s, d)), f"""WITH {A.MENTIONS}, f AS (SELECT norm, category AS first_category FROM mentions QUALIFY row_number() OVER (PARTITION BY norm ORDER BY chapter_number, row_index, release_id) = 1)
      SELECT norm, category, first_category, count(*) AS dropped FROM mentions JOIN f USING (norm) WHERE category <> first_category GROUP BY 1, 2, 3"""),
    "alias_latest": (lambda s, d: ops.alias_latest(A.mentions(s, d).select("release_id", F.col("norm").alias("alias_text"), "chapter_number")), f"WITH {A.MENTIONS} SELECT release_id, norm AS alias_text, max(chapter_number) AS first_seen, max(chapter_number) AS last_seen FROM mentions GROUP BY 1, 2"),
    "graph_violations": (lambda s, d: ops.violations(spoiled(s, d), ent(s, d), A.EDGE_TYPES), f"""{SPOILED} SELECT relationship_id AS id, 'unsupported_type' AS rule FROM sp WHERE edge_type NOT IN {A.EDGE_TYPES} UNION ALL SELECT relationship_id, 'start_after_end' FROM sp WHERE start_chapter > end_chapter
      UNION ALL SELECT relationship_id, 'revealed_before_start' FROM sp WHERE revealed < start_chapter UNION ALL SELECT relationship_id, 'revealed_after_end' FROM sp WHERE revealed > end_chapter UNION ALL SELECT relationship_id, 'blank_lore' FROM sp WHERE trim(lore_text) = ''
      UNION ALL SELECT relationship_id, 'future_lore' FROM sp WHERE TRY_CAST(regexp_extract(lore_text, 'chapter ([0-9]+)', 1) AS INTEGER) > start_chapter
      UNION ALL SELECT relationship_id, 'dangling_source_id' FROM sp WHERE source_id NOT IN (SELECT entity_id FROM ent) UNION ALL SELECT relationship_id, 'dangling_target_id' FROM sp WHERE target_id NOT IN (SELECT entity_id FROM ent)
      UNION ALL SELECT entity_id, 'entity_range' FROM ent WHERE first_seen > last_seen OR revealed > last_seen"""),
    "graph_snapshot": (lambda s, d: ops.snapshot(rel(s, d), ent(s, d)), f"""{REL}, x AS (SELECT 'relationship' AS kind, sha256(relationship_id || '|' || coalesce(CAST(end_chapter AS VARCHAR), '~') || '|' || coalesce(lore_text, '~')) AS h FROM rel UNION ALL SELECT 'entity', sha256(entity_id || '|' || first_seen || '|' || last_seen) FROM ent),
      g AS (SELECT kind, left(h, 2) AS p, sha256(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS n FROM x GROUP BY 1, 2) SELECT kind, sha256(string_agg(h, ',' ORDER BY p)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1"""),
}
