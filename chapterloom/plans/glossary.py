"""Queries over terms and idioms, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import glossary as ops
from . import adapters as A

W = f"WITH {A.MENTIONS}"
CAND = f"""{W}, cand AS (SELECT release_id, norm, category, min(chapter_number) AS first_seen, max(chapter_number) AS last_seen, count(*) AS appearances,
  arg_max(source_term, CAST(chapter_number AS BIGINT) * 1000000 + row_index) AS source_term FROM mentions GROUP BY 1, 2, 3)"""
TARGET = "CASE WHEN length(norm) % 11 = 0 THEN '' WHEN length(norm) % 13 = 0 THEN '⟦B_1⟧' ELSE upper(replace(left(norm, 7), 'ß', 's')) END"
TARGETED = f"{CAND}, tc AS (SELECT release_id, norm, category, {TARGET} AS target, first_seen, last_seen, appearances FROM cand), locked AS (SELECT norm, category, min(upper(replace(left(norm, 6), 'ß', 's'))) AS target FROM cand WHERE release_id = 'src0' AND length(norm) % 2 = 0 GROUP BY 1, 2)"
CONFLICTS = f"""{TARGETED}, dup AS (SELECT category, target, count(DISTINCT norm) AS n_sources FROM tc GROUP BY 1, 2 HAVING count(DISTINCT norm) > 1),
  j AS (SELECT tc.release_id, tc.norm, tc.category, tc.target, n_sources, s.target AS s_target, t.norm AS t_norm FROM tc LEFT JOIN dup USING (category, target)
    LEFT JOIN locked s ON s.category = tc.category AND s.norm = tc.norm LEFT JOIN locked t ON t.category = tc.category AND t.target = tc.target),
  con AS (SELECT DISTINCT release_id, norm, category, target, reason FROM (SELECT release_id, norm, category, target, unnest([
    CASE WHEN target = '' THEN 'naming_policy: empty target' END, CASE WHEN regexp_matches(target, '⟦/?[A-Z]+_[0-9]+⟧') THEN 'naming_policy: placeholder in target' END,
    CASE WHEN NOT regexp_matches(target, '[A-Za-z]') THEN 'naming_policy: no ASCII letter in target' END, CASE WHEN n_sources > 1 THEN 'duplicate_target' END,
    CASE WHEN s_target <> target THEN 'canon_conflict: source' END, CASE WHEN t_norm <> norm THEN 'canon_conflict: target' END]) AS reason FROM j) WHERE reason IS NOT NULL)"""


def capitals(c):
    """Upper case; engines differ in the capital of ß, so it is s here."""
    return F.upper(F.replace(c, F.lit("ß"), F.lit("s")))


def candidates(spark, sf_dir):
    return ops.merged_candidates(A.mentions(spark, sf_dir))


def targeted(spark, sf_dir):
    n = F.length("norm")
    target = F.when(n % 11 == 0, "").when(n % 13 == 0, "⟦B_1⟧").otherwise(capitals(F.substring("norm", 1, 7)))
    return candidates(spark, sf_dir).select("release_id", "norm", "category", target.alias("target"), "first_seen", "last_seen", "appearances")


def locked(spark, sf_dir):
    kept = candidates(spark, sf_dir).where((F.col("release_id") == "src0") & (F.length("norm") % 2 == 0))
    return kept.groupBy("norm", "category").agg(F.min(capitals(F.substring("norm", 1, 6))).alias("target"))


def shingles(spark, sf_dir):
    """Pairs of neighbouring capitalised words as idiom candidates."""
    m = A.mentions(spark, sf_dir)
    b = m.select(F.col("release_id").alias("br"), F.col("chapter_number").alias("bc"), (F.col("row_index") - 1).alias("bi"), F.col("norm").alias("second"))
    two = m.join(b, (F.col("release_id") == F.col("br")) & (F.col("chapter_number") == F.col("bc")) & (F.col("row_index") == F.col("bi")))
    norm = F.concat("norm", F.lit(" "), "second")
    meaning = F.when(F.col("row_index") % 7 == 0, "").otherwise(F.col("category"))
    return two.groupBy("release_id", norm.alias("norm"), meaning.alias("meaning")).agg(
        F.lower(F.min("release_id")).alias("rendering0"), F.min("chapter_number").alias("first_seen"), F.max("chapter_number").alias("last_seen"), F.count(F.lit(1)).alias("appearances")
    ).select("norm", "meaning", F.concat(F.lit("r-"), F.substring("norm", 1, 2)).alias("rendering"), "first_seen", "last_seen", "appearances", F.concat_ws(":", "release_id", "norm", "meaning").alias("candidate_id"))


SHINGLES = f"""{W}, sh0 AS (SELECT a.release_id, a.norm || ' ' || b.norm AS norm, CASE WHEN a.row_index % 7 = 0 THEN '' ELSE a.category END AS meaning, a.chapter_number
    FROM mentions a JOIN mentions b ON a.release_id = b.release_id AND a.chapter_number = b.chapter_number AND b.row_index = a.row_index + 1),
  sh AS (SELECT norm, meaning, 'r-' || left(norm, 2) AS rendering, min(chapter_number) AS first_seen, max(chapter_number) AS last_seen, count(*) AS appearances, release_id || ':' || norm || ':' || meaning AS candidate_id FROM sh0 GROUP BY release_id, norm, meaning)"""


def old_policies(spark, sf_dir):
    return shingles(spark, sf_dir).where(F.col("norm") < "c").groupBy("norm").agg(F.min(F.when(F.length("candidate_id") % 2 == 0, F.upper("rendering")).otherwise(F.lit("other"))).alias("rendering"), F.sum("appearances").alias("appearances"))


OLD = "old AS (SELECT norm, min(CASE WHEN length(candidate_id) % 2 = 0 THEN upper(rendering) ELSE 'other' END) AS rendering, sum(appearances) AS appearances FROM sh WHERE norm < 'c' GROUP BY 1)"


def payloads(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    item = lambda t, k, c, o: F.struct(t.alias("source_term"), k.alias("entity_type"), c.alias("confidence"), o.alias("lore"))
    kinds = F.element_at(F.array(F.lit("person"), F.lit("place"), F.lit("bogus")), (F.col("doc_id") % 3 + 1).cast("int"))
    listed = F.array(item(F.col("source"), kinds, F.when(F.col("doc_id") % 2 == 0, F.lit("0.9")).otherwise(F.lit("high")), F.lit(" lore ")), item(F.lit("  "), F.lit("person"), F.lit("1"), F.lit("")), item(F.concat(F.lit(" "), F.col("lang")), F.lit("place"), F.lit("0.25"), F.lit("  ")))
    return d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(listed.alias("entities")))).alias("payload"))


def overrides(spark, sf_dir):
    labels = A.table(spark, sf_dir, "labels")
    action = F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 0, "edit").otherwise("keep")
    added = labels.where("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("add").alias("action"), F.lit("new").alias("new_value"))
    return labels.select("doc_id", action.alias("action"), F.concat(F.lit("edited-"), F.col("doc_id").cast("string")).alias("new_value")).unionByName(added)


def upsert(spark, sf_dir):
    m = A.mentions(spark, sf_dir)
    side = lambda f, s, t: ops.merged_candidates(m.where(f)).withColumns({"status": F.lit(s), "translation": t})
    return ops.upserted_candidates(side("chapter_number % 2 = 0", "translated", F.when(F.length("norm") % 3 == 0, capitals(F.col("norm")))), side("chapter_number % 2 = 1", "discovered", F.lower("norm")))


def asked(spark, sf_dir):
    return A.mentions(spark, sf_dir).select("norm", "category").distinct()


def idiom_upsert(spark, sf_dir):
    s = shingles(spark, sf_dir)
    rules = {"meaning": "coalesce_existing", "rendering": "incoming", "first_seen": "min", "last_seen": "max", "appearances": "sum"}
    return ops.merge_latest(s.where("meaning = 'en'"), s.where("meaning <> 'en'"), ["norm"], rules, arrival=["candidate_id"])


def critic(spark, sf_dir):
    v = A.table(spark, sf_dir, "embeddings")
    return ops.pruned(v.where("vec_id >= 50"), v.where("vec_id < 50"), 0.5)


def ch(f, *views):
    return lambda spark, sf_dir: f(A.chapters(spark, sf_dir), *(v(spark) for v in views))


def bl(f, *views):
    return lambda spark, sf_dir: f(A.blocks(spark, sf_dir), *(v(spark) for v in views))


#: The tables' words in letters of another script, as source terms are.
_ROMAN, _SCRIPT = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26))
_OTHER = f"translate(lower({{}}), '{_ROMAN}', '{_SCRIPT}')"


def admission(s: SparkSession, d: str) -> DataFrame:
    other = lambda c: F.translate(F.lower(c), _ROMAN, _SCRIPT)
    more = F.when(F.col("row_index") % 5 == 0, "7").when(F.col("row_index") % 7 == 0, "zq").otherwise("")
    return ops.admitted(A.mentions(s, d).withColumn("source_term", F.concat(other("source_term"), more)), A.chapters(s, d).withColumn("text", other("text")))


def staged(spark, sf_dir):
    """Candidates at every stage of their curation."""
    n = F.length("norm")
    status = F.when(n % 4 == 0, "discovered").when(n % 4 == 1, "filtered").when(n % 4 == 2, "translated").otherwise("promoted")
    translation = F.when(n % 3 == 0, F.col("norm")).when(n % 3 == 1, "")
    return candidates(spark, sf_dir).select(*ops.KEY, "first_seen", status.alias("status"), translation.alias("translation"), translation.alias("rendering"))


STAGED = f"""{CAND}, st AS (SELECT release_id, norm, category, first_seen, ['discovered', 'filtered', 'translated', 'promoted'][length(norm) % 4 + 1] AS status, CASE length(norm) % 3 WHEN 0 THEN norm WHEN 1 THEN '' END AS translation FROM cand)
  SELECT release_id, norm, category, first_seen FROM st WHERE"""


def stage(plan):
    return lambda s, d: plan(staged(s, d)).select(*ops.KEY, "first_seen")


def marked(spark, sf_dir):
    """Candidates whose terms are locked are promoted, with their target."""
    lock = locked(spark, sf_dir).select("norm", "category", F.lit("promoted").alias("status"), F.col("target").alias("translation"))
    return ops.with_updates(staged(spark, sf_dir).drop("rendering", "first_seen"), lock, ["norm", "category"], ["status", "translation"])


PLANS = {
    "pending_translation": (stage(ops.untranslated), f"{STAGED} coalesce(translation, '') = ''"),
    "promotable_candidates": (stage(ops.promotable), f"{STAGED} translation <> '' AND status <> 'promoted'"),
    "review_candidates": (stage(ops.in_review), f"{STAGED} status = 'translated'"),
    "idiom_pending": (stage(ops.untranslated_idioms), f"{STAGED} coalesce(translation, '') = '' AND status = 'discovered'"),
    "alias_language": (lambda s, d: A.mentions(s, d).select("release_id", "chapter_number", "row_index", ops.alias_language(F.when(F.col("row_index") % 3 == 0, F.translate("norm", _ROMAN, _SCRIPT)).when(F.col("row_index") % 3 == 1, F.col("norm")).otherwise(F.lit("…"))).alias("language")), f"{W} SELECT release_id, chapter_number, row_index, CASE WHEN row_index % 3 = 0 AND regexp_matches(norm, '[a-z]') THEN 'zh' WHEN row_index % 3 = 1 AND regexp_matches(norm, '[a-z]') THEN 'en' ELSE 'zh' END AS language FROM mentions"),
    "status_updates": (marked, f"""{TARGETED} SELECT c.release_id, c.norm, c.category, CASE WHEN l.target IS NOT NULL THEN 'promoted' ELSE ['discovered', 'filtered', 'translated', 'promoted'][length(c.norm) % 4 + 1] END AS status,
      CASE WHEN l.target IS NOT NULL THEN l.target WHEN length(c.norm) % 3 = 0 THEN c.norm WHEN length(c.norm) % 3 = 1 THEN '' END AS translation FROM cand c LEFT JOIN locked l ON l.norm = c.norm AND l.category = c.category"""),
    "candidate_merge": (candidates, f"{CAND} SELECT * FROM cand"),
    "candidate_filter": (lambda s, d: ops.filtered_candidates(candidates(s, d), dates=(*T.DATES, "[A-Za-z]{5}"), stoplist=(*T.STOPLIST, "Ththe", "Ereine", "Eauleau", "Osque")).select("release_id", "norm", "category", "status", "reason"),
      f"""{CAND}, r AS (SELECT *, regexp_full_match(source_term, '[A-Za-z]{{5}}') AS a, source_term IN ('Ththe', 'Ereine', 'Eauleau', 'Osque') AS b FROM cand)
      SELECT release_id, norm, category, CASE WHEN a OR b THEN 'filtered' ELSE 'discovered' END AS status, CASE WHEN a AND b THEN 'deterministic_filter: date_pattern|stop_list' WHEN a THEN 'deterministic_filter: date_pattern' WHEN b THEN 'deterministic_filter: stop_list' END AS reason FROM r"""),
    "candidate_upsert": (upsert, f"""{W}, s AS (SELECT release_id, norm, category, chapter_number % 2 AS odd, min(chapter_number) AS f, max(chapter_number) AS l, count(*) AS n, arg_max(source_term, CAST(chapter_number AS BIGINT) * 1000000 + row_index) AS t FROM mentions GROUP BY 1, 2, 3, 4)
      SELECT release_id, norm, category, min(f) AS first_seen, max(l) AS last_seen, CAST(sum(n) AS BIGINT) AS appearances, arg_max(t, odd) AS source_term,
        coalesce(CASE WHEN min(odd) = 0 AND length(norm) % 3 = 0 THEN upper(replace(norm, 'ß', 's')) END, CASE WHEN max(odd) = 1 THEN norm END) AS translation, CASE WHEN max(odd) = 1 THEN 'discovered' ELSE 'translated' END AS status FROM s GROUP BY 1, 2, 3"""),
    "candidates_per_chapter": (lambda s, d: candidates(s, d).groupBy("release_id", "first_seen").agg(F.count(F.lit(1)).alias("n")), f"{CAND} SELECT release_id, first_seen, count(*) AS n FROM cand GROUP BY 1, 2"),
    "duplicate_targets": (lambda s, d: ops.duplicate_targets(targeted(s, d)), f"{TARGETED} SELECT category, target, count(DISTINCT norm) AS n_sources, min(norm) AS first_source FROM tc GROUP BY 1, 2 HAVING count(DISTINCT norm) > 1"),
    "glossary_conflicts": (lambda s, d: ops.conflicts(targeted(s, d).select(*ops.KEY, "target"), locked(s, d)), f"{CONFLICTS} SELECT * FROM con"),
    "conflict_reasons": (lambda s, d: ops.conflict_reasons(ops.conflicts(targeted(s, d).select(*ops.KEY, "target"), locked(s, d))), f"{CONFLICTS} SELECT release_id, norm, category, target, string_agg(reason, ' | ' ORDER BY reason) AS reasons FROM con GROUP BY 1, 2, 3, 4"),
    "glossary_promotions": (lambda s, d: ops.promotions(targeted(s, d).select(*ops.KEY, "target"), locked(s, d)), f"""{CONFLICTS} SELECT release_id, norm, category, target, 'glex_' || left(sha256(release_id || ':' || category || ':' || norm || ':' || lower(target)), 24) AS entry_id
      FROM tc WHERE NOT EXISTS (SELECT 1 FROM con WHERE con.release_id = tc.release_id AND con.norm = tc.norm AND con.category = tc.category)"""),
    "glossary_subset": (ch(ops.glossary_subset, A.glossary), f"""WITH {A.CHAPTERS}, {A.GLOSSARY_CTE} SELECT release_id, chapter_number, source_term, category, CAST(greatest(1, (length(text) - length(replace(text, source_term, ''))) // length(source_term)) AS INTEGER) AS n FROM chapters JOIN glossary ON contains(text, source_term)"""),
    "idiom_match": (ch(ops.idiom_matches, A.idioms), f"""WITH {A.CHAPTERS}, {A.IDIOMS_CTE} SELECT release_id, chapter_number, source_text, rendering, CAST(row_number() OVER (PARTITION BY release_id, chapter_number ORDER BY length(source_text) DESC, trim(source_text)) AS INTEGER) AS rank FROM chapters JOIN idioms ON contains(text, source_text)"""),
    "bundle_matches": (bl(ops.bundle_matches, A.glossary, A.idioms), f"""WITH {A.BLOCKS}, {A.GLOSSARY_CTE}, {A.IDIOMS_CTE}, t AS (SELECT doc_id, block_id, string_agg(source_term, '|' ORDER BY source_term) AS terms FROM blocks JOIN glossary ON contains(block_text, source_term) GROUP BY 1, 2),
      i AS (SELECT doc_id, block_id, string_agg(source_text, '|' ORDER BY source_text) AS idioms FROM blocks JOIN idioms ON contains(block_text, source_text) GROUP BY 1, 2)
      SELECT doc_id, block_id, coalesce(terms, '') AS terms, coalesce(i.idioms, '') AS idioms FROM t FULL JOIN i USING (doc_id, block_id)"""),
    "alias_precedence": (bl(ops.alias_precedence, A.aliases, A.glossary, A.idioms), f"""WITH {A.BLOCKS}, {A.GLOSSARY_CTE}, {A.IDIOMS_CTE}, {A.ALIASES_CTE}, taken AS (SELECT doc_id, block_id, trim(source_term) AS norm FROM blocks JOIN glossary ON contains(block_text, source_term) UNION SELECT doc_id, block_id, trim(source_text) FROM blocks JOIN idioms ON contains(block_text, source_text))
      SELECT doc_id, block_id, alias_text, entity_id FROM blocks b JOIN aliases a ON contains(block_text, alias_text) WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = b.doc_id AND t.block_id = b.block_id AND t.norm = trim(alias_text))"""),
    "term_resolution": (lambda s, d: ops.resolved_terms(asked(s, d), locked(s, d)), f"{TARGETED} SELECT DISTINCT m.norm, m.category, coalesce(l.target, m.norm) AS resolved, l.target IS NOT NULL AS is_locked FROM mentions m LEFT JOIN locked l ON l.norm = m.norm AND l.category = m.category"),
    "review_overrides": (lambda s, d: ops.reviewed(A.table(s, d, "documents").select("doc_id", "source"), overrides(s, d), "doc_id", "source"), """WITH o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 0 THEN 'edit' ELSE 'keep' END AS action, 'edited-' || doc_id AS new_value FROM labels)
      SELECT d.doc_id, CASE WHEN action = 'edit' THEN new_value ELSE source END AS source, coalesce(action, 'none') AS action FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id WHERE action IS NULL OR action <> 'delete'
      UNION ALL SELECT -doc_id - 1, 'new', 'add' FROM labels WHERE doc_id % 50 = 0"""),
    "idiom_policy_validation": (lambda s, d: ops.idiom_policies(shingles(s, d), old_policies(s, d)), f"""{SHINGLES}, {OLD}, g AS (SELECT norm, count(DISTINCT nullif(trim(meaning), '')) AS nm, count(DISTINCT nullif(trim(rendering), '')) AS nr, min(CASE WHEN trim(meaning) <> '' THEN meaning END) AS am,
        min(rendering) AS rendering, min(first_seen) AS first_seen, max(last_seen) AS last_seen, sum(appearances) AS appearances FROM sh GROUP BY 1)
      SELECT g.norm, CASE WHEN nm > 1 OR nr > 1 THEN 'duplicate_conflict' WHEN g.norm = '' THEN 'empty_source' WHEN am IS NULL THEN 'missing_field' WHEN old.rendering IS NOT NULL AND lower(old.rendering) <> lower(g.rendering) THEN 'canon_conflict' ELSE 'promoted' END AS decision,
        coalesce(old.rendering, g.rendering) AS rendering, first_seen, last_seen, CAST(g.appearances + coalesce(old.appearances, 0) AS BIGINT) AS appearances FROM g LEFT JOIN old ON old.norm = g.norm"""),
    "idiom_upsert": (idiom_upsert, f"""{SHINGLES}, t AS (SELECT *, CASE WHEN meaning = 'en' THEN 0 ELSE 1 END AS side FROM sh)
      SELECT norm, arg_min(meaning, side || ':' || candidate_id) AS meaning, arg_max(rendering, side || ':' || candidate_id) AS rendering, min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(appearances) AS BIGINT) AS appearances FROM t GROUP BY 1"""),
    "deferred_entities": (lambda s, d: ops.deferred_entities(A.mentions(s, d), locked(s, d)), f"""{TARGETED} SELECT release_id, norm, category, min(chapter_number) AS source_chapter, max(chapter_number) AS last_seen, count(*) AS appearances, arg_min(source_term, CAST(chapter_number AS BIGINT) * 1000000 + row_index) AS term_text
      FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM locked l WHERE l.norm = m.norm AND l.category = m.category) GROUP BY 1, 2, 3"""),
    "deferred_resolution": (lambda s, d: ops.deferred_resolution(candidates(s, d), locked(s, d)), f"{TARGETED} SELECT release_id, norm, category, l.target AS target_term, 'promoted' AS status FROM tc JOIN locked l USING (norm, category)"),
    "entity_admission": (admission, f"""{W}, x AS (SELECT release_id, chapter_number, row_index, {_OTHER.format('source_term')} || CASE WHEN row_index % 5 = 0 THEN '7' WHEN row_index % 7 = 0 THEN 'zq' ELSE '' END AS source_term FROM mentions)
      SELECT release_id, chapter_number, row_index, source_term, CASE WHEN regexp_matches(source_term, '[A-Za-z]') THEN 'forbidden_letter' WHEN NOT contains({_OTHER.format('text')}, source_term) THEN 'not_in_chapter' ELSE 'admitted' END AS verdict FROM x JOIN chapters USING (release_id, chapter_number)"""),
    "llm_payload_parse": (lambda s, d: ops.parsed_payloads(payloads(s, d), "payload", ("person", "place")), """SELECT doc_id, row_index, source_term, entity_type, confidence, lore FROM (
        SELECT doc_id, 0 AS row_index, source AS source_term, CASE doc_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'place' ELSE 'bogus' END AS entity_type, CASE WHEN doc_id % 2 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence, 'lore' AS lore FROM documents WHERE doc_id % 5 <> 0
        UNION ALL SELECT doc_id, 2, lang, 'place', CAST(0.25 AS DOUBLE), NULL FROM documents WHERE doc_id % 5 <> 0) WHERE entity_type <> 'bogus'"""),
    "critic_prune": (critic, """SELECT vec_id, round(1 - best, 4) AS critic_score, 1 - best < 0.5 AS pruned FROM (SELECT c.vec_id, max(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))) AS best FROM embeddings c JOIN embeddings r ON c.vec_id >= 50 AND r.vec_id < 50 GROUP BY 1)"""),
    "pronoun_counts": (lambda s, d: A.table(s, d, "documents").select("doc_id", T.pronoun_count(F.col("text")).alias("n")), f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN {T.PRONOUNS})) AS INTEGER) AS n FROM documents"""),
}
