"""Queries over packets and text quality, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..operators import glossary as gops
from ..operators import packets as ops
from ..operators import quality as q
from . import adapters as A
from . import glossary as G
from . import narrative as N

B = f"WITH {A.BLOCKS}"
TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 8) END"
COST = "CAST(ceil((" + TOKENS + ") * 105 / 100) AS BIGINT)"
BUDGET = 260
PLACE = "⟦/?[A-Z]+_[0-9]+⟧"


def docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


def shares(text, parts):
    """A text divided among `parts` in order, evenly by characters: nothing is left out."""
    n = F.length(text)
    edge = lambda i: F.floor(n * i / len(parts)).cast("int")
    return {p: F.substring(text, edge(i) + 1, edge(i + 1) - edge(i)) for i, p in enumerate(parts)}


def _shares(text, parts):
    edge = lambda i: f"length({text}) * {i} // {len(parts)}"
    return {p: f"substring({text}, {edge(i)} + 1, {edge(i + 1)} - {edge(i)})" for i, p in enumerate(parts)}


SECTIONS = (*ops.FIXED, *(c for own in ops.DEGRADE.values() for c in own))
#: Sections that some documents lack: they are empty where doc_id is divisible by the number.
LACKING = {"previous_three": 3, "aliases": 2, "warnings": 5}


def sections(spark, sf_dir):
    """A document's whole text divided among the sections of its packet."""
    cut = shares(F.col("text"), SECTIONS)
    return docs(spark, sf_dir).select("doc_id", *(F.when(F.col("doc_id") % LACKING[c] == 0, "").otherwise(e).alias(c) if c in LACKING else e.alias(c) for c, e in cut.items()))


def _budget_sql():
    cut = _shares("text", SECTIONS)
    columns = ", ".join(f"CASE WHEN doc_id % {LACKING[c]} = 0 THEN '' ELSE {e} END AS {c}" if c in LACKING else f"{e} AS {c}" for c, e in cut.items())
    sql = f"WITH s AS (SELECT doc_id, {columns} FROM documents), t0 AS (SELECT *, {' + '.join(COST.format(n) for n in SECTIONS)} AS before, '' AS lost0 FROM s)"
    left, lost, prev = "before", "lost0", "t0"
    for i, (key, own) in enumerate(ops.DEGRADE.items()):
        go = f"{left} > {BUDGET} AND regexp_replace({own[0]}, '[\\s\\p{{Z}}]+', '', 'g') <> ''"
        rest = f"{left} - " + " - ".join(f"({COST.format(c)} - 2)" for c in own)
        sql += f", t{i + 1} AS (SELECT *, CASE WHEN {go} THEN {rest} ELSE {left} END AS left{i}, CASE WHEN {go} THEN {lost} || '|{key}' ELSE {lost} END AS lost{i + 1} FROM {prev})"
        left, lost, prev = f"left{i}", f"lost{i + 1}", f"t{i + 1}"
    return f"{sql} SELECT doc_id, before, {left} AS after, ltrim({lost}, '|') AS degraded, {left} <= {BUDGET} AS fits FROM {prev}"


PARTS = ("glossary", "relationships", "aliases", "continuity", "evidence")


def bundles(spark, sf_dir):
    """A block's whole text divided among the parts of its bundle."""
    cut = shares(F.regexp_replace("block_text", r'["\\\x00-\x1f]', ""), PARTS)
    return A.blocks(spark, sf_dir).select("doc_id", "block_id", *(e.alias(c) for c, e in cut.items()))


TRIM = ("relationships", "aliases", "continuity", "evidence")


BUNDLED = f"""{B}, plain AS (SELECT doc_id, block_id, block_order, regexp_replace(block_text, '["\\\\\\x00-\\x1f]', '', 'g') AS plain FROM blocks), bundles AS (SELECT doc_id, block_id, block_order, {", ".join(f"{e} AS {c}" for c, e in _shares("plain", PARTS).items())} FROM plain)"""


def _trim_sql():
    sql = f"{BUNDLED}, s0 AS (SELECT *, '' AS names FROM bundles)"
    size = "strlen('{\"aliases\":\"' || aliases || '\",\"continuity\":\"' || continuity || '\",\"evidence\":\"' || evidence || '\",\"glossary\":\"' || glossary || '\",\"relationships\":\"' || relationships || '\"}')"
    for i, c in enumerate(TRIM):
        over = f"({size} > 256)"
        sql += f", s{i + 1} AS (SELECT * REPLACE (CASE WHEN {over} THEN '' ELSE {c} END AS {c}, CASE WHEN {over} THEN names || '|{c}' ELSE names END AS names) FROM s{i})"
    return f"{sql} SELECT doc_id, block_id, CAST({size} AS INTEGER) AS size_bytes, ltrim(names, '|') AS trimmed, {size} <= 256 AS kept FROM s{len(TRIM)}"


def prompt_rows(spark, sf_dir):
    return gops.contained_terms(A.blocks(spark, sf_dir).select("doc_id", "block_id", "block_text"), A.glossary(spark), "block_text", "source_term")


def hashes(spark, sf_dir):
    h = lambda c: F.sha2(c.cast("binary"), 256)
    return docs(spark, sf_dir).select("doc_id", h(F.col("text")).alias("source_hash"), h(F.col("lang")).alias("glossary_hash"), h(F.col("source")).alias("summary_hash"))


def built(spark, sf_dir):
    old = lambda c, n: F.when(F.col("doc_id") % n == 0, "old").otherwise(F.col(c)).alias(c)
    return hashes(spark, sf_dir).where("doc_id % 7 <> 0").select("doc_id", old("source_hash", 5), old("glossary_hash", 6), old("summary_hash", 4))


def versions(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("chapter"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("built_us"), F.concat(F.lit("pkt_"), F.col("o_orderkey").cast("string")).alias("packet_id"))


def cache(spark, sf_dir):
    d = docs(spark, sf_dir).where("doc_id % 3 <> 0").groupBy("source", "lang").agg(F.max("doc_id").alias("m"))
    return d.select(T.surrogate("", F.col("source"), F.col("lang")).alias("identity"), F.when(F.col("m") % 2 == 0, F.lit('{"ok":1}')).otherwise(F.lit("oops")).alias("value"))


def cache_asks(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", T.surrogate("", F.col("source"), lang).alias("identity"))


def checkpoints(spark, sf_dir):
    d = hashes(spark, sf_dir).where("doc_id % 5 <> 0")
    return d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("source_hash")).alias("source_hash"), F.lit("v1").alias("prompt_version"), F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("success").alias("status"))


def tiers(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("span"), (F.col("l_partkey") % 7 + 1).alias("tier"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("candidate"))


def outputs(spark, sf_dir):
    b = A.blocks(spark, sf_dir)
    more = b.where("block_order = 1 AND doc_id % 4 = 0").select("doc_id", F.lit(1000000).alias("block_order"), F.lit("extra").alias("out_text"))
    kept = b.where("doc_id % 6 <> 0 OR block_order < 3").select("doc_id", "block_order", F.when(F.col("block_order") % 5 == 0, "").otherwise(F.col("block_text")).alias("out_text"))
    return kept.unionByName(more)


def third_pass(spark, sf_dir):
    return A.blocks(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", "block_id", F.when((F.col("doc_id") % 4 == 0) & (F.col("block_order") % 2 == 1), F.col("block_text")).alias("final_output"))


def talk(spark, sf_dir):
    """Conversation pairs with placeholders put in."""
    p = A.pairs(spark, sf_dir)
    n = F.col("conv_id")
    return p.select(
        "conv_id",
        "turn",
        F.when(n % 3 == 0, F.concat(F.lit("⟦B_1⟧"), "source_text", F.lit("⟦/B_1⟧"))).otherwise(F.col("source_text")).alias("source_text"),
        F.when(n % 6 == 0, F.concat(F.lit("⟦B_1⟧"), "output_text", F.lit("⟦/B_1⟧"))).when(n % 5 == 0, F.concat("output_text", F.lit("⟦I_2⟧"))).when(n % 11 == 0, F.lit("  ")).when(n % 13 == 0, F.col("source_text")).otherwise(F.col("output_text")).alias("pass2"),
    )


TALK = f"""WITH {A.PAIRS}, talk AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '⟦B_1⟧' || source_text || '⟦/B_1⟧' ELSE source_text END AS source_text,
  CASE WHEN conv_id % 6 = 0 THEN '⟦B_1⟧' || output_text || '⟦/B_1⟧' WHEN conv_id % 5 = 0 THEN output_text || '⟦I_2⟧' WHEN conv_id % 11 = 0 THEN '  ' WHEN conv_id % 13 = 0 THEN source_text ELSE output_text END AS pass2 FROM pairs),
  polished AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN replace(pass2, 'the', 'a') WHEN conv_id % 7 = 0 THEN '' ELSE pass2 END AS pass3, (conv_id % 10) / 10.0 AS risk FROM talk)"""


def polished(spark, sf_dir):
    n = F.col("conv_id")
    third = F.when(n % 4 == 0, F.replace("pass2", F.lit("the"), F.lit("a"))).when(n % 7 == 0, "").otherwise(F.col("pass2"))
    return talk(spark, sf_dir).withColumns({"pass3": third, "risk": (n % 10) / 10.0})


TERMS = ("the", "tion")
_LOST = " || ".join(f"CASE WHEN contains(pass2, '{t}') AND NOT contains(pass3, '{t}') THEN '|drift:{t}' ELSE '' END" for t in TERMS)
_INTEGRITY = f"""CASE WHEN trim(pass3) = '' THEN 'empty' ELSE ltrim(CASE WHEN regexp_extract_all(source_text, '{PLACE}') <> regexp_extract_all(pass3, '{PLACE}') THEN '|placeholder_source' ELSE '' END
  || CASE WHEN regexp_extract_all(pass2, '{PLACE}') <> regexp_extract_all(pass3, '{PLACE}') THEN '|placeholder_pass2' ELSE '' END || {_LOST}, '|') END"""


def risks(spark, sf_dir):
    d = docs(spark, sf_dir)
    n = F.col("doc_id")
    score = q.risk_score(idioms=n % 5, titles=n % 4, reveal=(n % 2), pronouns=T.pronoun_count(F.col("text")), placeholders=n % 8, entities=n % 6)
    return d.select("doc_id", F.round(score, 6).alias("score"), q.risk_class(F.round(score, 6)).alias("risk_class"))


_PRON = f"len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN {T.PRONOUNS}))"


def verdicts(spark, sf_dir):
    n = F.col("doc_id")
    v = F.when(n % 4 == 0, '{"fidelity_errors_found":true,"corrected_text":"fixed"}').when(n % 4 == 1, '{"fidelity_errors_found":false,"corrected_text":"no"}').when(n % 4 == 2, '{"fidelity_errors_found":true,"corrected_text":""}').otherwise("bad json")
    return docs(spark, sf_dir).select("doc_id", v.alias("verdict"), F.col("lang").alias("draft"))


def golden(spark, sf_dir):
    """Documents that hold a whole benchmark text, with that text. Both sides meet at the longest word of the benchmark text
    (as a rule its rarest), by ids alone; then the texts are compared."""
    split = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[^ ]+"), F.lit(0)))
    # Words at either end may go on in the document.
    inner = F.expr("slice(regexp_extract_all(text, '[^ ]+', 0), 2, greatest(size(regexp_extract_all(text, '[^ ]+', 0)) - 2, 0))")
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(-F.length(w), w.alias("w")))), 1)["w"]
    bench = A.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected"), longest.alias("key"))
    texts = docs(spark, sf_dir).select("doc_id", "text")
    places = texts.select("doc_id", F.explode(split(F.col("text"))).alias("key")).join(bench.select("item_id", "key"), "key").select("doc_id", "item_id")
    found = places.join(texts, "doc_id").join(bench.select("item_id", "expected"), "item_id")
    return found.where(F.col("text").contains(F.col("expected"))).select("doc_id", "item_id", "expected", "text")


def benchmark_scores(spark, sf_dir):
    g = golden(spark, sf_dir)
    return g.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(q.terminology(F.col("text"), ("the", "en", "zu"))), 4).alias("terminology"), F.round(F.avg(F.length("text")), 4).alias("chars"))


def packet_overview(spark, sf_dir):
    """Per chapter: its place, what of the glossary and of the idioms it holds, the summaries before it and its hash."""
    c = A.chapters(spark, sf_dir)
    terms = gops.glossary_subset(c, A.glossary(spark)).groupBy("release_id", "chapter_number").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("occurrences"))
    idioms = gops.idiom_matches(c, A.idioms(spark)).groupBy("release_id", "chapter_number").agg(F.max(F.when(F.col("rank") == 1, F.col("source_text"))).alias("first_idiom"))
    before = N.ops.previous_three(N.shorts(spark, sf_dir))
    keys = ["release_id", "chapter_number"]
    out = c.select(*keys, "doc_id", "chapter_hash").join(terms, keys, "left").join(idioms, keys, "left").join(before, keys, "left")
    return out.select(*keys, "doc_id", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"), F.coalesce("first_idiom", F.lit("")).alias("first_idiom"), F.length("previous").alias("previous_chars"), F.concat(F.lit("pkt_"), F.substring("chapter_hash", 1, 24)).alias("packet_id"))


OVERVIEW = f"""WITH {A.CHAPTERS}, {A.GLOSSARY_CTE}, {A.IDIOMS_CTE}, t AS (SELECT release_id, chapter_number, count(*) AS terms, CAST(sum(greatest(1, (length(text) - length(replace(text, source_term, ''))) // length(source_term))) AS BIGINT) AS occurrences FROM chapters JOIN glossary ON contains(text, source_term) GROUP BY 1, 2),
  i AS (SELECT release_id, chapter_number, source_text AS first_idiom FROM chapters JOIN idioms ON contains(text, source_text) QUALIFY row_number() OVER (PARTITION BY release_id, chapter_number ORDER BY length(source_text) DESC, trim(source_text)) = 1),
  p AS (SELECT release_id, chapter_number, coalesce(string_agg(left(replace(text, chr(10), ' '), 80), '|') OVER (PARTITION BY release_id ORDER BY chapter_number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS previous FROM chapters)
  SELECT c.release_id, c.chapter_number, c.doc_id, coalesce(terms, 0) AS terms, coalesce(occurrences, 0) AS occurrences, coalesce(first_idiom, '') AS first_idiom, CAST(length(previous) AS INTEGER) AS previous_chars, 'pkt_' || left(chapter_hash, 24) AS packet_id
  FROM chapters c LEFT JOIN t USING (release_id, chapter_number) LEFT JOIN i USING (release_id, chapter_number) LEFT JOIN p USING (release_id, chapter_number)"""
_WORDS = "list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda w: w <> '')"
_SENTENCES = "list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_replace(s, '[\\s\\p{Z}]+', '', 'g') <> '')"

#: Endings that make URLs paths of artifacts of every kind.
ARTIFACTS = ("/runs/r1/translation/out.json", "/runs/r1", "/library.db", "/releases", "/extracted", "/Glossary/c.json", "/summaries", "/idioms", "/graph", "/packets", "/.cache/x", "")
ENDS = "CASE page_id % " + str(len(ARTIFACTS)) + " " + " ".join(f"WHEN {i} THEN '{e.lower()}'" for i, e in enumerate(ARTIFACTS)) + " END"


def artifacts(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, ARTIFACTS)), (F.col("page_id") % len(ARTIFACTS) + 1).cast("int"))
    return A.table(spark, sf_dir, "pages").select("page_id", ops.artifact_category(F.concat("url", end)).alias("category"))


PLANS = {
    "chapter_packet_overview": (packet_overview, OVERVIEW),
    "packet_budget": (lambda s, d: ops.budgeted(sections(s, d), BUDGET), _budget_sql()),
    "bundle_trim": (lambda s, d: ops.trimmed(bundles(s, d), TRIM, 256), _trim_sql()),
    "block_bundles": (lambda s, d: ops.with_bundles(A.blocks(s, d), bundles(s, d).where("glossary LIKE '%a%'"), PARTS), f"{BUNDLED} SELECT doc_id, block_id, glossary LIKE '%a%' AS has_bundle, {', '.join(f"CASE WHEN glossary LIKE '%a%' THEN {c} ELSE '' END AS {c}" for c in PARTS)} FROM bundles"),
    "artifact_categories": (artifacts, f"""SELECT page_id, CASE WHEN p LIKE '%/runs/%' AND p LIKE '%translation%' THEN 'Translation output' WHEN p LIKE '%/runs/%' THEN 'Run directory' WHEN p LIKE '%.db%' THEN 'Global database' WHEN p LIKE '%/releases' THEN 'All releases'
      {" ".join(f"WHEN contains(p, '{k}') THEN '{v}'" for k, v in ops.CATEGORIES)} ELSE 'Other' END AS category FROM (SELECT page_id, lower(url) || {ENDS} AS p FROM pages)"""),
    "bundle_prompt": (lambda s, d: ops.prompts(prompt_rows(s, d)), f"{B}, {A.GLOSSARY_CTE} SELECT doc_id, block_id, string_agg(source_term || ' → ' || target_term || ' (' || category || ')', chr(10) ORDER BY source_term || ' → ' || target_term || ' (' || category || ')') AS prompt FROM blocks JOIN glossary ON contains(block_text, source_term) GROUP BY 1, 2"),
    "budget_check": (lambda s, d: docs(s, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"), (T.token_count(F.col("text")) <= 500).alias("within")), f"SELECT doc_id, CAST({TOKENS.format('text')} AS BIGINT) AS tokens, {TOKENS.format('text')} <= 500 AS within FROM documents"),
    "prompt_chunks": (lambda s, d: ops.chunked(docs(s, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), 1000), None),
    "stale_packets": (lambda s, d: ops.stale(hashes(s, d), built(s, d), ("source_hash", "glossary_hash", "summary_hash")), """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing_packet_metadata' ELSE ltrim(CASE WHEN doc_id % 5 = 0 THEN '|source_hash_changed' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN '|glossary_hash_changed' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '|summary_hash_changed' ELSE '' END, '|') END AS reasons
      FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 6 = 0 OR doc_id % 4 = 0"""),
    "packet_status_counts": (lambda s, d: ops.stale(hashes(s, d), built(s, d), ("source_hash",)).groupBy(F.col("reasons").alias("status")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing_packet_metadata' ELSE 'source_hash_changed' END AS status, count(*) AS n FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 GROUP BY 1"),
    "latest_packet": (lambda s, d: ops.latest(versions(s, d), "chapter", ("built_us", "packet_id"), "packet_id"), "SELECT o_custkey % 300 AS chapter, arg_max('pkt_' || o_orderkey, epoch_us(o_orderdate) || ':' || 'pkt_' || o_orderkey) AS packet_id, count(*) AS versions FROM orders GROUP BY 1"),
    "latest_snapshot": (lambda s, d: ops.latest(versions(s, d).withColumn("one", F.lit("all")), "one", ("built_us", "packet_id"), "packet_id"), "SELECT 'all' AS one, (SELECT 'pkt_' || o_orderkey FROM orders ORDER BY o_orderdate DESC, 'pkt_' || o_orderkey DESC LIMIT 1) AS packet_id, count(*) AS versions FROM orders"),
    "version_hashes": (lambda s, d: ops.version_hashes(G.targeted(s, d).withColumn("nothing", F.lit(None).cast("string")), "release_id", ("norm", "category", "target", "nothing")), f"""{G.TARGETED} SELECT release_id, sha256(string_agg('{{"category":"' || category || '","norm":"' || norm || '","nothing":null,"target":"' || target || '"}}', ',' ORDER BY '{{"category":"' || category || '","norm":"' || norm || '","nothing":null,"target":"' || target || '"}}')) AS hash FROM tc GROUP BY 1"""),
    "cache_lookup": (lambda s, d: ops.cache_lookup(cache_asks(s, d), cache(s, d)), """WITH c AS (SELECT source, lang, CASE WHEN max(doc_id) % 2 = 0 THEN '{"ok":1}' ELSE 'oops' END AS value FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2)
      SELECT d.doc_id, CASE WHEN value LIKE '{%' THEN 'hit' WHEN value IS NOT NULL THEN 'regenerate' ELSE 'miss' END AS outcome, CASE WHEN value LIKE '{%' THEN value END AS value FROM documents d LEFT JOIN c ON c.source = d.source AND c.lang = d.lang AND d.doc_id % 10 <> 0"""),
    "checkpoint_pending": (lambda s, d: ops.pending(hashes(s, d).withColumn("prompt_version", F.when(F.col("doc_id") % 13 == 0, "v2").otherwise("v1")), checkpoints(s, d)), "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'v2' ELSE 'v1' END AS prompt_version FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0"),
    "retrieval_precedence": (lambda s, d: ops.precedence(tiers(s, d)), "SELECT l_orderkey AS doc_id, l_linenumber % 2 AS span, l_partkey % 7 + 1 AS tier, 'c' || l_suppkey AS candidate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_partkey % 7, 'c' || l_suppkey) = 1"),
    "block_alignment": (lambda s, d: ops.aligned(A.blocks(s, d), outputs(s, d)), f"""{B}, o AS (SELECT doc_id, block_order, CASE WHEN block_order % 5 = 0 THEN '' ELSE block_text END AS out_text FROM blocks WHERE doc_id % 6 <> 0 OR block_order < 3 UNION ALL SELECT doc_id, 1000000, 'extra' FROM blocks WHERE block_order = 1 AND doc_id % 4 = 0),
      a AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_order) AS INTEGER) AS n, block_id FROM blocks), b AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_order) AS INTEGER) AS n, out_text FROM o)
      SELECT doc_id, n, block_id, CASE WHEN block_id IS NULL THEN 'unmapped_block' WHEN out_text IS NULL OR out_text = '' THEN 'missing_translation' ELSE 'mapped' END AS state FROM a FULL JOIN b USING (doc_id, n)"""),
    "final_blocks": (lambda s, d: ops.final_blocks(A.blocks(s, d), third_pass(s, d)), f"{B}, t AS (SELECT doc_id, block_id FROM blocks WHERE doc_id % 4 = 0 AND block_order % 2 = 1) SELECT doc_id, block_id, 'pass3' AS pass FROM t UNION ALL SELECT doc_id, block_id, 'pass2' FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM t)"),
    "cleanup_plan_rows": (lambda s, d: ops.cleanup_plan(A.tracking_events(s, d), {"run": "run_id = 'run-1'", "translation": "stage_name = 'translate-chapter'", "preprocess": "stage_name LIKE 'preprocess-%'", "all": "true"}), f"WITH {A.TEV} SELECT 'run' AS scope, count(*) AS rows FROM tev WHERE run_id = 'run-1' UNION ALL SELECT 'translation', count(*) FROM tev WHERE stage_name = 'translate-chapter' UNION ALL SELECT 'preprocess', count(*) FROM tev WHERE stage_name LIKE 'preprocess-%' UNION ALL SELECT 'all', count(*) FROM tev"),
    "paragraph_risk": (risks, f"""WITH r AS (SELECT doc_id, round(least(1.0, least(1.0, (doc_id % 5) / 3.0) * 0.20 + least(1.0, (doc_id % 4) / 3.0) * 0.15 + (doc_id % 2) * 0.20 + least(1.0, {_PRON} / 2.0) * 0.20 + least(1.0, (doc_id % 8) / 5.0) * 0.15 + least(1.0, (doc_id % 6) / 4.0) * 0.10), 6) AS score FROM documents)
      SELECT doc_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_class FROM r"""),
    "structure_validation": (lambda s, d: q.structure(talk(s, d), "source_text", "pass2"), f"""{TALK} SELECT conv_id, turn, ltrim(CASE WHEN trim(pass2) = '' THEN '|empty' ELSE '' END || CASE WHEN regexp_extract_all(source_text, '{PLACE}') <> regexp_extract_all(pass2, '{PLACE}') THEN '|placeholder_mismatch' ELSE '' END, '|') AS errors,
      CASE WHEN NOT regexp_matches(source_text, '{PLACE}') AND regexp_matches(pass2, '{PLACE}') THEN 'introduced_placeholders' ELSE '' END AS warnings FROM talk"""),
    "fidelity_validation": (lambda s, d: q.basic_fidelity(talk(s, d), "source_text", "pass2"), f"{TALK} SELECT conv_id, turn, CASE WHEN trim(pass2) = '' THEN 'empty' ELSE '' END AS errors, CASE WHEN trim(pass2) = trim(source_text) THEN 'identical' ELSE '' END AS warnings FROM talk"),
    "pass3_integrity": (lambda s, d: q.pass3_integrity(polished(s, d), TERMS), f"{TALK} SELECT conv_id, turn, {_INTEGRITY} AS errors, CASE WHEN trim(pass3) <> '' AND trim(pass3) = trim(source_text) THEN 'identical' ELSE '' END AS warnings FROM polished"),
    "pass_decisions": (lambda s, d: q.pass_decisions(polished(s, d), TERMS, 0.7), f"""{TALK}, x AS (SELECT *, CASE WHEN risk >= 0.7 THEN 'skipped_high_risk' WHEN {_INTEGRITY} = '' THEN 'pass3_accepted' ELSE 'pass3_rejected_integrity_failure' END AS decision FROM polished)
      SELECT conv_id, turn, decision, CAST(length(CASE WHEN decision = 'pass3_accepted' THEN pass3 ELSE pass2 END) AS INTEGER) AS final_chars FROM x"""),
    "validation_rollup": (lambda s, d: q.structure(talk(s, d), "source_text", "pass2").groupBy("conv_id").agg(F.when(F.bool_or(F.col("errors") != ""), "failed").otherwise("success").alias("status"), F.array_join(F.array_sort(F.collect_set(F.nullif("errors", F.lit("")))), ",").alias("flags")), f"""{TALK}, v AS (SELECT conv_id, ltrim(CASE WHEN trim(pass2) = '' THEN '|empty' ELSE '' END || CASE WHEN regexp_extract_all(source_text, '{PLACE}') <> regexp_extract_all(pass2, '{PLACE}') THEN '|placeholder_mismatch' ELSE '' END, '|') AS errors FROM talk)
      SELECT conv_id, CASE WHEN bool_or(errors <> '') THEN 'failed' ELSE 'success' END AS status, coalesce(string_agg(DISTINCT nullif(errors, ''), ',' ORDER BY nullif(errors, '')), '') AS flags FROM v GROUP BY 1"""),
    "pass2_verdict": (lambda s, d: q.pass2_verdict(verdicts(s, d), "verdict", "draft"), "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'fixed' ELSE lang END AS output, doc_id % 4 = 0 AS corrected FROM documents"),
    "readability": (lambda s, d: docs(s, d).select("doc_id", q.readability(F.col("text")).alias("readability")), f"""WITH w AS (SELECT doc_id, len({_WORDS}) AS n, list_sum(list_transform({_WORDS}, lambda x: length(x))) AS chars, len({_SENTENCES}) AS m FROM documents)
      SELECT doc_id, CASE WHEN n = 0 OR m = 0 THEN 0.0 ELSE round((greatest(0.0, 1 - abs(CAST(chars AS DOUBLE) / n - 5) / 5) + greatest(0.0, 1 - abs(CAST(n AS DOUBLE) / m - 17) / 17)) / 2, 4) END AS readability FROM w"""),
    "terminology": (lambda s, d: docs(s, d).select("doc_id", q.terminology(F.col("text"), ("the", "en", "zu")).alias("terminology")), "SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE round((CAST(contains(text, 'the') AS INTEGER) + CAST(contains(text, 'en') AS INTEGER) + CAST(contains(text, 'zu') AS INTEGER)) / 3, 4) END AS terminology FROM documents"),
    "golden_benchmark": (benchmark_scores, "SELECT item_id, count(*) AS n, round(avg(CASE WHEN d.text = '' THEN 0.0 ELSE round((CAST(contains(d.text, 'the') AS INTEGER) + CAST(contains(d.text, 'en') AS INTEGER) + CAST(contains(d.text, 'zu') AS INTEGER)) / 3, 4) END), 4) AS terminology, round(avg(length(d.text)), 4) AS chars FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1"),
    "fidelity": (lambda s, d: talk(s, d).select("conv_id", "turn", udfs.fidelity("source_text", "pass2").alias("fidelity")), None),
    "orphan_placeholders": (lambda s, d: talk(s, d).select("conv_id", "turn", F.array_join(q.orphan_closings(F.concat("pass2", F.when(F.col("conv_id") % 2 == 0, F.lit("⟦/U_3⟧")).otherwise(F.lit("")))), "|").alias("orphans")), f"{TALK} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'U_3' ELSE '' END AS orphans FROM talk"),
}
