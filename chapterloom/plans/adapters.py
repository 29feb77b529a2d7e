"""Views that render the driver's generic tables in the schemas of the engine, and the same views as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAGES = ("preprocess-glossary", "preprocess-graph", "packets-build", "translate-chapter")
SUFFIXES = {
    "error": ("failed", "validation_failed", "risk_detected", "paragraph_retry"),
    "click": ("paragraph_completed", "term_found", "paragraph_skipped"),
    "view": ("paragraph_started", "entity_extracted", "retry"),
    "purchase": ("chapter_completed", "completed", "artifact_written"),
    "signup": ("chapter_started", "started", "chapter_skipped"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracking_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_us, run_id, release_id, stage_name, chapter_number, block_id, severity, event_type, k, score."""
    return as_tracking(table(spark, sf_dir, "events"))


def as_tracking(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), k % 4 + 1)
    suffix = F.lit(None)
    for source, names in SUFFIXES.items():
        suffix = F.when(kind == source, F.element_at(F.array(*map(F.lit, names)), k % len(names) + 1)).otherwise(suffix)
    severity = F.when((kind == "error") & (k % 4 == 0), "error").when(kind == "error", "warning").when(k % 17 == 0, "debug").otherwise("info")
    return events.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"),
        F.concat(F.lit("run-"), (F.col("user_id") % 10).cast("string")).alias("run_id"),
        F.concat(F.lit("rel-"), (F.col("user_id") % 3).cast("string")).alias("release_id"),
        stage.alias("stage_name"),
        (k % 20).alias("chapter_number"),
        F.concat(F.lit("blk-"), F.col("user_id").cast("string")).alias("block_id"),
        severity.alias("severity"),
        F.concat(stage, F.lit("."), suffix).alias("event_type"),
        k.alias("k"),
        F.round("value", 2).alias("score"),
    )


def _case(names: tuple[str, ...], by: str) -> str:
    return f"CASE {by} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


TEV = f"""k0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), tev AS (
  SELECT event_id, epoch_us(ts) AS event_us, 'run-' || (user_id % 10) AS run_id, 'rel-' || (user_id % 3) AS release_id,
    {_case(STAGES, 'k')} AS stage_name, k % 20 AS chapter_number, 'blk-' || user_id AS block_id,
    CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'error' WHEN event_type = 'error' THEN 'warning' WHEN k % 17 = 0 THEN 'debug' ELSE 'info' END AS severity,
    {_case(STAGES, 'k')} || '.' || CASE event_type {' '.join(f"WHEN '{s}' THEN {_case(n, 'k')}" for s, n in SUFFIXES.items())} END AS event_type,
    k, round(value, 2) AS score
  FROM k0)"""


def number(release: str, by: str) -> Column:
    return F.row_number().over(Window.partitionBy(release).orderBy(by))


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, doc_id, text, lang, chapter_hash of documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("release_id"), "doc_id", "text", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("chapter_hash"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, chapter_number, doc_id, text, lang, chapter_hash: documents numbered in their source."""
    return unnumbered(spark, sf_dir).select("release_id", number("release_id", "doc_id").alias("chapter_number"), "doc_id", "text", "lang", "chapter_hash")


CHAPTERS = """chapters AS (
  SELECT source AS release_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS chapter_number, doc_id, text, lang, sha256(text) AS chapter_hash
  FROM documents)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, chapter_number, doc_id, block_order (from 1), block_id, block_text: the non-blank lines of chapters."""
    return as_blocks(chapters(spark, sf_dir))


def as_blocks(chaptered: DataFrame) -> DataFrame:
    lines = chaptered.select("release_id", "chapter_number", "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "block_text"))
    block_id = F.format_string("ch%03d_blk%03d", F.col("chapter_number"), F.col("pos") + 1)
    return lines.where(F.trim("block_text") != "").select("release_id", "chapter_number", "doc_id", "lang", (F.col("pos") + 1).alias("block_order"), block_id.alias("block_id"), "block_text")


BLOCKS = (
    CHAPTERS
    + """, lines AS (SELECT release_id, chapter_number, doc_id, lang, unnest(string_split(text, chr(10))) AS block_text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM chapters),
blocks AS (SELECT release_id, chapter_number, doc_id, lang, CAST(pos AS INTEGER) AS block_order, printf('ch%03d_blk%03d', chapter_number, pos) AS block_id, block_text FROM lines WHERE trim(block_text, ' ') <> '')"""
)

#: The locked glossary of the tests, (source term, target term, category, language).
GLOSSARY = (
    ("the", "THE", "character", "en"),
    ("tion", "TION", "faction", "en"),
    ("ing ", "ING", "location", "en"),
    ("wh", "WH", "technique", "en"),
    ("eau", "EAU", "character", "fr"),
    ("ment", "MENT", "location", "fr"),
    ("elle", "ELLE", "faction", "fr"),
    ("èr", "ER", "technique", "fr"),
    ("ung", "UNG", "character", "de"),
    ("keit", "KEIT", "faction", "de"),
    ("lich", "LICH", "location", "de"),
    ("ß", "SS", "technique", "de"),
    ("ción", "CION", "character", "es"),
    ("mente", "MENTE", "faction", "es"),
    ("ez", "EZ", "location", "es"),
    ("ñ", "NY", "technique", "es"),
)
IDIOMS = (("of the", "OF-THE"), ("and the", "AND-THE"), ("de la", "DE-LA"), ("der ", "DER"), ("que ", "QUE"), ("en de", "EN-DE"))
ALIASES = (("the", "ent-1"), ("onan", "ent-2"), ("erer", "ent-3"), ("of the", "ent-4"), ("menta", "ent-5"), ("esch", "ent-6"), ("ando", "ent-7"))


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GLOSSARY), "source_term string, target_term string, category string, lang string")


def idioms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(IDIOMS), "source_text string, rendering string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES), "alias_text string, entity_id string")


def _values(rows: tuple, columns: str, name: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows) + ")"


GLOSSARY_CTE = _values(GLOSSARY, "source_term, target_term, category, glang", "glossary")
IDIOMS_CTE = _values(IDIOMS, "source_text, rendering", "idioms")
ALIASES_CTE = _values(ALIASES, "alias_text, entity_id", "aliases")

MENTION = r"\p{Lu}\p{Ll}{4,}"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, chapter_number, row_index, source_term, norm, category: capitalised words of chapters, in order."""
    found = chapters(spark, sf_dir).select("release_id", "chapter_number", F.col("lang").alias("category"), F.posexplode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("pos", "source_term"))
    return found.select("release_id", "chapter_number", (F.col("pos") + 1).alias("row_index"), "source_term", F.lower("source_term").alias("norm"), "category")


MENTIONS = (
    CHAPTERS
    + r""", m0 AS (SELECT release_id, chapter_number, lang AS category, regexp_extract_all(text, '\p{Lu}\p{Ll}{4,}') AS found FROM chapters),
mentions AS (SELECT release_id, chapter_number, CAST(generate_subscripts(found, 1) AS INTEGER) AS row_index, unnest(found) AS source_term, lower(unnest(found)) AS norm, category FROM m0)"""
)

EDGE_TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def month(column: Column) -> Column:
    """Chapter of an order: months since January 1995, from 1."""
    return (12 * (F.year(column) - 1995) + F.month(column)).cast("int")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_type, source_id, target_id, chapter_number, lore_text, is_masked, confidence: one for each order, of its first supplier."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    first = items.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("masked"), F.max("l_discount").alias("confidence"))
    joined = orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.col("o_orderpriority").alias("edge_type"),
        F.concat(F.lit("ent_c"), (F.col("o_custkey") % 200).cast("string")).alias("source_id"),
        F.concat(F.lit("ent_s"), (F.col("supp") % 40).cast("string")).alias("target_id"),
        month(F.col("o_orderdate")).alias("chapter_number"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("lore "), F.col("o_orderkey").cast("string"))).alias("lore_text"),
        (F.col("masked") == 1).alias("is_masked"),
        F.col("confidence"),
        F.col("o_orderkey").alias("row_index"),
    )


OBSERVATIONS = """obs AS (
  SELECT o_orderpriority AS edge_type, 'ent_c' || (o_custkey % 200) AS source_id, 'ent_s' || (supp % 40) AS target_id,
    CAST(12 * (year(o_orderdate) - 1995) + month(o_orderdate) AS INTEGER) AS chapter_number,
    CASE WHEN o_orderkey % 3 = 0 THEN 'lore ' || o_orderkey END AS lore_text, masked = 1 AS is_masked, confidence, o_orderkey AS row_index
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS supp, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS masked, max(l_discount) AS confidence FROM lineitem GROUP BY 1) f ON o_orderkey = l_orderkey)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source_text, output_text: each user turn and the assistant turn after it."""
    talk = table(spark, sf_dir, "conversations")
    a, b = talk.where("role = 'user'"), talk.where("role = 'assistant'")
    b = b.select(F.col("conv_id").alias("b_conv"), (F.col("turn") - 1).alias("b_turn"), F.col("text").alias("output_text"))
    return a.join(b, (F.col("conv_id") == F.col("b_conv")) & (F.col("turn") == F.col("b_turn"))).select("conv_id", "turn", F.col("text").alias("source_text"), "output_text")


PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS source_text, b.text AS output_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
