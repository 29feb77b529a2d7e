"""Context packets: budgets, trimming, hashes, staleness, caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What a packet over its budget gives up, in this order, and the sections that go with it.
DEGRADE = {
    "broad_continuity": ("previous_three",),
    "fuzzy_candidates": ("aliases",),
    "rerank_depth": ("relationships", "snippets"),
    "pass3": ("identity_notes",),
    "fallback_model": ("warnings",),
}
#: The sections that stay.
FIXED = ("glossary", "story_so_far", "idioms", "entities")


def budgeted(sections: DataFrame, budget: int, fixed: tuple[str, ...] = FIXED, degrade: dict[str, tuple[str, ...]] = DEGRADE, counter: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """Rows with a text column for each section. Every section costs its buffered tokens by `counter`; in order, the next
    step whose first section is not blank empties its sections until the rest fits. An empty section still costs one bracket
    pair. A packet that does not fit after all steps has `fits` false."""
    names = (*fixed, *(c for own in degrade.values() for c in own))
    cost = {c: T.buffered(counter(F.col(c))) for c in names}
    empty = T.buffered(counter(F.lit("[]")))
    total: Column = sum(cost.values(), F.lit(0))
    # A fold over the steps: as a chain of conditions the expression would double with each.
    steps = F.array(*(F.struct(F.lit(key).alias("name"), sum((cost[c] - empty for c in own), F.lit(0)).alias("saved"), (~T.is_blank(F.col(own[0]))).alias("full")) for key, own in degrade.items()))
    start = F.struct(total.cast("long").alias("left"), F.array().cast("array<string>").alias("lost"))

    def step(acc: Column, s: Column) -> Column:
        gone = F.struct((acc["left"] - s["saved"]).alias("left"), F.concat(acc["lost"], F.array(s["name"])).alias("lost"))
        return F.when((acc["left"] > budget) & s["full"], gone).otherwise(acc)

    folded = sections.select("doc_id", total.cast("long").alias("before"), F.aggregate(steps, start, step).alias("f"))
    return folded.select("doc_id", "before", F.col("f.left").alias("after"), F.array_join("f.lost", "|").alias("degraded"), (F.col("f.left") <= budget).alias("fits"))


def trimmed(bundles: DataFrame, order: tuple[str, ...], most: int) -> DataFrame:
    """Sections of a bundle emptied in order until its canonical JSON has at most `most` UTF-8 bytes. Every section that was
    passed is listed, empty ones too."""
    def size(columns: dict[str, Column]) -> Column:
        return F.octet_length(F.to_json(F.struct(*(columns[c].alias(c) for c in sorted(columns)))))

    now, names = {c: F.col(c) for c in bundles.columns if c not in ("doc_id", "block_id")}, F.array().cast("array<string>")
    for c in order:
        over = size(now) > most
        names = F.when(over, F.concat(names, F.array(F.lit(c)))).otherwise(names)
        now = now | {c: F.when(over, F.lit("")).otherwise(now[c])}
    return bundles.select("doc_id", "block_id", size(now).alias("size_bytes"), F.array_join(names, "|").alias("trimmed"), (size(now) <= most).alias("kept"))


def prompts(bundles: DataFrame) -> DataFrame:
    """Matched terms as prompt lines `src → tgt (cat)`."""
    line = F.format_string("%s → %s (%s)", "source_term", "target_term", "category")
    return bundles.groupBy("doc_id", "block_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("prompt"))


def stale(current: DataFrame, built: DataFrame, hashes: tuple[str, ...]) -> DataFrame:
    """Chapters to build anew, with the reasons: hashes that differ, or no packet."""
    old = built.select(F.col("doc_id").alias("b_id"), *(F.col(h).alias(f"b_{h}") for h in hashes))
    joined = current.join(old, F.col("doc_id") == F.col("b_id"), "left")
    reasons = F.when(F.col("b_id").isNull(), F.array(F.lit("missing_packet_metadata"))).otherwise(F.array_compact(F.array(*(F.when(F.col(h) != F.col(f"b_{h}"), F.lit(f"{h}_changed")) for h in hashes))))
    return joined.select("doc_id", F.array_join(reasons, "|").alias("reasons")).where("reasons <> ''")


def latest(rows: DataFrame, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("versions"))


def version_hashes(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Hash of a key's rows in canonical JSON, sorted."""
    line = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ",").cast("binary"), 256).alias("hash"))


def cache_lookup(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Identity hash against a cache table: a hit brings its value if that is usable, a miss is to be generated."""
    side = cache.select(F.col("identity").alias("c_identity"), "value")
    joined = asked.join(side, F.col("identity") == F.col("c_identity"), "left")
    usable = F.coalesce(F.col("value").startswith("{"), F.lit(False))
    return joined.select("doc_id", F.when(usable, "hit").when(F.col("c_identity").isNotNull(), "regenerate").otherwise("miss").alias("outcome"), F.when(usable, F.col("value")).alias("value"))


def pending(chapters: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Chapters without a successful checkpoint of the same source and prompt."""
    done = checkpoints.where("status = 'success'").select("doc_id", "source_hash", "prompt_version")
    return chapters.join(done, ["doc_id", "source_hash", "prompt_version"], "left_anti").select("doc_id", "prompt_version")


def precedence(rows: DataFrame) -> DataFrame:
    """Of the candidates for a span, the one of the highest tier (lowest number), ties to the smaller text."""
    return rows.groupBy("doc_id", "span").agg(F.min(F.struct("tier", "candidate")).alias("m")).select("doc_id", "span", "m.tier", "m.candidate")


def chunked(rows: DataFrame, limit: int) -> DataFrame:
    """Paragraphs packed greedily into prompt chunks of at most `limit` characters, in order, numbered from 1; a paragraph
    keeps the break before it, and one that is too long is cut. Chunks are stripped, empty ones left out."""
    paragraphs = F.regexp_extract_all("text", F.lit(r"(?s)(?:\n{2,})?(?:(?!\n{2,}).)+"), F.lit(0))
    units = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(u) <= limit
        return F.when(fits, F.struct(F.concat(acc["open"], u).alias("open"), acc["out"].alias("out"))).otherwise(F.struct(u.alias("open"), F.concat(acc["out"], F.array(acc["open"])).alias("out")))

    done = F.aggregate(units, start, step, lambda acc: F.concat(acc["out"], F.array(acc["open"])))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    kept = F.filter(F.transform(done, strip), lambda x: x != "")
    return rows.select("doc_id", F.posexplode(kept).alias("pos", "chunk")).select("doc_id", (F.col("pos") + 1).alias("chunk_index"), "chunk")


def cleanup_plan(rows: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """Rows that each cleanup scope would delete; nothing is deleted here."""
    scope = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in scopes.items())))
    return rows.select("event_id", F.explode(scope).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("rows"))


def aligned(source: DataFrame, output: DataFrame) -> DataFrame:
    """The nth block of a document with its nth output: extra outputs are unmapped, missing ones lack a translation."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_order"))
    a, b = source.select("doc_id", n.alias("n"), "block_id"), output.select("doc_id", n.alias("n"), F.col("out_text"))
    state = F.when(F.col("block_id").isNull(), "unmapped_block").when(F.col("out_text").isNull() | (F.col("out_text") == ""), "missing_translation").otherwise("mapped")
    return a.join(b, ["doc_id", "n"], "full").select("doc_id", "n", "block_id", state.alias("state"))


def final_blocks(pass2: DataFrame, pass3: DataFrame) -> DataFrame:
    """Per chapter the blocks of pass 3 if it has any with a final text, else those of pass 2."""
    third = pass3.where("final_output IS NOT NULL")
    have = third.select("doc_id").distinct()
    return third.select("doc_id", "block_id", F.lit("pass3").alias("pass")).unionByName(pass2.join(have, "doc_id", "left_anti").select("doc_id", "block_id", F.lit("pass2").alias("pass")))


def with_bundles(blocks: DataFrame, bundles: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Every block with the parts of its bundle; a block without one has empty parts."""
    b = bundles.select(F.col("doc_id").alias("b_doc"), F.col("block_id").alias("b_block"), *(F.col(p).alias(f"b_{p}") for p in parts))
    joined = blocks.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("block_id") == F.col("b_block")), "left")
    return joined.select("doc_id", "block_id", F.col("b_block").isNotNull().alias("has_bundle"), *(F.coalesce(f"b_{p}", F.lit("")).alias(p) for p in parts))


def artifact_category(path: Column) -> Column:
    """What a path holds, by the first keyword that it contains."""
    low = F.lower(path)
    out = F.when(low.contains("/runs/") & low.contains("translation"), "Translation output").when(low.contains("/runs/"), "Run directory")
    out = out.when(low.contains(DATABASE), "Global database").when(low.rlike("/releases/*$"), "All releases")
    for keyword, category in CATEGORIES:
        out = out.when(low.contains(keyword), category)
    return out.otherwise("Other")


#: The database of all releases, and what the folders of a release hold.
DATABASE = ".db"
CATEGORIES = (
    ("extracted", "Extracted text"),
    ("glossary", "Glossary candidates"),
    ("summaries", "Draft summaries"),
    ("idioms", "Idiom policies"),
    ("graph", "Knowledge graph"),
    ("packets", "Chapter packets"),
    (".cache", "LLM cache"),
)
