"""Curation of terms and idioms: merging mentions, filters, conflicts, promotion, substring joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .merge import merge_latest

KEY = ["release_id", "norm", "category"]


def merged_candidates(mentions: DataFrame) -> DataFrame:
    """One candidate a key: first and last chapter, appearances, and the text of the last mention."""
    arrival = F.struct("chapter_number", "row_index")
    return mentions.groupBy(*KEY).agg(F.min("chapter_number").alias("first_seen"), F.max("chapter_number").alias("last_seen"), F.count(F.lit(1)).alias("appearances"), F.max_by("source_term", arrival).alias("source_term"))


def filtered_candidates(candidates: DataFrame, dates: tuple[str, ...] = T.DATES, stoplist: list[str] | tuple[str, ...] = T.STOPLIST) -> DataFrame:
    """Status and reason of the deterministic filter: whole-term dates, then the stop list."""
    whole = F.col("source_term").rlike("^(?:" + "|".join(dates) + ")$")
    reasons = F.concat_ws("|", F.when(whole, "date_pattern"), F.when(F.col("source_term").isin(*stoplist), "stop_list"))
    return candidates.withColumn("status", F.when(reasons != "", "filtered").otherwise("discovered")).withColumn("reason", F.when(reasons != "", F.concat(F.lit("deterministic_filter: "), reasons)))


def upserted_candidates(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    rules = {"first_seen": "min", "last_seen": "max", "appearances": "sum", "source_term": "incoming", "translation": "coalesce_existing", "status": "incoming"}
    return merge_latest(existing, incoming, KEY, rules)


def duplicate_targets(candidates: DataFrame) -> DataFrame:
    """Targets that stand for several source terms of a category."""
    return candidates.groupBy("category", "target").agg(F.countDistinct("norm").alias("n_sources"), F.min("norm").alias("first_source")).where("n_sources > 1")


def conflicts(candidates: DataFrame, locked: DataFrame) -> DataFrame:
    """One row for each reason against promoting a candidate (release_id, norm, category, target): policy on its text,
    a target shared with other sources, and disagreement with the locked entry of its source or of its target."""
    names = candidates.columns
    dup = duplicate_targets(candidates).select(F.col("category").alias("d_category"), F.col("target").alias("d_target"), "n_sources")
    by_source = locked.select(F.col("category").alias("s_category"), F.col("norm").alias("s_norm"), F.col("target").alias("s_target"))
    by_target = locked.select(F.col("category").alias("t_category"), F.col("target").alias("t_target"), F.col("norm").alias("t_norm"))
    # The locked entries are the authority of a release: small, but only adaptive execution decides whether to broadcast.
    joined = candidates.join(dup, (F.col("category") == F.col("d_category")) & (F.col("target") == F.col("d_target")), "left")
    joined = joined.join(by_source, (F.col("category") == F.col("s_category")) & (F.col("norm") == F.col("s_norm")), "left")
    joined = joined.join(by_target, (F.col("category") == F.col("t_category")) & (F.col("target") == F.col("t_target")), "left")
    reason = lambda condition, kind: F.when(F.coalesce(condition, F.lit(False)), F.lit(kind))
    found = F.array(
        reason(F.col("target") == "", "naming_policy: empty target"),
        reason(F.col("target").rlike(T.PLACEHOLDER), "naming_policy: placeholder in target"),
        reason(F.col("target").rlike(T.CJK), "naming_policy: CJK in target"),
        reason(~F.col("target").rlike("[A-Za-z]"), "naming_policy: no ASCII letter in target"),
        reason(F.col("n_sources") > 1, "duplicate_target"),
        reason(F.col("s_target") != F.col("target"), "canon_conflict: source"),
        reason(F.col("t_norm") != F.col("norm"), "canon_conflict: target"),
    )
    return joined.select(*names, F.explode(F.array_distinct(F.array_compact(found))).alias("reason")).distinct()


def conflict_reasons(found: DataFrame) -> DataFrame:
    keys = [c for c in found.columns if c != "reason"]
    return found.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("reason")), " | ").alias("reasons"))


def promotions(candidates: DataFrame, locked: DataFrame) -> DataFrame:
    """Candidates without a reason against them, with the id of their entry."""
    bad = conflicts(candidates, locked).select(*KEY).distinct()
    kept = candidates.join(bad, KEY, "left_anti")
    return kept.withColumn("entry_id", T.surrogate("glex_", F.col("release_id"), F.col("category"), F.col("norm"), F.lower("target")))


def contained_terms(texts: DataFrame, terms: DataFrame, text: str, term: str, size_bound: int = 10_000) -> DataFrame:
    """Texts and the terms in them: a theta join on containment. Terms are an authority of bounded size, which is checked;
    beyond the bound they are matched through the words that start them (an equality join), then verified."""
    kept = terms.where(F.trim(term) != "")
    if kept.limit(size_bound + 1).count() <= size_bound:
        return texts.join(F.broadcast(kept), F.col(text).contains(F.col(term)))
    gram = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2)))
    keyed = kept.withColumn("gram", F.substring(F.col(term), 1, 2))
    starts = texts.withColumn("gram", F.explode(F.array_distinct(F.concat(gram(F.col(text)), F.transform(F.split(F.col(text), ""), lambda c: c)))))
    return starts.join(keyed, "gram").where(F.col(text).contains(F.col(term))).drop("gram")


def glossary_subset(chapters: DataFrame, glossary: DataFrame) -> DataFrame:
    found = contained_terms(chapters.select("release_id", "chapter_number", "text"), glossary, "text", "source_term")
    return found.select("release_id", "chapter_number", "source_term", "category", T.occurrences(F.col("text"), F.col("source_term")).alias("n"))


def idiom_matches(chapters: DataFrame, idioms: DataFrame) -> DataFrame:
    """Idioms in a chapter, ranked longest first, then by normal form."""
    found = contained_terms(chapters.select("release_id", "chapter_number", "text"), idioms, "text", "source_text")
    rank = F.row_number().over(Window.partitionBy("release_id", "chapter_number").orderBy(F.desc(F.length("source_text")), T.normalise_term(F.col("source_text"))))
    return found.select("release_id", "chapter_number", "source_text", "rendering", rank.alias("rank"))


def bundle_matches(blocks: DataFrame, glossary: DataFrame, idioms: DataFrame) -> DataFrame:
    """Per block, what of both authorities is in it, as joined lists."""
    b = blocks.select("doc_id", "block_id", "block_text")
    terms = contained_terms(b, glossary, "block_text", "source_term").groupBy("doc_id", "block_id").agg(F.array_join(F.array_sort(F.collect_list("source_term")), "|").alias("terms"))
    found = contained_terms(b, idioms, "block_text", "source_text").groupBy("doc_id", "block_id").agg(F.array_join(F.array_sort(F.collect_list("source_text")), "|").alias("idioms"))
    return terms.join(found, ["doc_id", "block_id"], "full").select("doc_id", "block_id", F.coalesce("terms", F.lit("")).alias("terms"), F.coalesce("idioms", F.lit("")).alias("idioms"))


def alias_precedence(blocks: DataFrame, aliases: DataFrame, glossary: DataFrame, idioms: DataFrame) -> DataFrame:
    """Aliases in a block that no glossary term or idiom of that normal form in the same block takes precedence over."""
    b = blocks.select("doc_id", "block_id", "block_text")
    hits = contained_terms(b, aliases, "block_text", "alias_text").select("doc_id", "block_id", "alias_text", "entity_id", T.normalise_term(F.col("alias_text")).alias("norm"))
    taken = contained_terms(b, glossary, "block_text", "source_term").select("doc_id", "block_id", T.normalise_term(F.col("source_term")).alias("norm"))
    taken = taken.unionByName(contained_terms(b, idioms, "block_text", "source_text").select("doc_id", "block_id", T.normalise_term(F.col("source_text")).alias("norm"))).distinct()
    return hits.join(taken, ["doc_id", "block_id", "norm"], "left_anti").select("doc_id", "block_id", "alias_text", "entity_id")


def resolved_terms(asked: DataFrame, locked: DataFrame) -> DataFrame:
    """Exact lookup by normal form and category, else the asked term itself."""
    side = locked.select(F.col("norm").alias("l_norm"), F.col("category").alias("l_category"), F.col("target").alias("l_target"))
    found = asked.join(side, (F.col("norm") == F.col("l_norm")) & (F.col("category") == F.col("l_category")), "left")
    return found.select("norm", "category", F.coalesce("l_target", "norm").alias("resolved"), F.col("l_target").isNotNull().alias("is_locked"))


def reviewed(candidates: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """Human overrides (key, action, new_value): delete drops, edit replaces, add appends, keep and none leave."""
    side = overrides.select(F.col(key).alias("o_key"), "action", "new_value")
    joined = candidates.join(side.where("action <> 'add'"), F.col(key) == F.col("o_key"), "left").where("action IS NULL OR action <> 'delete'")
    kept = joined.select(key, F.when(F.col("action") == "edit", F.col("new_value")).otherwise(F.col(value)).alias(value), F.coalesce("action", F.lit("none")).alias("action"))
    added = side.where("action = 'add'").select(F.col("o_key").alias(key), F.col("new_value").alias(value), "action")
    return kept.unionByName(added)


def idiom_policies(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Per normal form: promote, or the first rule that stands against it, with merged fields. Existing text wins."""
    arrival = F.struct("first_seen", "candidate_id")
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    meaning, rendering = full(F.col("meaning")), full(F.col("rendering"))
    groups = candidates.groupBy("norm").agg(
        F.countDistinct(meaning).alias("n_meanings"),
        F.countDistinct(rendering).alias("n_renderings"),
        F.min_by(meaning, F.when(meaning.isNotNull(), arrival)).alias("meaning"),
        F.min_by(rendering, F.when(rendering.isNotNull(), arrival)).alias("rendering"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("appearances").alias("appearances"),
    )
    old = existing.select(F.col("norm").alias("e_norm"), F.col("rendering").alias("e_rendering"), F.col("appearances").alias("e_appearances"))
    joined = groups.join(old, F.col("norm") == F.col("e_norm"), "left")
    decision = (
        F.when((F.col("n_meanings") > 1) | (F.col("n_renderings") > 1), "duplicate_conflict")
        .when(F.col("norm") == "", "empty_source")
        .when(F.col("meaning").isNull() | F.col("rendering").isNull(), "missing_field")
        .when(F.col("e_rendering").isNotNull() & (F.lower("e_rendering") != F.lower("rendering")), "canon_conflict")
        .otherwise("promoted")
    )
    return joined.select("norm", decision.alias("decision"), F.coalesce("e_rendering", "rendering").alias("rendering"), "first_seen", "last_seen", (F.col("appearances") + F.coalesce("e_appearances", F.lit(0))).alias("appearances"))


def deferred_entities(rows: DataFrame, locked: DataFrame) -> DataFrame:
    """Terms without a locked entry: first and last chapter, and how often they came up."""
    missing = rows.join(locked.select("norm", "category"), ["norm", "category"], "left_anti")
    return missing.groupBy("release_id", "norm", "category").agg(F.min("chapter_number").alias("source_chapter"), F.max("chapter_number").alias("last_seen"), F.count(F.lit(1)).alias("appearances"), F.min_by("source_term", F.struct("chapter_number", "row_index")).alias("term_text"))


def deferred_resolution(deferred: DataFrame, locked: DataFrame) -> DataFrame:
    side = locked.select("norm", "category", F.col("target").alias("target_term"))
    return deferred.join(side, ["norm", "category"]).select("release_id", "norm", "category", "target_term", F.lit("promoted").alias("status"))


#: Fixed value: letters that a source term must not hold.
LATIN = "[A-Za-z]"


def admitted(rows: DataFrame, chapters: DataFrame, forbidden: str = LATIN) -> DataFrame:
    """Entities whose term holds a forbidden letter or is not in the chapter are refused, with the reason."""
    joined = rows.join(chapters.select("release_id", "chapter_number", "text"), ["release_id", "chapter_number"])
    verdict = F.when(F.col("source_term").rlike(forbidden), "forbidden_letter").when(~F.col("text").contains(F.col("source_term")), "not_in_chapter").otherwise("admitted")
    return joined.select("release_id", "chapter_number", "row_index", "source_term", verdict.alias("verdict"))


def parsed_payloads(rows: DataFrame, payload: str, types: tuple[str, ...]) -> DataFrame:
    """Model output (a JSON object with `entities`) made rows: empty terms and unknown types go, confidence is 0.5 by default."""
    schema = "entities array<struct<source_term:string,entity_type:string,confidence:string,lore:string>>"
    items = rows.withColumn("parsed", F.from_json(payload, schema)).select(*(c for c in rows.columns if c != payload), F.posexplode("parsed.entities").alias("row_index", "e"))
    kept = items.where((F.trim("e.source_term") != "") & F.col("e.entity_type").isin(*types))
    return kept.select(*(c for c in rows.columns if c != payload), "row_index", F.trim("e.source_term").alias("source_term"), "e.entity_type", F.coalesce(F.col("e.confidence").try_cast("double"), F.lit(0.5)).alias("confidence"), F.nullif(F.trim("e.lore"), F.lit("")).alias("lore"))


def pruned(vectors: DataFrame, reference: DataFrame, threshold: float) -> DataFrame:
    """Critic: 1 - the highest cosine to any reference vector, rounded; candidates below the threshold are pruned.
    The reference vocabulary is bounded by its caller; vectors are unit length."""
    dot: Column = F.aggregate(F.zip_with("embedding", "r", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = vectors.join(F.broadcast(reference.select(F.col("embedding").alias("r")))).select("vec_id", dot.alias("cos")).groupBy("vec_id").agg(F.max("cos").alias("best"))
    return best.select("vec_id", F.round(1 - F.col("best"), 4).alias("critic_score"), (1 - F.col("best") < threshold).alias("pruned"))


def has_text(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def untranslated(candidates: DataFrame, translation: str = "translation") -> DataFrame:
    """Candidates that wait for a translation, whatever their status: filtered and pruned ones too."""
    return candidates.where(~has_text(translation))


def promotable(candidates: DataFrame) -> DataFrame:
    """Translated candidates that are not promoted yet."""
    return candidates.where(has_text("translation") & (F.col("status") != "promoted"))


def in_review(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("status") == "translated")


def untranslated_idioms(candidates: DataFrame) -> DataFrame:
    """Idioms that wait for a rendering; unlike terms only those just discovered."""
    return untranslated(candidates, "rendering").where(F.col("status") == "discovered")


def alias_language(text: Column) -> Column:
    """zh if any letter is Chinese, else en if any is Latin; zh for all else, empty and null too."""
    return F.when(text.rlike(T.CJK), "zh").when(text.rlike(LATIN), "en").otherwise("zh")


def with_updates(rows: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`columns` set from the update of a row's key (one a key); rows without one stay, updates without a row do nothing."""
    u = updates.select(*(F.col(k).alias(f"u_{k}") for k in keys), F.lit(True).alias("u_hit"), *(F.col(c).alias(f"u_{c}") for c in columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"u_{k}"))
    joined = rows.join(u, same, "left")
    return joined.select(*(F.when(F.col("u_hit"), F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in rows.columns))

