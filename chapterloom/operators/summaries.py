"""Chapter texts, running summaries and their lineage, and what summaries must not say."""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Bytes that a task of `lineage_hash` hashes, and parts of a release at most: each part reads the hashes of those before it.
HASHED, PARTS = 4 << 30, 256
#: Chapter hashes of a block; twice as many are split.
BLOCK = 512


def chapter_text(blocks: DataFrame) -> DataFrame:
    """Stripped, placeholder-free, non-empty blocks of a chapter joined by line breaks, in order."""
    clean = blocks.withColumn("clean", F.trim(T.without_placeholders(F.col("block_text")))).where("clean <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_order", "clean"))), lambda b: b["clean"])
    out = clean.groupBy("release_id", "chapter_number", "doc_id").agg(F.array_join(ordered, "\n").alias("text"))
    return out.select("release_id", "chapter_number", "doc_id", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


def chapter_metadata(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("release_id", "chapter_number").agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("block_text").alias("distinct_blocks"))


def short_summaries(chapters: DataFrame, length: int = 80) -> DataFrame:
    return chapters.select("release_id", "chapter_number", F.substring(F.regexp_replace("text", "\n", " "), 1, length).alias("content"), "chapter_hash")


def _by_release():
    return Window.partitionBy("release_id").orderBy("chapter_number")


def previous_three(shorts: DataFrame) -> DataFrame:
    """The summaries of the three rows before, whatever their numbers."""
    w = _by_release().rowsBetween(-3, -1)
    return shorts.select("release_id", "chapter_number", F.array_join(F.collect_list("content").over(w), "|").alias("previous"))


def story_so_far(shorts: DataFrame, every: int = 1) -> DataFrame:
    """Length and hash of the running text of all summaries up to a chapter. A release is read once, in order: its chapters
    share one running hash, and the text itself is never built."""
    line = F.concat(F.lit("第"), F.col("chapter_number").cast("string"), F.lit("章："), F.col("content"))
    lines = shorts.where("content <> ''").select("release_id", "chapter_number", F.length(line).alias("n"), F.encode(line, "utf-8").alias("line"))
    ordered = lines.repartition("release_id").sortWithinPartitions("release_id", "chapter_number", "line")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release, state, chars = _NONE, hashlib.sha256(), 0
        for batch in batches:
            lengths, hashes = [], []
            for key, n, line in zip(*(batch.column(c).to_pylist() for c in ("release_id", "n", "line")), strict=True):
                if key != release:
                    release, state, chars = key, hashlib.sha256(), -1
                if line is not None:  # a line without a number is none
                    state.update(line if chars < 0 else b"\n" + line)
                    chars += n + 1
                lengths.append(max(chars, 0))
                hashes.append(state.copy().hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("release_id"), batch.column("chapter_number"), pa.array(lengths, pa.int32()), pa.array(hashes, pa.string())], names=["release_id", "chapter_number", "n_chars", "story_hash"])

    out = ordered.mapInArrow(told, shorts.select("release_id", "chapter_number").schema.add("n_chars", "integer").add("story_hash", "string"))
    return out if every == 1 else out.where(F.col("chapter_number") % every == 0)


#: Before the first release: a key that none has.
_NONE = object()


class _Lineage:
    """A growing sorted set of byte strings, and SHA-256 over all of it joined by bars. It lies in blocks, each with the state
    of the hash before it, so what lies before a new member is not hashed again."""

    def __init__(self, ordered: list[bytes]):
        self.blocks = [ordered[i : i + BLOCK] for i in range(0, len(ordered), BLOCK)] or [[]]
        self.lows = [b[0] if b else b"" for b in self.blocks]
        self.joined = [b"|".join(b) + b"|" for b in self.blocks]
        self.states = [hashlib.sha256()] + [None] * (len(self.blocks) - 1)
        self.valid = 0  # the last block whose state holds

    def add(self, member: bytes) -> None:
        at = max(0, bisect_right(self.lows, member) - 1)
        block = self.blocks[at]
        insort(block, member)
        self.lows[at] = block[0]
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.lows.insert(at + 1, block[BLOCK])
            self.joined.insert(at + 1, b"|".join(block[BLOCK:]) + b"|")
            self.states.insert(at + 1, None)
            block = self.blocks[at]
        self.joined[at] = b"|".join(block) + b"|"
        self.valid = min(self.valid, at)

    def digest(self) -> str:
        state = self.states[self.valid].copy()
        for i in range(self.valid, len(self.joined) - 1):
            state.update(self.joined[i])
            self.states[i + 1] = state.copy()
        self.valid = len(self.joined) - 1
        state.update(memoryview(self.joined[-1])[:-1])
        return state.hexdigest()


def lineage_hash(shorts: DataFrame) -> DataFrame:
    """SHA-256 over the sorted distinct chapter hashes up to a chapter.

    Chapters that bring no new hash have the lineage of the one before. Each new one is hashed from its place in the order
    on, on average half of the set, so a release costs a quarter of the square of its distinct hashes (65 bytes each): the
    hash of a changed text cannot be had for less. A release is cut into parts of about equal work; each part starts from the
    sorted hashes before it, which is all that a task holds.
    """
    same = Window.partitionBy("release_id", "chapter_hash").orderBy("chapter_number")
    order = Window.partitionBy("release_id").orderBy("chapter_number", "chapter_hash")  # equal rows count as one
    rows = shorts.select("release_id", "chapter_number", "chapter_hash")
    new = F.col("chapter_hash").isNotNull() & (F.row_number().over(same) == 1)
    rows = rows.withColumn("new", new).withColumn("known", F.sum(F.col("new").cast("long")).over(order))
    rows = rows.withColumn("all", F.max("known").over(Window.partitionBy("release_id")))
    work = F.col("all") * F.col("all") * 65 / 4
    parts = F.least(F.ceil(work / HASHED) + 1, F.lit(PARTS))
    part = F.floor(F.col("known") * F.col("known") / (F.col("all") * F.col("all") + 1) * parts)
    rows = rows.withColumns({"own": part.cast("int"), "last": (parts - 1).cast("int")})
    held = F.when(F.col("new"), F.sequence("own", "last")).otherwise(F.array("own"))
    dealt = rows.select("release_id", "chapter_number", F.col("chapter_hash").cast("binary").alias("hash"), "new", "known", "own", F.explode(held).alias("part"))
    dealt = dealt.withColumn("here", F.col("own") == F.col("part")).drop("own")
    # Of a part first the hashes before it, by value; then its own chapters, by number of hashes known, the new one first.
    ranks = (F.when(F.col("here"), F.col("known")), F.when(~F.col("here"), F.col("hash")), ~F.col("new"))
    n = max(int(shorts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64)
    dealt = dealt.repartition(n, "release_id", "part").sortWithinPartitions("release_id", "part", "here", *ranks)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before, lineage, current = (_NONE, 0), [], None, ""
        for batch in batches:
            found = []
            for release, part, here, fresh, member in zip(*(batch.column(c).to_pylist() for c in ("release_id", "part", "here", "new", "hash")), strict=True):
                if (release, part) != group:
                    group, before, lineage = (release, part), [], None
                if not here:
                    before.append(member)
                    continue
                if lineage is None:
                    lineage, before = _Lineage(before), []
                    current = lineage.digest() if not fresh else ""
                if fresh:
                    lineage.add(member)
                    current = lineage.digest()
                found.append(current)
            own = batch.filter(batch.column("here"))
            yield pa.RecordBatch.from_arrays([own.column("release_id"), own.column("chapter_number"), pa.array(found, pa.string())], names=["release_id", "chapter_number", "lineage"])

    return dealt.mapInArrow(hashed, shorts.select("release_id", "chapter_number").schema.add("lineage", "string"))


def story_chapters(chapters: DataFrame, not_story: DataFrame) -> DataFrame:
    return chapters.join(not_story.select("doc_id"), "doc_id", "left_anti").select("release_id", "chapter_number", "doc_id")


def story_guardrail(chapters: DataFrame, flags: DataFrame, most: int = 500) -> DataFrame:
    """A chapter flagged as no story is one all the same if it is long; without a flag it is one."""
    f = flags.select(F.col("doc_id").alias("f_id"), "is_story")
    out = chapters.join(f, F.col("doc_id") == F.col("f_id"), "left")
    return out.select("doc_id", (F.coalesce("is_story", F.lit(True)) | (F.length("text") > most)).alias("is_story"))


def chapter_exclusion(chapters: DataFrame, path: str, patterns: tuple[str, ...]) -> DataFrame:
    return chapters.where(~F.col(path).rlike("|".join(f"(?:{p})" for p in patterns))).select("doc_id", path)


def future_knowledge(texts: DataFrame, text: str, chapter: str) -> DataFrame:
    """Mentions of chapters beyond a text's own, in either language."""
    zh = F.regexp_extract_all(F.col(text), F.lit(r"第\s*(\d+)\s*章"), F.lit(1))
    en = F.regexp_extract_all(F.lower(text), F.lit(r"\bchapter\s+(\d+)\b"), F.lit(1))
    numbers = F.transform(F.concat(zh, en), lambda n: n.try_cast("int"))
    return texts.withColumn("ahead", F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n > F.col(chapter))))).where(F.size("ahead") > 0)


#: The fields of a structured summary.
REQUIRED = ("chapter_number", "characters_mentioned", "key_events", "new_terms", "relationships_changed", "setting", "tone", "narrative_progression", "is_story_chapter")


def schema_errors(rows: DataFrame, payload: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """What a structured summary lacks; complete ones are checked for types."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    kind = F.when(F.get_json_object(payload, "$.chapter_number").try_cast("int").isNull(), "chapter_number: not an integer")
    lists = F.when(~F.coalesce(F.get_json_object(payload, "$.key_events").startswith("["), F.lit(False)), "key_events: not a list")
    errors = F.when(F.size(missing) > 0, F.transform(missing, lambda m: F.concat(F.lit("missing: "), m))).otherwise(F.array_compact(F.array(kind, lists)))
    return rows.select(*(c for c in rows.columns if c != payload), F.array_join(errors, "; ").alias("errors"))


def validated_summaries(rows: DataFrame, payload: str, chapter: str) -> DataFrame:
    """Status and errors of structured summaries (JSON objects): fields that are missing, else fields of the wrong type or
    without content; then chapters beyond the summary's own that any of its texts mentions, each number once, ascending;
    before all of them the flag of a chapter that is no story. A payload that is no object lacks every field."""
    # As variants: a value's type is its JSON type, which paths and casts of strings do not tell.
    v = F.try_parse_json(F.col(payload))
    kind = lambda e: F.coalesce(F.schema_of_variant(e), F.lit("NONE"))
    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    text = lambda e: F.when(kind(e) == "STRING", F.try_variant_get(e, "$", "string"))
    lacks = lambda e: F.coalesce(T.is_blank(text(e)), F.lit(True))
    wrong = lambda condition, message: F.when(condition, F.lit(message))
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, sorted(REQUIRED))), keys)
    number = field("chapter_number")
    whole = kind(number) == "BIGINT"
    items = lambda e: F.try_variant_get(e, "$", "array<variant>")
    strings = lambda e: F.coalesce(F.forall(items(e), lambda x: kind(x) == "STRING"), F.lit(False))
    changed, story = field("relationships_changed"), field("is_story_chapter")

    def relationship(item: Column, index: Column) -> Column:
        place = F.concat(F.lit("schema_invalid: relationships_changed["), index.cast("string"))
        part = lambda name: F.when(lacks(F.try_variant_get(item, f"$.{name}", "variant")), F.concat(place, F.lit(f"].{name} must be a non-empty string")))
        return F.when(kind(item).startswith("OBJECT"), F.array(part("entity"), part("change"))).otherwise(F.array(F.concat(place, F.lit("] must be an object")), F.lit(None).cast("string")))

    nested = F.when(items(changed).isNull(), F.array(F.lit("schema_invalid: relationships_changed must be a list"))).otherwise(F.flatten(F.transform(items(changed), relationship)))
    typed = F.concat(
        F.array(
            F.when(~whole, "schema_invalid: chapter_number must be an integer").when(F.try_variant_get(number, "$", "bigint") != F.col(chapter), "continuity_conflict: chapter_number does not match extracted chapter number"),
            *(wrong(~strings(field(c)), f"schema_invalid: {c} must be a list of strings") for c in ("characters_mentioned", "key_events", "new_terms")),
        ),
        nested,
        F.array(*(wrong(lacks(field(c)), f"schema_invalid: {c} must be a non-empty string") for c in ("setting", "tone", "narrative_progression")), wrong(kind(story) != "BOOLEAN", "schema_invalid: is_story_chapter must be a boolean")),
    )
    schema = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("schema_invalid: missing fields: "), F.array_join(missing, ", ")))).otherwise(typed)

    def said(e: Column) -> Column:
        """The texts of a field: itself, its items, the values of items that are objects."""
        inner = lambda x: F.when(kind(x) == "STRING", F.array(text(x))).otherwise(F.filter(F.transform(F.coalesce(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), F.array().cast("array<variant>")), text), lambda t: t.isNotNull()))
        return F.when(kind(e) == "STRING", F.array(text(e))).otherwise(F.coalesce(F.flatten(F.transform(items(e), inner)), F.array().cast("array<string>")))

    values = F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<variant>"))
    texts = F.flatten(F.transform(values, said))
    found = F.flatten(F.transform(texts, lambda t: F.concat(F.regexp_extract_all(t, F.lit(r"第\s*(\d+)\s*章"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"(?i)\bchapter\s+(\d+)\b"), F.lit(1)))))
    ahead = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x > F.col(chapter))))
    future = F.transform(ahead, lambda x: F.concat(F.lit("future_knowledge: references chapter "), x.cast("string"), F.lit(" while validating chapter "), F.col(chapter).cast("string")))
    flag = F.array(F.when((kind(story) == "BOOLEAN") & ~F.try_variant_get(story, "$", "boolean"), "non_story_chapter_flagged"))
    errors = F.array_compact(F.concat(flag, schema, future))
    return rows.select(chapter, F.when(F.size(errors) > 0, "failed").otherwise("success").alias("status"), F.array_join(errors, "; ").alias("errors"))


def chunk_combine(chunks: DataFrame) -> DataFrame:
    """Summaries of a chapter's parts made one: ordered union of terms, first setting, joined text, story if any is."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "terms", "setting", "narrative")))
    agg = chunks.groupBy("doc_id").agg(ordered.alias("o"), F.bool_or("is_story").alias("is_story"))
    terms = F.array_distinct(F.flatten(F.transform("o", lambda x: x["terms"])))
    return agg.select("doc_id", F.array_join(terms, "|").alias("terms"), F.coalesce(F.try_element_at(F.filter(F.transform("o", lambda x: x["setting"]), lambda s: s.isNotNull() & (s != "")), F.lit(1)), F.lit("")).alias("setting"), F.array_join(F.transform("o", lambda x: x["narrative"]), " ").alias("narrative"), "is_story")


def segment_reassembly(segments: DataFrame) -> DataFrame:
    """Segments of a block put together in order: the final text, else the restored, else the draft."""
    best = F.coalesce("final_text", "restored_text", "draft_text", F.lit(""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("segment_order"), best.alias("t")))), lambda s: s["t"])
    return segments.groupBy("doc_id", "block_id").agg(F.array_join(ordered, "").alias("text"))


def prior_segments(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "block_id").orderBy("segment_order").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select("doc_id", "block_id", "segment_order", F.array_join(F.collect_list("draft_text").over(w), "\n").alias("prior"))


def order_regressions(rows: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Rows whose value is below that of the row before."""
    w = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous")).select(*keys, position, value, "previous")
