"""Temporal knowledge graph: folding observations to intervals, views as of a chapter, validation.

An interval holds both its ends; a null end is open. `revealed` is a separate axis: a fact shows from that chapter on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def entities(observed: DataFrame) -> DataFrame:
    """entity_id, first_seen, last_seen, revealed (= first seen) of everything that observations name."""
    ends = observed.select(F.col("source_id").alias("entity_id"), "chapter_number").unionByName(observed.select(F.col("target_id").alias("entity_id"), "chapter_number"))
    return ends.groupBy("entity_id").agg(F.min("chapter_number").alias("first_seen"), F.max("chapter_number").alias("last_seen"), F.min("chapter_number").alias("revealed"), F.count(F.lit(1)).alias("mentions"))


def appearances(observed: DataFrame) -> DataFrame:
    """One row an entity and chapter; the first snippet wins."""
    return observed.groupBy(F.col("source_id").alias("entity_id"), "chapter_number").agg(F.min_by("lore_text", F.when(F.col("lore_text").isNotNull(), F.col("row_index"))).alias("snippet"))


def relationship_intervals(observed: DataFrame) -> DataFrame:
    """Observations of (type, source) folded to intervals of one target each.

    Sorted by chapter, then target: an observation of the current target extends it; one of another target in the
    chapter in which the interval started is absorbed; any other closes the interval at the chapter before and opens the
    next. A gap does not close. Lore is the first that is not null, masked any, confidence the highest. The state
    depends on the last decision, so it is a fold over the sorted observations of a key, inside one expression.
    """
    row = F.struct("chapter_number", "target_id", "row_index", "lore_text", "is_masked", "confidence")
    rows = observed.groupBy("edge_type", "source_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "struct<target:string,start:int,stop:int,lore:string,masked:boolean,confidence:double>"
    none = F.struct(F.expr(f"cast(null as {kind})").alias("open"), F.expr(f"cast(array() as array<{kind}>)").alias("done"))

    def interval(target: Column, start: Column, stop: Column, lore: Column, masked: Column, confidence: Column) -> Column:
        return F.struct(target.alias("target"), start.alias("start"), stop.alias("stop"), lore.alias("lore"), masked.alias("masked"), confidence.alias("confidence"))

    def step(acc: Column, r: Column) -> Column:
        o, no_end = acc["open"], F.lit(None).cast("int")
        fresh = interval(r["target_id"], r["chapter_number"], no_end, r["lore_text"], r["is_masked"], r["confidence"].cast("double"))
        wider = interval(o["target"], o["start"], no_end, F.coalesce(o["lore"], r["lore_text"]), o["masked"] | r["is_masked"], F.greatest(o["confidence"], r["confidence"].cast("double")))
        closed = interval(o["target"], o["start"], r["chapter_number"] - 1, o["lore"], o["masked"], o["confidence"])
        same = (o["target"] == r["target_id"]) | (o["start"] == r["chapter_number"])
        return (
            F.when(o.isNull(), F.struct(fresh.alias("open"), acc["done"].alias("done")))
            .when(same, F.struct(wider.alias("open"), acc["done"].alias("done")))
            .otherwise(F.struct(fresh.alias("open"), F.concat(acc["done"], F.array(closed)).alias("done")))
        )

    folded = F.aggregate("rows", none, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    out = rows.select("edge_type", "source_id", F.explode(folded).alias("i"))
    return out.select(
        T.surrogate("rel_", F.lit("r"), F.col("edge_type"), F.col("source_id"), F.col("i.target"), F.col("i.start")).alias("relationship_id"),
        "edge_type",
        "source_id",
        F.col("i.target").alias("target_id"),
        F.col("i.start").alias("start_chapter"),
        F.col("i.stop").alias("end_chapter"),
        F.col("i.start").alias("revealed"),
        F.col("i.lore").alias("lore_text"),
        F.col("i.masked").alias("is_masked"),
        F.col("i.confidence").alias("confidence"),
    )


def visible(chapter: Column) -> Column:
    """A relationship that holds and is revealed in a chapter."""
    return (F.col("start_chapter") <= chapter) & (F.col("end_chapter").isNull() | (F.col("end_chapter") >= chapter)) & (F.col("revealed") <= chapter)


def chapter_view(edges: DataFrame, nodes: DataFrame, chapters: DataFrame) -> DataFrame:
    """For every chapter, the visible relationships whose both ends are seen by then and still later: an interval join on
    the chapter dimension, which is small and bounded by its caller."""
    side = lambda p: nodes.select(F.col("entity_id").alias(f"{p}_id"), F.col("first_seen").alias(f"{p}_first"), F.col("last_seen").alias(f"{p}_last"))
    ends = edges.join(side("a"), F.col("source_id") == F.col("a_id")).join(side("b"), F.col("target_id") == F.col("b_id"))
    n = F.col("n")
    seen = (F.col("a_first") <= n) & (F.col("a_last") >= n) & (F.col("b_first") <= n) & (F.col("b_last") >= n)
    return ends.join(F.broadcast(chapters.select(F.col("chapter_number").alias("n"))), visible(n) & seen).select("n", "relationship_id", "edge_type", "source_id", "target_id")


def safe_subgraph(edges: DataFrame, nodes: DataFrame, chapter: int) -> DataFrame:
    """The looser view of one chapter: ends need only be revealed."""
    if chapter < 1:
        raise ValueError("chapter must be 1 or more")
    known = nodes.where(F.col("revealed") <= chapter).select("entity_id")
    return local_both(edges.where(visible(F.lit(chapter))), known).select("relationship_id", "source_id", "target_id", "edge_type")


def hierarchy_context(edges: DataFrame, chapter: int, types: tuple[str, ...], entity: str | None = None) -> DataFrame:
    out = edges.where(visible(F.lit(chapter)) & F.col("edge_type").isin(*types))
    return (out.where(F.col("source_id") == entity) if entity else out).select("relationship_id", "edge_type", "source_id", "target_id")


def revealed_lore(edges: DataFrame, chapter: int, masked_only: bool = False) -> DataFrame:
    out = edges.where(visible(F.lit(chapter)) & (F.trim("lore_text") != ""))
    return (out.where("is_masked") if masked_only else out).select("relationship_id", "lore_text", "is_masked")


def local_any(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships that touch a set: two semi-joins and a distinct union, as an OR would be a nested loop."""
    a = edges.join(ids.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi")
    b = edges.join(ids.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi")
    return a.unionByName(b).distinct()


def local_both(edges: DataFrame, ids: DataFrame) -> DataFrame:
    out = edges.join(ids.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi")
    return out.join(ids.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi")


def relationship_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    side = lambda p: names.select(F.col("entity_id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    out = edges.join(side("a"), F.col("source_id") == F.col("a_id"), "left").join(side("b"), F.col("target_id") == F.col("b_id"), "left")
    return out.select("relationship_id", F.coalesce("a_name", "source_id").alias("source_name"), F.coalesce("b_name", "target_id").alias("target_name"))


def first_by_name(rows: DataFrame, keys: tuple[str, ...] = ("norm",)) -> DataFrame:
    """Of equal names across categories, the entity that came first."""
    return rows.groupBy(*keys).agg(F.min_by("entity_id", F.struct("chapter_number", "row_index")).alias("entity_id"))


def resolved_relationships(relationships: DataFrame, entities: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Relationships between two names of a release as relationships between entities; those with a name that no entity of the
    release has go."""
    first = first_by_name(entities, ("release_id", "norm"))
    one = lambda side: first.select(F.col("release_id").alias(f"{side}_release"), F.col("norm").alias(f"{side}_norm"), F.col("entity_id").alias(f"{side}_id"))
    out = relationships
    for side in ("source", "target"):
        out = out.join(one(side), (F.col("release_id") == F.col(f"{side}_release")) & (F.col(f"{side}_name") == F.col(f"{side}_norm")))
    return out.select(*keep, "source_id", "target_id")


def type_conflicts(rows: DataFrame) -> DataFrame:
    """Rows whose category is not the first one registered for their name."""
    first = rows.groupBy("norm").agg(F.min_by("category", F.struct("chapter_number", "row_index", "release_id")).alias("first_category"))
    return rows.join(first, "norm").where("category <> first_category").groupBy("norm", "category", "first_category").agg(F.count(F.lit(1)).alias("dropped"))


def alias_latest(rows: DataFrame, merge_ranges: bool = False) -> DataFrame:
    """Aliases by id: the last observation replaces the earlier ones, or ranges are merged."""
    low = F.min("chapter_number") if merge_ranges else F.max("chapter_number")
    return rows.groupBy("release_id", "alias_text").agg(low.alias("first_seen"), F.max("chapter_number").alias("last_seen"))


def violations(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row for each broken rule of relationships and entities."""
    bad = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    rules = F.array_compact(F.array(
        bad(~F.col("edge_type").isin(*types), "unsupported_type"),
        bad(F.col("start_chapter") > F.col("end_chapter"), "start_after_end"),
        bad(F.col("revealed") < F.col("start_chapter"), "revealed_before_start"),
        bad(F.col("revealed") > F.col("end_chapter"), "revealed_after_end"),
        bad(F.trim("lore_text") == "", "blank_lore"),
        bad(F.regexp_extract("lore_text", r"chapter (\d+)", 1).try_cast("int") > F.col("start_chapter"), "future_lore"),
    ))
    own = edges.select(F.col("relationship_id").alias("id"), F.explode(rules).alias("rule"))
    ids = nodes.select("entity_id")
    dangling = [edges.join(ids.withColumnRenamed("entity_id", c), c, "left_anti").select(F.col("relationship_id").alias("id"), F.lit(f"dangling_{c}").alias("rule")) for c in ("source_id", "target_id")]
    order = nodes.where("first_seen > last_seen OR revealed > last_seen").select(F.col("entity_id").alias("id"), F.lit("entity_range").alias("rule"))
    twice = nodes.groupBy("entity_id").count().where("count > 1").select(F.col("entity_id").alias("id"), F.lit("duplicate_entity").alias("rule"))
    out = own
    for more in (*dangling, order, twice):
        out = out.unionByName(more)
    return out


def snapshot(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts and a hash of all rows, which does not depend on their order or partitions: digests are sorted, then hashed."""
    def digest(frame: DataFrame, kind: str, *columns: str) -> DataFrame:
        line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
        # Two levels: rows by the first byte of their digests, then the digests of those groups.
        d = F.sha2(line.cast("binary"), 256)
        groups = frame.select(d.alias("d")).groupBy(F.substring("d", 1, 2).alias("g")).agg(F.array_join(F.array_sort(F.collect_list("d")), ",").alias("all"), F.count(F.lit(1)).alias("n"))
        groups = groups.select("g", F.sha2(F.col("all").cast("binary"), 256).alias("h"), "n")
        return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ",").cast("binary"), 256).alias("hash"), F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "hash", "n")

    return digest(edges, "relationship", "relationship_id", "end_chapter", "lore_text").unionByName(digest(nodes, "entity", "entity_id", "first_seen", "last_seen"))
