"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a token target: its share of the mix by weight, stopped at `cap` times its own size, what is beyond
the stop going to the other sources by weight (water filling, solved in closed form over the sorted stops). A source
then takes every whole epoch that fits in its target, and the rest of the target is filled in the order of exponential
keys scaled by document quality: key = -ln(u) / weight, smallest first, u from a hash of the document's id.

Scale: the text is read once, into a light table of (doc, source, size, key). A prefix sum over a source that holds a
third of all rows would be one task, so keys are dealt into buckets by value: bucket sums decide all but the one bucket
in which the target is reached, and only that bucket's documents are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Key buckets of a source: a bucket, the unit that is sorted in one task, holds about 1/BUCKETS of its source.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight in [0.25, 2]: many distinct lines and words of ordinary length weigh more."""
    lines = F.split(text, "\n")
    fresh = F.size(F.array_distinct(lines)) / F.size(lines)
    mean = F.length(text) / F.greatest(size, F.lit(1))
    ordinary = F.when(mean.between(3.0, 12.0), 1.0).otherwise(0.5)
    return F.round(F.greatest(F.lit(0.25), 2.0 * fresh * ordinary), 6)


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from the SHA-256 of the id and the seed: the same on every run and engine."""
    digest = F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, *, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, weight, source_size, target: one row a source, sources in code-point order with null last.

    The windows run over the sources only, one row each.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by = F.array(*(F.lit(float(w)) for w in weights))
    named = sizes.withColumn("weight", F.element_at(by, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    filling = Window.orderBy(F.col("stop_ratio"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    upward = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (
        named.withColumn("stop", F.lit(cap) * F.col("source_size"))
        .withColumn("stop_ratio", F.col("stop") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(upward))
    )
    # The water level is set by the first source, in the order of stops, that it does not overfill; from there on levels fall.
    held = level.withColumn("water", F.max(F.when(F.col("level") <= F.col("stop_ratio"), F.col("level"))).over(everything))
    return held.select(
        "source",
        "weight",
        "source_size",
        F.least(F.col("stop"), F.coalesce(F.col("water") * F.col("weight"), F.col("stop"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, epochs, weight, sample_key, taken, then the columns
    named in `keep`.

    Args:
        docs: doc_id long, text string, source string; other columns are ignored unless named in `keep`, whatever their names.
        weights: of the sources in code-point order, repeating; null is a source of its own, the last.
    A null or blank text has size 0 and takes 0. `taken` counts words with repeats: `epochs` whole copies, one more copy
    for documents before the point at which the target is reached, and the words still missing there from the document
    at that point. It never exceeds `cap` times the size. Ties in keys (repeated ids) go by size, then by text hash, then by what is kept; rows alike in all of that take alike whichever is
    first. A row without doc_id is drawn like any other. An empty table gives no rows.
    """
    text = common.text_or_empty()
    size = word_count(text)
    light = common.materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), quality(text, size).alias("quality"), F.struct(F.xxhash64(text).alias("text"), *keep).alias("tie"))
        .withColumn("sample_key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("quality"))
        .withColumn("bucket", F.floor(BUCKETS * (1.0 - F.exp(-F.col("sample_key")))).cast("int")),
        "mix-sizes",
    )
    buckets = light.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = common.materialise(buckets, "mix-buckets")
    goal = common.materialise(
        targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights=weights, share=share, cap=cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "mix-targets",
    ).hint("shuffle_hash")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = buckets.withColumn("before", F.sum("bucket_size").over(upto) - F.col("bucket_size"))
    room = room.withColumnRenamed("source", "b_source").withColumnRenamed("bucket", "b_bucket")
    # Per bucket of a source: how many words of it the mix still takes after the whole epochs.
    room = room.join(goal, F.col("b_source").eqNullSafe(F.col("source"))).select(
        "b_source", "b_bucket", "source_size", "target", "epochs", "weight", "bucket_size", F.greatest(F.lit(0), F.least(F.col("bucket_size"), F.col("rest") - F.col("before"))).alias("room")
    )
    found = light.join(room, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")), "left")
    partial = (F.col("room") > 0) & (F.col("room") < F.col("bucket_size"))
    inside = Window.partitionBy("source", "bucket").orderBy("sample_key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs", "weight", "sample_key", *(F.col(f"tie.{c}").alias(c) for c in keep)]
    whole = found.where(~partial).select(*columns, (F.col("epochs") * F.col("size") + F.when(F.col("room") > 0, F.col("size")).otherwise(0)).alias("taken"))
    cut = (
        found.where(partial)
        .withColumn("before", F.sum("size").over(inside) - F.col("size"))
        .select(*columns, (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("before")))).alias("taken"))
    )
    return whole.unionByName(cut).select("doc_id", "source", "size", "source_size", "target", "epochs", "weight", "sample_key", "taken", *keep)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    round(greatest(CAST(0.25 AS DOUBLE), CAST(2 AS DOUBLE) * (CAST(len(list_distinct(string_split(text, chr(10)))) AS DOUBLE) / len(string_split(text, chr(10))))
      * CASE WHEN CAST(length(text) AS DOUBLE) / greatest(size, 1) BETWEEN 3 AND 12 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END), 6) AS quality,
    (CAST(CAST('0x' || left(sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':20'), 12) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM k GROUP BY source
), l AS (
  SELECT *, CAST(2 AS DOUBLE) * source_size AS stop, CAST(2 AS DOUBLE) * source_size / weight AS ratio, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), w AS (
  SELECT *, (total - coalesce(sum(stop) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l
), t AS (
  SELECT source, source_size, weight, least(stop, coalesce((SELECT max(level) FROM w WHERE level <= ratio) * weight, stop)) AS target FROM w
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), c AS (
  SELECT doc_id, size, k.source, source_size, target, epochs, weight, CAST(floor(target - epochs * source_size) AS BIGINT) AS rest,
    CAST(sum(size) OVER (PARTITION BY k.source ORDER BY -ln(u) / quality, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, rest - before)) AS taken, source, epochs, weight FROM c
"""
