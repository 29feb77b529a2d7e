"""Connected components of a link table by alternating star contractions.

Each round is two grouped minima and two joins; every round's links are written to the shared folder, so a lost
executor costs one round at most. Nothing about links or components reaches the driver but three sums a round.
Hubs: the minimum of a node's neighbours is aggregated map-side, and the joins can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least_neighbour(links: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours in u -> v rows."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node): for every node of `links` (a long, b long; any order, repeats and loops allowed).

    Null ends are ignored; an empty table gives none.
    """
    current = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = common.materialise(current, "links")
    state = _state(current)
    while state[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = _least_neighbour(both).withColumnRenamed("u", "w")
        # Large star: a node's larger neighbours are linked to its smallest one.
        large = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = _least_neighbour(large).withColumnRenamed("u", "w")
        pairs = large.join(low, F.col("u") == F.col("w"))
        small = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("w").alias("a"), F.col("m").alias("b")))
        before, current = current, common.materialise(small.where("a <> b").distinct(), "links")
        common.forget(before)
        last, state = state, _state(current)
        if last == state:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
