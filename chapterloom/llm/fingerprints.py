"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs (lines, cut at sentence ends and at LONGEST characters) are hashed to 64-bit digests. A digest is
put into one cell of each of three subtables; a cell holds a count, the XOR of its digests and the XOR of their check
sums. Two versions' sketches are subtracted cell by cell: what they share cancels, and peeling (a cell with count one
and a matching check sum gives a digest, which is taken out of its other cells) recovers the digests on either side.
If peeling stops early, the digests are dealt into blocks by some of their bits, each with a sketch of its own, and a
block that fails again is retried at twice the cells with other positions.

Everything is one expression over a row, so there is no shuffle but the one that brings a document and the next one
together; work is linear in the number of paragraphs but for the two-level dealing into blocks (its power 1.5).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LONGEST = 400
PARAGRAPH = r"[^\n.!?]{1,%d}+[\n.!?]*+|[\n.!?]++" % LONGEST
#: Cells in each of the three subtables of a fingerprint, and of a block's first try.
SIDE = 8
#: Digests of both versions that a block is meant to hold, and the tries of a block, each at twice the cells.
BLOCK_LOAD, TRIES = 8, 6
ROUNDS = 10
#: Intervals of ids with about equally many documents, each cut into equal steps: an outlying id spoils one of them.
COARSE = 64
CELL = "struct<n:int,key:bigint,check:int>"


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0))


def _spread(key: Column, attempt: Column | None) -> Column:
    """64 bits that choose the positions of a digest: itself at the first try, other hashes after."""
    return key if attempt is None else F.when(attempt == 0, key).otherwise(F.xxhash64(key, attempt))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a one-element array binds it."""
    return F.transform(F.array(value), use)[0]


def _place(i: Column, side: Column | int) -> Column:
    """Of cell i: where the bits for its subtable are in a digest, their mask, and their value in it."""
    side = F.lit(side) if isinstance(side, int) else side
    return F.struct((F.floor(i / side) * 20).cast("int").alias("shift"), (side - 1).cast("long").alias("mask"), (i % side).cast("long").alias("value"))


def _at(bits: Column, place: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, place["shift"]).bitwiseAND(place["mask"]) == place["value"]


def _sum(keys: Column, place: Column, attempt: Column | None) -> Column:
    """One cell of the sketch of `keys`."""
    own = F.filter(keys, lambda k: _at(_spread(k, attempt), place))
    return F.aggregate(own, _zero(), lambda c, k: _cell(c["n"] + 1, c["key"].bitwiseXOR(k), c["check"].bitwiseXOR(F.hash(k))))


def sketch(keys: Column, side: int = SIDE) -> Column:
    """The fingerprint's cells: array of (count, key XOR, check XOR), three subtables of `side` cells."""
    return F.transform(_places(F.lit(side)), lambda p: _sum(keys, p, None))


def _places(side: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), 3 * side - 1), lambda i: _place(i, side))


def _minus(x: Column, y: Column) -> Column:
    return _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"]))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, _minus)


def _empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))


def peeled(cells: Column, places: Column, attempt: Column | None) -> Column:
    """struct(done, plus, minus): whether peeling emptied the sketch, and the digests found on either side."""
    state = F.struct(cells.alias("cells"), F.lit(0).alias("plus"), F.lit(0).alias("minus"), F.lit(True).alias("going"))

    def pure(cs: Column) -> Column:
        return F.array_distinct(F.filter(cs, lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (F.hash(c["key"]) == c["check"])))

    def without(cs: Column, taken: Column) -> Column:
        def cell(c: Column, place: Column) -> Column:
            own = F.filter(taken, lambda p: _at(_spread(p["key"], attempt), place))
            return F.aggregate(own, c, lambda a, p: _cell(a["n"] - p["n"], a["key"].bitwiseXOR(p["key"]), a["check"].bitwiseXOR(p["check"])))

        return F.zip_with(cs, places, cell)

    def step(acc: Column, _: Column) -> Column:
        # One-element arrays bind a value that is used several times.
        bound = F.transform(F.array(pure(acc["cells"])), lambda taken: F.when(F.size(taken) == 0, acc.withField("going", F.lit(False))).otherwise(
            F.struct(
                without(acc["cells"], taken).alias("cells"),
                (acc["plus"] + F.size(F.filter(taken, lambda p: p["n"] == 1))).alias("plus"),
                (acc["minus"] + F.size(F.filter(taken, lambda p: p["n"] == -1))).alias("minus"),
                F.lit(True).alias("going"),
            )
        ))
        return F.when(acc["going"], F.element_at(bound, 1)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step, lambda s: F.struct(_empty(s["cells"]).alias("done"), s["plus"].alias("plus"), s["minus"].alias("minus")))


def _block(a: Column, b: Column) -> Column:
    """struct(done, plus, minus) of two arrays of digests: tries at growing sizes, then (never seen) plain difference."""
    first = F.struct(F.lit(False).alias("done"), F.lit(0).alias("plus"), F.lit(0).alias("minus"))

    def attempt(acc: Column, t: Column) -> Column:
        def with_places(places: Column) -> Column:
            cells = F.transform(places, lambda p: _bind(F.struct(_sum(a, p, t).alias("x"), _sum(b, p, t).alias("y")), lambda s: _minus(s["x"], s["y"])))
            return peeled(cells, places, t)

        side = F.call_function("shiftleft", F.lit(SIDE), t)
        return F.when(acc["done"], acc).otherwise(_bind(_places(side), with_places))

    tried = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), first, attempt)
    plain = F.struct(F.lit(True).alias("done"), F.size(F.array_except(a, b)).alias("plus"), F.size(F.array_except(b, a)).alias("minus"))
    known = F.transform(F.array(tried), lambda r: F.when(r["done"], r).otherwise(plain))[0]
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.struct(F.lit(True).alias("done"), F.size(a).alias("plus"), F.size(b).alias("minus"))).otherwise(known)


def _added(results: Column) -> Column:
    zero = F.struct(F.lit(0).alias("plus"), F.lit(0).alias("minus"))
    return F.aggregate(results, zero, lambda s, r: F.struct((s["plus"] + r["plus"]).alias("plus"), (s["minus"] + r["minus"]).alias("minus")))


def _larger(a: Column, b: Column) -> Column:
    """struct(plus, minus) from blocks: two levels of dealing by bits 57.. and 50.. of the digests."""
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    blocks = F.greatest(F.lit(0), F.ceil(F.log2((F.size(a) + F.size(b)) / BLOCK_LOAD))).cast("int")
    widths = _bind(blocks, lambda n: F.struct(F.least(F.lit(6), F.floor(n / 2).cast("int")).alias("upper"), n.alias("all")))
    masks = _bind(widths, lambda w: F.struct(power(w["upper"]).alias("upper"), power(F.least(F.lit(7), w["all"] - w["upper"])).alias("lower")))
    return _bind(masks, lambda m: _dealt(a, b, m))


def _dealt(a: Column, b: Column, masks: Column) -> Column:
    def dealt(keys: Column, low: int, mask: Column, number: Column) -> Column:
        return F.filter(keys, lambda k: F.shiftrightunsigned(k, low).bitwiseAND(mask) == number)

    def inner(pair: Column) -> Column:
        return _added(F.transform(F.sequence(F.lit(0).cast("long"), masks["lower"]), lambda j: _bind(F.struct(dealt(pair["a"], 50, masks["lower"], j).alias("a"), dealt(pair["b"], 50, masks["lower"], j).alias("b")), lambda p: _block(p["a"], p["b"]))))

    return _added(F.transform(F.sequence(F.lit(0).cast("long"), masks["upper"]), lambda i: _bind(F.struct(dealt(a, 57, masks["upper"], i).alias("a"), dealt(b, 57, masks["upper"], i).alias("b")), inner)))


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """struct(plus, minus): how many digests are in a only, in b only, recovered from sketches."""
    small = peeled(subtracted(sketch_a, sketch_b), _places(F.lit(SIDE)), None)
    return F.transform(F.array(small), lambda r: F.when(r["done"], F.struct(r["plus"].alias("plus"), r["minus"].alias("minus"))).otherwise(_larger(a, b)))[0]


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Jaccard likeness of two sets of digests from the recovered difference; 1 if both are empty."""
    union = F.size(a) + found["minus"]
    return F.when(union == 0, 1.0).otherwise((F.size(a) - found["plus"]) / union)


def written(cells: Column) -> Column:
    """The cells in lower-case hex: 4 digits of count, 16 of key, 8 of check sum each."""
    one = lambda c: F.concat(F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.array_join(F.transform(cells, one), ""))


def _range(doc_id: Column, edges: list[int], ranges: int) -> Column:
    """About `ranges` numbers that ascend with the id: the interval between `edges`, then equal steps inside it."""
    steps = -(-ranges // max(1, len(edges) - 1))
    limits = F.array(*(F.lit(e).cast("long") for e in edges))
    inner = F.array(*(F.lit(e).cast("long") for e in edges[1:-1])) if len(edges) > 2 else F.expr("cast(array() as array<bigint>)")

    def inside(interval: Column) -> Column:
        low, high = (F.element_at(limits, interval + i).cast("double") for i in (1, 2))
        step = F.floor((doc_id.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * steps).cast("int")
        return interval * steps + F.greatest(F.lit(0), F.least(F.lit(steps - 1), step))

    return _bind(F.size(F.filter(inner, lambda e: e <= doc_id)), inside)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys, next_text, next_keys: each document beside the next one by descending doc_id, the last beside the first.

    Ids are cut into ranges between approximate percentiles, each ordered in one task; a range's first document is sent to the range before it as well.
    Ties in ids go by text hash; null ids come last.
    """
    spark = docs.sparkSession
    text = common.text_or_empty()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("order"), F.xxhash64(text).alias("tie"))
    ranges = 4 * common.shuffle_partitions(spark)
    ends = plain.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", [i / COARSE for i in range(1, COARSE)], 1000).alias("cuts")).first()
    edges = sorted({ends.low or 0, (ends.high or 0) + 1, *(ends.cuts or [])})
    plain = plain.withColumn("range", F.coalesce(_range(F.col("doc_id"), edges, ranges), F.lit(-1)))
    up = Window.orderBy("range")
    heads = plain.groupBy("range").agg(F.max(F.struct("order", "tie")).alias("head"))
    heads = heads.select(F.col("range").alias("h_range"), "head", F.coalesce(F.lead("range").over(up), F.min("range").over(Window.partitionBy())).alias("to"))
    # At most `ranges` + 1 rows, a number that the session's partitions set.
    both = plain.join(F.broadcast(heads), F.col("range") == F.col("h_range"))
    is_head = (F.col("order") == F.col("head.order")) & (F.col("tie") == F.col("head.tie"))
    sent = both.withColumn("to", F.explode(F.when(is_head, F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("copy")), F.struct(F.col("to").alias("range"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("copy"))))))
    sent = sent.select("doc_id", "text", "order", "tie", "to.range", "to.copy").repartition(common.shuffle_partitions(spark), "range").withColumn("keys", digests(F.col("text")))
    down = Window.partitionBy("range").orderBy("copy", F.desc("order"), F.desc("tie"))
    out = sent.withColumn("next_text", F.lead("text").over(down)).withColumn("next_keys", F.lead("keys").over(down))
    return out.where(~F.col("copy")).select("doc_id", "text", "keys", "next_text", "next_keys")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, lost, gained.

    Args:
        docs: doc_id long, text string; other columns are ignored, whatever their names.
    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document's. Likeness is that of the sets of paragraph digests; lost and gained are the digests that peeling
    recovers between the text and the edited text. A null text counts as empty: no digests, a sketch of zeros, likeness 1
    to another empty text and 0 to any other. Repeated rows are documents of their own. An empty table gives no rows.
    """
    near = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    step = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "keys", "next_keys")
    step = step.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "keys", "next_keys", digests(F.col("edited")).alias("edited_keys"))
    step = step.withColumns({"cells": sketch(F.col("keys")), "edited_cells": sketch(F.col("edited_keys")), "next_cells": sketch(F.col("next_keys"))})
    step = step.withColumns({
        "to_edited": difference(F.col("keys"), F.col("edited_keys"), F.col("cells"), F.col("edited_cells")),
        "to_next": difference(F.col("keys"), F.col("next_keys"), F.col("cells"), F.col("next_cells")),
    })
    return step.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("cells")).alias("fingerprint"),
        written(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("to_edited")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), F.col("to_next")).alias("near_next"),
        F.size("keys").alias("n_paragraphs"),
        F.col("to_edited.plus").alias("lost"),
        F.col("to_edited.minus").alias("gained"),
    )
