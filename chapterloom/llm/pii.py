"""Personal data by patterns and by what reveals it, in DataFrame operations only.

Patterns find the protected values (addresses, numbers). Information-theoretic sanitisation then adds terms: over the
whole corpus it counts in how many documents a term and a value occur together, and measures how much of the value's
information the term discloses, PMI(term; value) / IC(value), which is 1 when the term never occurs without the value.
Terms at or above a threshold, seen with the value in `support` different texts or more, are marked: removed if they
disclose all of the value, generalised otherwise. With `everywhere` they are marked in all documents that hold them, else
in those that hold the value too.

Scale: the text is scanned for patterns, for the document counts of the terms that may disclose something and, with
`everywhere`, for the places of those that do. Only documents with values (a few in a hundred) are kept with their text.
Equal texts collapse before terms are paired with values, so a group of copies costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The stated patterns, with loops that cannot give back what they took where nothing after them could want it: the
#: same matches, without deep recursion or retries inside a run. An address starts where a run of its characters
#: starts, or where the last one ended; a card is a whole run, so runs under 12 digits need not match at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold at least; a plain search.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"\p{L}+"
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"
#: Terms up to this many are sent to all executors as a join side; more are joined by a shuffle.
BROADCAST_TERMS = 50_000
#: The same for keys of texts, eight bytes each.
BROADCAST_KEYS = 500_000
REPLACEMENT = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(count.between(12, 19), luhn(value)).otherwise(False)
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def _kept(kind: str):
    return lambda s: _valid(kind, s["value"])


def _placed(text: Column, pattern: str, kind: str, number: int, wanted=lambda value: None) -> Column:
    """All matches of a pattern with code-point positions: what lies between matches gives their starts. With a condition
    `wanted` only the matches that meet it: the others are never appended, so long texts with few of them are cheap."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        low = acc["at"] + F.length(x["gap"])
        high = low + F.length(x["value"])
        span = F.struct(low.alias("start"), F.lit(number).alias("kind_no"), high.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        more, condition = F.concat(acc["out"], F.array(span)), wanted(x["value"])
        return F.struct(high.alias("at"), (more if condition is None else F.when(condition, more).otherwise(acc["out"])).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Valid pattern matches of all kinds, sorted by start, then kind: array of (start, kind_no, end, kind, value)."""
    parts = []
    for number, kind in enumerate(KINDS):
        may = text.rlike(PATTERNS[kind]) if NEEDS[kind] is None else text.contains(NEEDS[kind]) & text.rlike(PATTERNS[kind])
        placed = F.filter(_placed(text, PATTERNS[kind], kind, number), _kept(kind))
        parts.append(F.when(may, placed).otherwise(F.expr(f"cast(array() as {SPAN})")))
    return F.sort_array(F.concat(*parts))


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _values(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))


def disclosing_terms(hits: DataFrame, texts: DataFrame, *, share: float, support: int) -> DataFrame:
    """value, text_key, term, disclosure, loose: terms whose share of the value's information is `share` or more. The values
    that only one text has are all told alike by its terms, so they are one row, with null value and that text's key.
    loose: whether documents without any value hold the term too.

    hits: text_key, text, spans of documents with values; texts: the text of every document, each row one document.
    """
    by_text = hits.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    by_text = common.materialise(by_text.select("text_key", "copies", _values(F.col("spans")).alias("values"), _terms(F.col("text")).alias("terms")), "pii-texts")
    total = float(max(1, texts.count()))
    worth = by_text.select("copies", F.explode("values").alias("value")).groupBy("value").agg(F.sum("copies").alias("n_value"), F.count(F.lit(1)).alias("texts"))
    shared = common.materialise(worth.where(F.col("texts") >= max(2, support)).select(F.col("value").alias("s_value"), "n_value"), "pii-values")
    # How many documents with values hold a term: as many as hold it at all, or fewer.
    own = by_text.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("n_own"))
    own = common.materialise(own, "pii-own")
    # Values of several texts: their texts' terms are counted with them.
    side = F.broadcast(shared) if shared.count() <= BROADCAST_TERMS else shared
    pairs = by_text.select("copies", "terms", F.explode("values").alias("value")).join(side, F.col("value") == F.col("s_value"))
    together = pairs.select("value", "n_value", "copies", F.explode("terms").alias("term")).groupBy("value", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts"), F.max("n_value").alias("n_value"))
    together = together.where(F.col("texts") >= support).select("value", F.lit(None).cast("long").alias("text_key"), "term", "n_both", "n_value")
    if support <= 1:
        # Values of one text (all its copies): every term of the text occurs with them as often as they occur.
        alone = by_text.select("text_key", "copies", F.explode("values").alias("value")).join(worth.where("texts = 1").select(F.col("value").alias("a_value")), F.col("value") == F.col("a_value"))
        alone = alone.select("text_key").distinct().join(by_text, "text_key")
        alone = alone.select(F.lit(None).cast("long").alias("value"), "text_key", F.explode("terms").alias("term"), F.col("copies").alias("n_both"), F.col("copies").alias("n_value"))
        together = together.unionByName(alone)
    information = F.log(F.lit(total) / F.col("n_value"))
    # A value in every document carries no information, so nothing discloses it.
    told = lambda n_term: F.when(information > 0, F.log(F.col("n_both") * F.lit(total) / (F.col("n_value") * n_term)) / information).otherwise(0.0)
    # A term that documents with values alone hold too often can be left out before it is counted in all texts.
    together = common.materialise(together.join(own, "term").where(told(F.col("n_own")) >= share), "pii-pairs")
    asked = common.materialise(together.select(F.col("term").alias("a_term")).distinct(), "pii-terms")
    # Summed map-side, so that no row a document and term is shuffled.
    every = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counted = every.join(asked, F.col("term") == F.col("a_term")).drop("a_term")
    found = together.join(counted, "term").withColumn("disclosure", told(F.col("n_term")))
    return found.where(F.col("disclosure") >= share).select("value", "text_key", "term", "disclosure", (F.col("n_term") > F.col("n_own")).alias("loose"))


def _term_spans(text: Column, told: Column, base: Column) -> Column:
    """Places of the terms in `told` (map term -> disclosure) outside base spans; the value is what replaces the term."""
    words = _placed(text, WORD, "term", len(KINDS), lambda value: F.map_contains_key(told, F.lower(value)))
    free = F.filter(words, lambda w: ~F.exists(base, lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    return F.transform(free, lambda w: w.withField("value", F.when(F.element_at(told, F.lower(w["value"])) >= 1.0 - 1e-9, "").otherwise("[TERM]")))


def _disclosed(hits: DataFrame, texts: DataFrame, share: float, support: int, everywhere: bool) -> DataFrame:
    """t_key, told: for texts with disclosing terms, the map of terms to mark in them."""
    told = common.materialise(disclosing_terms(hits, texts, share=share, support=support), "pii-told").withColumnRenamed("value", "t_value")
    held = hits.groupBy("text_key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
    if everywhere:
        worst = common.materialise(told.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max("loose").alias("loose")), "pii-worst")
        marks = held.select("text_key", F.explode(_terms(F.col("text"))).alias("term")).join(worst.drop("loose"), "term")
        # Only terms that texts without values hold too are looked for in those.
        loose = worst.where("loose").select("term", "disclosure")
        n_loose = loose.count()
        if n_loose:
            side = F.broadcast(loose) if n_loose <= BROADCAST_TERMS else loose
            others = texts.select(F.xxhash64("text").alias("text_key"), F.explode(_terms(F.col("text"))).alias("term")).join(side, "term")
            marks = marks.unionByName(others)
        marks = marks.groupBy("text_key", "term").agg(F.first("disclosure").alias("disclosure"))
    else:
        owned = held.select("text_key", F.explode(_values(F.col("spans"))).alias("value"))
        shared = told.where(F.col("t_value").isNotNull()).select("t_value", "term", "disclosure")
        marks = owned.join(shared, F.col("value") == F.col("t_value")).select("text_key", "term", "disclosure")
        marks = marks.unionByName(told.where(F.col("t_value").isNull()).select("text_key", "term", "disclosure"))
        marks = marks.groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure"))
    return marks.groupBy(F.col("text_key").alias("t_key")).agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))


def find(docs: DataFrame, *, share: float = 0.95, support: int = 3, everywhere: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, base (pattern spans), spans (with the terms added), then the columns named in `keep`.

    Args:
        docs: doc_id long, text string; other columns are ignored unless named in `keep`, whatever their names.
        share: a term is marked if it discloses this share of the information of a value in the same document,
        support: and occurs with that value in so many different texts; 1 takes every value, however rare.
        everywhere: whether terms are marked in every document that holds them, or only where the value is too.
    A null text counts as empty, without spans. Repeated rows and equal texts get equal spans. Spans hold code-point
    positions, end exclusive. An empty table gives no rows.
    """
    text = common.text_or_empty()
    marked = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *keep).alias("kept"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    some = F.size("spans") > 0
    light = marked.select("kept", "spans", F.when(some, F.col("text")).alias("text"), F.when(some | F.lit(everywhere), F.xxhash64("text")).alias("text_key"))
    light = common.materialise(light, "pii-base")
    hits, texts = light.where(F.col("text").isNotNull()), docs.select(text.alias("text"))
    told = _disclosed(hits, texts, share, support, everywhere)
    if everywhere:
        told = common.materialise(told, "pii-marks")
        # Texts without values that hold a term: few, so they are fetched once it is known which.
        others = common.materialise(told.select("t_key").join(hits.select("text_key"), F.col("t_key") == F.col("text_key"), "left_anti"), "pii-others")
        others = F.broadcast(others) if others.count() <= BROADCAST_KEYS else others
        fetched = texts.withColumn("x_key", F.xxhash64("text")).join(others, F.col("x_key") == F.col("t_key"), "left_semi").groupBy("x_key").agg(F.first("text").alias("x_text"))
        added = light.join(told, F.col("text_key") == F.col("t_key"), "left").join(fetched, F.col("text_key") == F.col("x_key"), "left").withColumn("text", F.coalesce("text", "x_text"))
    else:
        added = hits.join(told, F.col("text_key") == F.col("t_key"), "left")
    more = F.when(F.col("told").isNotNull(), _term_spans(F.col("text"), F.col("told"), F.col("spans"))).otherwise(F.expr(f"cast(array() as {SPAN})"))
    out = added.select("kept", F.col("spans").alias("base"), F.sort_array(F.concat("spans", more)).alias("spans"))
    if not everywhere:
        out = out.unionByName(light.where(F.col("text").isNull()).select("kept", F.col("spans").alias("base"), "spans"))
    return out.select("kept.doc_id", "base", "spans", *(f"kept.{c}" for c in keep))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's mark; of overlapping spans the first covers the others."""
    mark = F.create_map(*(F.lit(x) for k, v in REPLACEMENT.items() for x in (k, v)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.coalesce(F.element_at(mark, s["kind"]), s["value"])
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        inside = s["start"] < acc["at"]
        return F.struct(F.when(inside, F.greatest(acc["at"], s["end"])).otherwise(s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, put)).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the SHA-256 of the base spans, and all spans, written out."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(rendered(F.col("base")).cast("binary"), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
