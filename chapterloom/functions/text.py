"""Text columns: normalisation, placeholders, hashes, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"⟦/?[A-Z]+_\d+⟧"
CJK = r"[一-鿿]"
#: Words that are no glossary terms.
STOPLIST = (
    "时候 时间 地方 学校 家里 面前 身后 眼前 心中 手上 脚下 身上 这时 那时 此时 此刻 突然 忽然 虽然 但是 因为 所以 如果 已经 还是 就是 这个 那个 什么 怎么 "
    "我们 你们 他们 自己 别人 知道 发现 觉得 想到 看到 听到 说道 起来 出来 过来 回来 没有 不是 可以 能够 应该"
).split()
#: Whole terms that are dates or times.
DATES = (
    r"\d+[\.\-\/]\d+[\.\-\/]\d+",
    r"二十[一二三四五六七八九十][年]",
    r"[零一二三四五六七八九十\d]+[年月日号]",
    r"[零一二三四五六七八九十\d]+月[零一二三四五六七八九十\d]+[日号]",
    r"[零一二三四五六七八九十\d]+[月][初旬][一二三四五六七八九十\d]*",
    r"[今年明后去]年",
    r"[春夏秋冬][天季节]",
    r"[上中下][午旬][年月日]?",
)
PRONOUNS = ("he", "she", "it", "they", "him", "her", "them", "his", "its", "their")
FUTURE = r"(?i)第\s*(\d+)\s*章|\bchapter\s+(\d+)\b"


def normalise_term(term: Column) -> Column:
    """White space collapsed and trimmed, title marks off both ends, lower case (ß as ss)."""
    flat = F.regexp_replace(F.regexp_replace(term, r"(?U)\s+", " "), r"^ +| +$", "")
    return F.replace(F.lower(F.regexp_replace(flat, "^[《》]+|[《》]+$", "")), F.lit("ß"), F.lit("ss"))


def without_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "") == ""


def snippet(text: Column, term: Column, around: int = 30, otherwise: int = 120) -> Column:
    """The text round a term's first place, else its beginning."""
    at = F.instr(text, term)
    start = F.greatest(F.lit(0), at - 1 - around)
    return F.when(at > 0, F.substring(text, start + 1, at - 1 + F.length(term) + around - start)).otherwise(F.substring(text, 1, otherwise))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping places of a term, at least one."""
    return F.greatest(F.lit(1), ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def pronoun_count(text: Column) -> Column:
    return F.size(F.filter(words(F.lower(text)), lambda w: w.isin(*PRONOUNS)))


def surrogate(prefix: str, *parts: Column) -> Column:
    """prefix + 24 hex digits of the SHA-256 of the parts; nulls count as empty, so no part is lost."""
    joined = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined.cast("binary"), 256), 1, 24))


def token_count(text: Column) -> Column:
    """The default counter: an eighth of the characters, one at least, none for empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 8))).cast("long")


def buffered(tokens: Column) -> Column:
    return F.ceil(tokens * 105 / 100).cast("long")


#: The stops that end sentences.
STOPS = "。！？.!?"
#: Stops of the split that a failed segment is tried again with.
RETRY_STOPS = STOPS + r"\\"


def sentence_pieces(text: Column, most: int = 1500, stops: str = STOPS) -> Column:
    """A text of at most `most` characters as it is; else its sentences (with all `stops` that end them, so nothing is lost)
    packed greedily into pieces, and pieces that are longer cut every `most` characters."""
    sentences = F.regexp_extract_all(text, F.lit(f"(?s)[^{stops}]++[{stops}]*+|[{stops}]++"), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(s) <= most
        # A first sentence that does not fit is cut once; any other begins a piece of its own.
        done = F.when(acc["open"] != "", acc["open"]).otherwise(F.substring(s, 1, most))
        rest = F.when(acc["open"] != "", s).otherwise(F.substring(s, F.lit(most + 1), F.length(s)))
        return F.when(fits, F.struct(F.concat(acc["open"], s).alias("open"), acc["out"].alias("out"))).otherwise(F.struct(rest.alias("open"), F.concat(acc["out"], F.array(done)).alias("out")))

    packed = F.aggregate(sentences, start, step, lambda acc: F.when(acc["open"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))))
    cut = F.flatten(F.transform(packed, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substring(s, i * most + 1, F.lit(most)))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(cut)
