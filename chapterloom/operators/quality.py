"""Structure, fidelity and risk of translated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Weight and saturation of each risk factor.
FACTORS = {"idioms": (0.20, 3), "titles": (0.15, 3), "reveal": (0.20, 1), "pronouns": (0.20, 2), "placeholders": (0.15, 5), "entities": (0.10, 4)}


def risk_score(**counts: Column) -> Column:
    out = F.lit(0.0)
    for name, (weight, saturation) in FACTORS.items():
        if name in counts:
            out = out + F.least(F.lit(1.0), counts[name] / float(saturation)) * weight
    return F.least(F.lit(1.0), out)


def risk_class(score: Column, high: float = 0.7) -> Column:
    return F.when(score >= high, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")


def structure_errors(source: Column, candidate: Column) -> tuple[Column, Column]:
    """(errors, warnings): empty output, placeholders that differ in kind or order, placeholders out of nowhere."""
    a, b = T.placeholders(source), T.placeholders(candidate)
    errors = F.concat_ws("|", F.when(T.is_blank(candidate), "empty"), F.when(~F.coalesce(a == b, F.lit(False)), "placeholder_mismatch"))
    return errors, F.when((F.size(a) == 0) & (F.size(b) > 0), "introduced_placeholders").otherwise("")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def structure(rows: DataFrame, source: str, candidate: str) -> DataFrame:
    errors, warnings = structure_errors(F.col(source), F.col(candidate))
    return rows.select("conv_id", "turn", errors.alias("errors"), warnings.alias("warnings"))


def basic_fidelity(rows: DataFrame, source: str, output: str) -> DataFrame:
    same = F.when(strip(F.col(source)) == strip(F.col(output)), "identical").otherwise("")
    return rows.select("conv_id", "turn", F.when(T.is_blank(F.col(output)), "empty").otherwise("").alias("errors"), same.alias("warnings"))


def integrity_errors(source: Column, second: Column, third: Column, terms: tuple[str, ...]) -> Column:
    """Of a polished text: empty ends the check; else placeholders against both earlier texts, and terms that were lost."""
    lost = [F.when(second.contains(t) & ~third.contains(t), f"drift:{t}") for t in terms]
    full = F.concat_ws("|", F.when(~(T.placeholders(source) == T.placeholders(third)), "placeholder_source"), F.when(~(T.placeholders(second) == T.placeholders(third)), "placeholder_pass2"), *lost)
    return F.when(T.is_blank(third), "empty").otherwise(full)


def pass3_integrity(rows: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    errors = integrity_errors(F.col("source_text"), F.col("pass2"), F.col("pass3"), terms)
    same = F.when(~T.is_blank(F.col("pass3")) & (strip(F.col("pass3")) == strip(F.col("source_text"))), "identical").otherwise("")
    return rows.select("conv_id", "turn", errors.alias("errors"), same.alias("warnings"))


def pass_decisions(rows: DataFrame, terms: tuple[str, ...], high: float) -> DataFrame:
    errors = integrity_errors(F.col("source_text"), F.col("pass2"), F.col("pass3"), terms)
    decision = F.when(F.col("risk") >= high, "skipped_high_risk").when(errors == "", "pass3_accepted").otherwise("pass3_rejected_integrity_failure")
    final = F.when(decision == "pass3_accepted", F.col("pass3")).otherwise(F.col("pass2"))
    return rows.select("conv_id", "turn", decision.alias("decision"), F.length(final).alias("final_chars"))


def pass2_verdict(rows: DataFrame, verdict: str, draft: str) -> DataFrame:
    """A reviewer's JSON decides: unreadable, no errors found, or no corrected text leave the draft."""
    parsed = F.from_json(verdict, "fidelity_errors_found boolean, corrected_text string")
    use = F.coalesce(parsed["fidelity_errors_found"], F.lit(False)) & (F.coalesce(parsed["corrected_text"], F.lit("")) != "")
    return rows.select("doc_id", F.when(use, parsed["corrected_text"]).otherwise(F.col(draft)).alias("output"), use.alias("corrected"))


def readability(text: Column) -> Column:
    """Mean of two closeness scores: words of 5 letters, sentences of 17 words."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    sentences = F.filter(F.split(text, "[.!?]"), lambda s: ~T.is_blank(s))
    n, m = F.size(words), F.size(sentences)
    word = F.greatest(F.lit(0.0), 1 - F.abs(F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / n - 5) / 5)
    sentence = F.greatest(F.lit(0.0), 1 - F.abs(n / m - 17) / 17)
    return F.when((n == 0) | (m == 0), 0.0).otherwise(F.round((word + sentence) / 2, 4))


def terminology(text: Column, terms: tuple[str, ...]) -> Column:
    """The share of the terms that the text holds; 1 without terms, 0 for empty text."""
    if not terms:
        return F.lit(1.0)
    hits = sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    return F.when(text == "", 0.0).otherwise(F.round(hits / len(terms), 4))


def orphan_closings(text: Column) -> Column:
    """Closing placeholders without an opening one."""
    opens = F.regexp_extract_all(text, F.lit(r"⟦([A-Z]+_\d+)⟧"), F.lit(1))
    closes = F.regexp_extract_all(text, F.lit(r"⟦/([A-Z]+_\d+)⟧"), F.lit(1))
    return F.array_except(closes, opens)
