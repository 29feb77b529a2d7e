"""The training-data pipeline over `documents`: reject toxic documents, keep one of each group of near-duplicates, remove
personal data, mix the sources to target weights, and pack the result into sequences.

Every stage gets the table that the stage before it wrote, works on all of its rows, and returns a plan; `run` writes each
result as Parquet in the shared folder and rereads it, so a lost executor costs part of one stage. All stages but the
last return the columns of `documents`: doc_id, text, lang, source, n_chars; other columns are ignored, whatever their
names. Rows are told apart by their place in the table, not by doc_id, so repeated and null ids are rows like any other.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chapterloom.llm import common, mixing, packing, pii, simhash, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: words of a shingle, 64-bit words of a fingerprint, differing bits of a candidate, shared shingles.
SHINGLE, WORDS, DISTANCE, SIMILARITY = 5, 5, 60, 0.8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold; a null text scores as empty and stays null. Rows with equal texts score alike, so
    repeats stay or go together."""
    labels = common.table(spark, sf_dir, "labels")
    return toxicity.score(docs, labels, keep=COLUMNS[1:]).where(F.col("predicted") == 0).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id (of equal ids the first in the table, null ids
    last). Texts are near-duplicates if they share SIMILARITY of their different SHINGLE-word shingles; candidates are found by
    fingerprints of WORDS x 64 bits. A null text counts as empty, and all texts without words are one group. A row whose text
    nobody else has stays, whatever its id."""
    rows = common.keyed(docs, COLUMNS)
    found = simhash.near_duplicates(rows, shingle=SHINGLE, words=WORDS, distance=DISTANCE, similarity=SIMILARITY, keep=("row_key",))
    found = common.materialise(found.select("doc_id", "row_key", "component"), "near-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    kept = found.groupBy("component").agg(first.alias("first")).select(F.col("first.row_key").alias("row_key"))
    dropped = common.materialise(found.join(kept, "row_key", "left_anti").select("row_key"), "near-dropped")
    return rows.join(dropped, "row_key", "left_anti").select(*COLUMNS)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with marks in place of personal data and of the terms that disclose it; n_chars is counted anew where the
    text changed. A null text stays null, repeated rows stay repeated and are changed alike."""
    found = pii.find(docs, support=1, everywhere=True, keep=COLUMNS[1:])
    clean = found.withColumn("clean", F.when(F.size("spans") > 0, pii.replaced(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    counted = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", counted).select("doc_id", F.col("clean").alias("text"), "lang", "source", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: whole copies, then the words taken of a last one. Rows of which nothing is taken
    go; a row without words (a null text too) counts as taken if its source has a whole epoch. Repeated rows, and rows that
    share an id or have none, are each taken on their own."""
    rows = common.keyed(docs, COLUMNS)
    taken = mixing.mix(rows, keep=("row_key",)).select("row_key", "size", "taken", "epochs")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.least(F.col("epochs"), F.lit(1))).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    # Hashed on the light side, so texts are not sorted.
    joined = rows.join(taken.hint("shuffle_hash"), "row_key").withColumns({"whole": whole, "rest": rest})
    # `part` is 0 for a whole copy, else the words to keep.
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("whole")), F.when(F.col("rest") > 0, F.array(F.col("rest").cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)")))
    copies = joined.withColumn("part", F.explode(parts))
    # A piece is a word with the white space before it.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    copies = copies.withColumn("head", F.when(F.col("part") > 0, F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")))
    text, counted = F.coalesce("head", "text"), F.coalesce(F.length("head").cast("long"), "n_chars")
    return copies.select("doc_id", text.alias("text"), "lang", "source", counted.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens. A null text packs as empty: its end token alone. Repeated rows are
    packed each, under the same doc_id; a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The scores, XXH64 fingerprints and token ids of the stages are outside SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over `documents`."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
