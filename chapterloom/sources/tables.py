"""Readers and writers of the engine's other formats: chapter JSON, JSON-lines logs, review and golden files, SQLite tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "text string, record struct<time:struct<repr:string>,level:struct<name:string>,name:string,message:string,extra:map<string,string>>"


def read_chapters(spark: SparkSession, path: str, schema: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Chapter rows from a folder partitioned by chapter_number; the range prunes folders before anything is read."""
    out = spark.read.schema(schema).json(path)
    out = out.where(F.col("chapter_number") >= low) if low is not None else out
    return out.where(F.col("chapter_number") <= high) if high is not None else out


def write_chapters(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("chapter_number").json(path)


def read_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Parsable lines of a JSON-lines log, newest first; broken lines are left out."""
    lines = spark.read.text(path).select(F.from_json("value", LOG).alias("j")).where("j.record IS NOT NULL")
    at = F.coalesce("j.record.time.repr", F.lit(""))
    out = lines.select(at.alias("at"), F.lower(F.coalesce("j.record.level.name", F.lit("INFO"))).alias("level"), F.col("j.record.name").alias("logger"), F.col("j.record.message").alias("message")).orderBy(F.desc("at"), "message")
    return out.limit(last) if last else out


def read_review(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Entries of a review file; another version of the format is refused."""
    schema = "review_schema_version int, release_id string, entries array<struct<candidate_id:string,source_term:string,category:string,translation:string,action:string>>"
    file = spark.read.schema(schema).option("multiLine", "true").json(path)
    checked = F.assert_true(F.col("review_schema_version") == version, F.lit(f"review_schema_version must be {version}"))
    return file.withColumn("ok", checked).where(F.col("ok").isNull()).select("release_id", F.inline("entries"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source_zh string, expected_en string, category string, difficulty int").option("multiLine", "true").json(path)


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """A query on an SQLite file that every executor can open; a small authority table, read by one task."""

    def rows(frames):
        import sqlite3

        import pandas as pd

        for _ in frames:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                yield pd.read_sql_query(query, con)

    return spark.range(1).mapInPandas(rows, schema)


def verified_write(rows: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """Write, read back and compare hashes; the rows that differ (none, if all is well)."""
    rows.write.mode("overwrite").parquet(path)
    digest = F.sha2(F.col(text).cast("binary"), 256)
    a, b = rows.select(key, digest.alias("written")), rows.sparkSession.read.parquet(path).select(F.col(key).alias("r_key"), digest.alias("read"))
    return a.join(b, F.col(key) == F.col("r_key"), "full").where(~F.col("written").eqNullSafe(F.col("read")))
