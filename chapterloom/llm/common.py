"""What the training-data operators share: the shared folder, written tables and table reads."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_HELD: dict[Hashable, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees: `spark.checkpoint.dir` of the session, or a new one if it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="chapterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return the written table: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that `materialise` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts go to Python in batches of `rows` at most from here on (a smaller setting of the session stays): a bound on
    the memory of workers, which Spark's own default of 10 000 rows does not give where texts are long."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, rows)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The named columns of docs, and row_key: a string of its own for every row, the same whenever docs is read (its file and
    its place there). A table that does not come from Parquet files is written first."""

    def with_key(rows: DataFrame) -> DataFrame:
        return rows.select(*columns, F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("row_key"))

    try:
        return with_key(docs)
    except AnalysisException:
        return with_key(materialise(docs.select(*columns), "keyed"))


def held(key: Hashable, make: Callable[[], T]) -> T:
    """An object that a Python worker keeps between tasks. It keeps one at a time: that of another key goes, so what one
    operator remembers does not add to what the next one does."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]  # type: ignore[return-value]


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; between them, memory that is free goes back to the system. Allocators of Python workers keep it otherwise,
    some hundred MB each, where other processes of the executor need it."""
    for batch in batches:
        yield batch
        del batch
        gc.collect(0)
        pa.default_memory_pool().release_unused()
        if _TRIM:
            _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: nothing to ask
    _TRIM = None
