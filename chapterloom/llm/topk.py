"""Exact top-k inner-product search over an impact-ordered index, score at a time.

The index is a written table with one row a block of ROWS vectors: the block's postings (dimension, row, value) in segments
by quantised impact, the bit length of |value|, highest first, and beside them the whole vectors for rescoring. A block of
queries walks a block's segments by descending impact and adds query x value into its accumulators; what unread segments can
still add to a row is at most |query| times the norm of the row's unread values. The walk stops when that proves that all but
a few rows are below the query's k-th score, or when nothing is unread; rows that may be members are then rescored exactly.

Scale: each block of queries first walks one block of rows. The k-th score it finds there is a floor that goes with the query
to all other blocks, where rows that cannot reach it are never rescored nor passed on. Blocks of queries (the light side) meet
blocks of rows by the block's number; a task holds one block of each, and a window keeps the best k of a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROWS, QUERIES = 4096, 512
#: Rows a query may still have to check when the walk stops early, as a multiple of k.
SPARE = 4
#: The share of a block's squared values that may be unread when a proof is first tried.
UNREAD = 0.3
#: The floor of a query that has found fewer than k rows.
NONE = -(1 << 63)

Segment = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def quantised(embedding: Column, scale: float = 64.0) -> Column:
    return F.transform(embedding, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, bad), F.lit(True))


def _matrix(vectors: list) -> np.ndarray:
    """Rows padded with zeros to the longest vector."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes that hold them all."""
    low, high = values.min(initial=0), values.max(initial=0)
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _integers(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // count}") if count else np.zeros(0, np.int64)


def segments(matrix: np.ndarray) -> list[Segment]:
    """(impact, rows, dimensions, values) of the postings of each quantised impact, highest first; zeros have none."""
    rows, dims = np.nonzero(matrix)
    values = matrix[rows, dims]
    impact = np.frexp(np.abs(values).astype(np.float64))[1]
    order = np.argsort(-impact, kind="stable")
    rows, dims, values, impact = rows[order], dims[order], values[order], impact[order]
    cuts = np.flatnonzero(np.diff(impact)) + 1
    return [(int(i[0]), r, d, v) for i, r, d, v in zip(np.split(impact, cuts), np.split(rows, cuts), np.split(dims, cuts), np.split(values, cuts), strict=True)] if len(rows) else []


def search_block(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, walk: list[Segment], matrix: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of each query's k best rows of a block that score its floor or more; ids ascend, and a
    row with the query's id is left out. `walk` are the block's segments, highest impact first."""
    width, n = max(queries.shape[1], matrix.shape[1]), len(ids)
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(1, width)
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64  # sums are exact in it
    wide = queries.astype(kind)
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    unread = (matrix.astype(np.float64) ** 2).sum(axis=1)
    left, first = unread.sum(), UNREAD * unread.sum()
    acc = np.zeros((len(queries), n), kind)
    own = query_ids[:, None] == ids[None, :]
    keep = min(k, n)
    plane = np.zeros((n, width), kind)
    for at, (_, rows, dims, values) in enumerate(walk):
        plane[rows, dims] = values
        energy = values.astype(np.float64) ** 2
        unread -= np.bincount(rows, energy, n)
        left -= energy.sum()
        if at + 1 < len(walk) and left > first:
            continue  # too much unread for a proof: the next segment joins this one's product
        acc += wide @ plane.T
        if at + 1 == len(walk):
            break
        plane[:] = 0
        slack = norm[:, None] * np.sqrt(np.maximum(unread, 0.0))[None, :] * (1 + 1e-6) + 1e-3
        low = np.where(own, -np.inf, acc - slack)
        least = np.maximum(np.partition(low, n - keep, axis=1)[:, n - keep], floors.astype(np.float64))
        # One unit below: a floor beyond 2^53 is rounded as a double.
        member = (acc + slack >= least[:, None] - 1 - np.abs(least[:, None]) * 1e-15) & ~own
        if member.sum() <= SPARE * keep * len(queries):
            q, r = np.nonzero(member)
            return _best(q, r, np.einsum("ij,ij->i", queries[q, : matrix.shape[1]].astype(np.int64), matrix[r].astype(np.int64)), floors, k)
    # All read: scores are exact.
    if kind is np.int64 or largest * n >= 1 << 53:
        q, r = np.nonzero(~own)
        return _best(q, r, acc[q, r].astype(np.int64), floors, k)
    # A rank by score, then id, in one number.
    rank = acc.astype(np.float64) * n + (n - 1 - np.arange(n))[None, :]
    rank[own] = -np.inf
    r = np.argpartition(rank, n - keep, axis=1)[:, n - keep :].ravel()
    q = np.repeat(np.arange(len(queries)), keep)
    kept = ~own[q, r]
    return _best(q[kept], r[kept], acc[q[kept], r[kept]].astype(np.int64), floors, k)


def _best(q: np.ndarray, r: np.ndarray, score: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    high = score >= floors[q]
    q, r, score = q[high], r[high], score[high]
    order = np.lexsort((r, -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k], score[place < k]


SEGMENTS = "segments array<struct<impact:int,n:int,rows:binary,dims:binary,vals:binary>>"


def _indexed(vectors: DataFrame, blocks: int) -> DataFrame:
    """The index: one row a block with its ids (ascending), its segments (highest impact first) and its whole vectors."""

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        matrix = _matrix(frame["v"].tolist())
        walk = [{"impact": i, "n": len(v), "rows": _narrow(r).tobytes(), "dims": _narrow(d).tobytes(), "vals": _narrow(v).tobytes()} for i, r, d, v in segments(matrix)]
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "width": [matrix.shape[1]], "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "segments": [walk], "vectors": [_narrow(matrix).tobytes()]})

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    return vectors.withColumn("block", block).groupBy("block").applyInPandas(built, f"block int, width int, ids binary, {SEGMENTS}, vectors binary")


def _asked(vectors: DataFrame, parts: int) -> DataFrame:
    """One row a block of queries: ids (ascending), vectors and floors."""

    def gathered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        matrix = _matrix(frame["v"].tolist())
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "q_width": [matrix.shape[1]], "q_ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "q_vectors": [_narrow(matrix).tobytes()], "floors": [frame["floor"].to_numpy("<i8").tobytes()]})

    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    return vectors.withColumn("part", part).groupBy("part").applyInPandas(gathered, "part int, q_width int, q_ids binary, q_vectors binary, floors binary")


def _walked(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the best k of every pair of a block of queries and a block of the index."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, q_ids, floors = (np.frombuffer(row[c], "<i8") for c in ("ids", "q_ids", "floors"))
                matrix = _integers(row["vectors"], len(ids) * row["width"]).reshape(len(ids), -1)
                queries = _integers(row["q_vectors"], len(q_ids) * row["q_width"]).astype(np.int64).reshape(len(q_ids), -1)
                walk = [(s["impact"], *(_integers(s[c], s["n"]) for c in ("rows", "dims", "vals"))) for s in row["segments"]]
                q, r, score = search_block(queries, q_ids, floors, walk, matrix, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids[r]), pa.array(score)], names=["query_id", "vec_id", "score"])

    held = pairs.select("ids", "width", "segments", "vectors", "q_ids", "q_width", "q_vectors", "floors")
    return held.mapInArrow(searched, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, *, k: int = 20, query_every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Args:
        vectors: vec_id long, embedding array of floats; other columns are ignored, whatever their names.
        query_every: the queries are the rows whose vec_id is divisible by it.
    A component x counts as floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with
    a null vec_id, take no part; a shorter vector is padded with zeros. Rows are one per vec_id: of repeated ids the
    smallest vector stays. A query never finds its own id; it finds all others if they are fewer than k. An empty table
    gives no rows. Scores must fit a long.
    """
    id_ = F.col("vec_id").cast("long")
    clean = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(id_.alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"))
    clean = common.materialise(clean.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-vectors")
    asked = clean.where(F.col("vec_id") % query_every == 0)
    n, m = clean.count(), asked.count()
    blocks, parts = max(1, math.ceil(n / ROWS)), max(1, math.ceil(m / QUERIES))
    index = common.materialise(_indexed(clean, blocks), "topk-index")
    home = F.pmod("part", F.lit(blocks)).cast("int")

    start = _asked(asked.withColumn("floor", F.lit(NONE)), parts).withColumn("block", home)
    begun = common.materialise(_walked(index.join(start, "block"), k), "topk-first")
    if blocks == 1:
        found = begun
    else:
        # A query's k-th score in its first block: no row below it is among its k best.
        floors = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        known = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("floor", F.lit(NONE)).alias("floor"))
        query = _asked(known, parts)
        others = query.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(F.col("block") != home)
        found = begun.unionByName(_walked(index.join(others, "block"), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
