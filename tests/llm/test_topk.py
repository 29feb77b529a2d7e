import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from chapterloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, block int"


def brute(rows, k, every=20):
    vectors = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in vectors:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("spread, scale", [(0.1, 1), (0.6, 1), (0.1, 3e4)])
def test_equals_brute_force(spark, spread, scale):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [scale * (x + rng.gauss(0, spread)) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 16) for i in range(90)] + [(2000, None), (2020, []), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0]), (2100, [float("inf")] * 16)]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    found = topk.top_k(frame).collect()
    assert {tuple(r) for r in found} == brute(rows, 20) and len(found) == len(set(found))


def test_blocks_stop_early_and_late():
    rng = np.random.default_rng(3)
    for shape, low, high in ((64, -20, 20), (8, -3, 3), (4, -(1 << 20), 1 << 20)):
        m = rng.integers(low, high, (700, shape))
        m[:50] *= 7
        q = m[:40]
        ids = np.arange(700) * 3
        exact = q @ m.T
        none = np.full(40, topk.NONE)
        a, b, s = topk.search_block(q, ids[:40], none, topk.segments(m), m, ids, 20)
        got = {(int(x), int(y), int(z)) for x, y, z in zip(a, b, s)}
        want = set()
        for i in range(40):
            order = sorted((j for j in range(700) if j != i), key=lambda j: (-exact[i, j], j))[:20]
            want |= {(i, j, int(exact[i, j])) for j in order}
        assert got == want
        floors = np.sort(exact, axis=1)[:, -5]
        a, b, s = topk.search_block(q, ids[:40], floors, topk.segments(m), m, ids, 20)
        assert {(int(x), int(y), int(z)) for x, y, z in zip(a, b, s)} == {(i, j, x) for i, j, x in want if x >= floors[i]}


def test_many_blocks_share_one_index(spark, monkeypatch):
    """Ten blocks of rows and several of queries: a floor carried from the first block loses nothing, ties included."""
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 12).astype(np.float32).tolist()) for i in range(300)] + [(300 + i, [0.25] * 12) for i in range(100)]
    written = []
    kept = topk.common.materialise
    monkeypatch.setattr(topk.common, "materialise", lambda df, name: written.append(name) or kept(df, name))
    found = topk.top_k(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)).collect()
    assert {tuple(r) for r in found} == brute(rows, 20) and len(found) == len(set(found))
    assert written.count("topk-index") == 1


def test_segments_hold_each_posting_once():
    m = np.random.default_rng(1).integers(-40, 40, (30, 5))
    again = np.zeros_like(m)
    impacts = []
    for impact, rows, dims, values in topk.segments(m):
        impacts.append(impact)
        again[rows, dims] += values
        assert (np.frexp(np.abs(values).astype(float))[1] == impact).all()
    assert (again == m).all() and impacts == sorted(impacts, reverse=True)


def test_fewer_rows_than_k_and_repeats(spark):
    rows = [(0, [1.0, 0.0], 0, 0), (5, [0.5, 0.5], 0, 0), (5, [0.5, 0.5], 0, 0), (None, [1.0, 1.0], 0, 0)]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(0, 1, 5, 2048)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 0, 0)], SCHEMA)).count() == 0


def test_oracle_sql_agrees(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(120)]
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM embeddings")
    got = {tuple(r) for r in con.execute(topk.ORACLE).fetchall()}
    assert got == brute(rows, 20)
