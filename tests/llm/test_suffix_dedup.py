import hashlib
import random

import numpy as np
import pytest

from chapterloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, kept binary, spans int"


def brute(rows, length):
    """Removed positions of each row by the definition."""
    first = {}
    for doc, text in rows:
        data, key = (text or "").encode(), sd.NONE if doc is None else doc
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, key), key)
    out = []
    for doc, text in rows:
        data, key = (text or "").encode(), sd.NONE if doc is None else doc
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < key:
                gone[i : i + length] = True
        out.append((doc, data, gone))
    return out


def check(spark, rows, length=50, gram=30):
    found = sd.remove_repeats(spark.createDataFrame([(d, t, None, 1) for d, t in rows], SCHEMA), length=length, gram=gram, keep_bytes=True).collect()
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found)
    want = []
    for doc, data, gone in brute(rows, length):
        kept = data[:0] + bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((doc is None, doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    assert got == sorted(want)


def sample(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice(["ab ", "é", "of the ", "zu", "𠮷", "x", "\n", "who "]) for _ in range(n))
    shared = [say(rng.choice([10, 20, 40, 120])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [say(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared)[rng.randrange(0, 6) :], say(rng.randrange(0, 12))]
        rows.append((i * 7 % 61, "".join(parts)))
    base = rows[3][1] * 3
    rows += [(200, base), (201, base), (202, base[:-3] + "q" + base[5:]), (203, "ab" * 400), (204, "ab" * 300), (205, "z" * 49), (206, "z" * 49), (207, "z" * 50), (208, "z" * 51)]
    return rows + [(300, None), (301, ""), (None, base), (200, base)]


@pytest.mark.parametrize("seed, length, gram", [(1, 50, 30), (2, 50, 30), (3, 20, 10), (4, 60, 12)])
def test_equals_brute_force(spark, seed, length, gram):
    check(spark, sample(seed), length, gram)


def test_chunks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 500)
    long = "".join(random.Random(9).choice("abcdefgh ") for _ in range(30_000))
    check(spark, [(1, long), (0, long[5000:5200] + "new" + long[:100]), (5, "x" + long[100:])])


def test_chunks_without_anchors(spark, monkeypatch):
    check(spark, [(1, None), (2, ""), (3, "short"), (4, "short"), (None, "z" * 49)])
    monkeypatch.setattr(sd, "CHUNK_BYTES", 100)
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(300))
    check(spark, [(i, text) for i in range(12)])


def test_disk_backed_queues_give_the_sorted_suffixes(monkeypatch):
    rng = np.random.default_rng(1)
    contexts = rng.integers(1, 4, (200, 12)).astype(np.int16)
    contexts[50:90] = contexts[:40]
    contexts[:20, 9:] = 0
    for limit, batch in ((10, 7), (10, 1 << 16), (1_000_000, 64)):
        monkeypatch.setattr(sd, "BATCH", batch)
        for start, queues in sd.sorted_suffixes(sd.Contexts.of(contexts), 11, limit):
            tuples = np.concatenate(list(queues.read()))
            suffixes = [tuple(contexts[c, start:]) for c in tuples["context"]]
            assert suffixes == sorted(suffixes) and sorted(tuples["context"]) == list(range(200))
            for a, b, prefix in zip(suffixes, suffixes[1:], tuples["prefix"][1:], strict=False):
                assert prefix == next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


def test_long_runs_cost_one_record(spark):
    """Every place of a run of equal bytes is an anchor."""
    data = np.full(1_000_000, 32, np.uint8)
    chunk = sd.Chunk(np.array([7], "<i8").tobytes(), np.array([len(data)], "<i8").tobytes(), sd.zstandard.ZstdCompressor().compress(data.tobytes()))
    number, position, hashes = chunk.anchored(50, 30)
    records, group = sd._distinct(chunk, number, position, hashes, 50, 30)
    assert len(position) == 999_971 == len(group) and len(records) == 41 and set(records["doc"]) == {7}
    check(spark, [(1, " " * 60_000), (2, "a" + " " * 30_000 + "b"), (3, " " * 80_000)])


def test_shards_beyond_memory(spark, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_RECORDS", 40)
    check(spark, sample(7))
    rng = np.random.default_rng(4)
    records = np.zeros(900, sd._records(70))
    records["doc"] = rng.integers(0, 300, 900)
    records["bytes"] = rng.integers(97, 99, (30, 70))[rng.integers(0, 30, 900)]
    records["bytes"][:, 60:] = rng.integers(97, 98, (900, 10)) + rng.integers(0, 2, (900, 1))
    records["hash"] = [int.from_bytes(hashlib.sha256(r[20:50].tobytes()).digest()[:6], "big") for r in records["bytes"]]  # of the anchor
    records["inside"] = 20 * 256 + 20
    spool = sd.Spool(records.dtype, 100)
    for part in np.split(records, 9):
        spool.add(part)
    assert spool.file and (spool.all() == records).all()
    assert (sd._judged_ranges(spool.all(), 50, 30, 100) == sd._shard_repeats(records, 50, 30)).all()


def test_no_table_stays_in_the_catalog(spark):
    found = sd.remove_repeats(spark.createDataFrame([(1, "x" * 60, None, 1), (2, "x" * 60, None, 1)], SCHEMA))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("repeats_chunks")]
    assert sorted((r.doc_id, r.n_removed) for r in found.collect()) == [(1, 0), (2, 60)]


def test_equal_strings_share_their_anchors():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    at, _ = sd.anchors(data, 50, 30)
    at = set(at.tolist())
    other = np.concatenate((rng.integers(97, 100, 77).astype(np.uint8), data[1000:1050], rng.integers(97, 100, 60).astype(np.uint8)))
    inside = {i for i in range(1000, 1021) if i in at}
    found = set(sd.anchors(other, 50, 30)[0].tolist())
    assert any(i - 1000 + 77 in found for i in inside)
    for start in range(0, 2951):
        assert any(i in at for i in range(start, start + 21))


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
