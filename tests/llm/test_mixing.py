import math
import hashlib
import re
from collections import defaultdict

import pytest

from chapterloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target double"


def filled(sizes, weights, share=1.5, cap=2.0):
    """Water filling by rounds: who is above its stop stops, the excess goes to the others."""
    total, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        left = total - sum(out.values())
        given = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in given if given[s] > cap * sizes[s]]
        if not over:
            return out | given
        for s in over:
            out[s] = cap * sizes[s]
            del open_[s]
    return out


def test_targets_and_taken(spark):
    rows = [(i, "word " * (1 + i * 7 % 23), "abcde"[min(i % 9, 4)] if i % 10 else None, 1, 1.0) for i in range(400)]
    rows += [(900, None, "a", 1, 1.0), (901, "", None, 1, 1.0), (902, " \n", "zero", 1, 1.0), (5, "word " * 9, "a", 1, 1.0), (5, "word " * 9, "a", 1, 1.0)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(mixing.WORD, text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) < 1
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    for s in sizes:  # in the order of keys: whole extra copies, one partial document, then none
        extra = [(r.taken - r.epochs * r.size, r.size) for r in sorted((r for r in found if r.source == s and r.size), key=lambda r: (r.sample_key, r.doc_id))]
        states = ["all" if t == n else "none" if t == 0 else "part" for t, n in extra]
        assert states == sorted(states, key=["all", "part", "none"].index) and states.count("part") <= 1


def test_key_is_exponential_over_quality(spark):
    r = mixing.mix(spark.createDataFrame([(42, "some plain words here", "s", 0, 0.0)], SCHEMA)).first()
    u = (int(hashlib.sha256(b"42:20").hexdigest()[:12], 16) + 0.5) / (1 << 48)
    assert r.sample_key == pytest.approx(-math.log(u) / 2.0)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
