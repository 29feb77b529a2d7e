import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chapterloom.llm import fingerprints

SCHEMA = "doc_id long, text string, keys string, range int"


def paragraphs(text):
    """Lines cut after stops, long ones every LONGEST characters."""
    return set(re.findall(r"[^\n.!?]{1,%d}[\n.!?]*|[\n.!?]+" % fingerprints.LONGEST, text))


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def sample_texts():
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice(["alpha ", "beta ", "gamma ", "é𠮷 ", "one. ", "two!\n", "?\n\n"]) for _ in range(n))
    texts = {i * 3: say(rng.choice([1, 5, 60, 300])) for i in range(40)}
    texts |= {500: "", 501: None, 502: "x" * 1500, 503: say(9000), 504: say(9000), 505: "\n\n.", 4_000_000_000: texts[3], 4_000_000_001: texts[3]}
    return texts


def test_fingerprints_equal_brute_force(spark):
    texts = sample_texts()
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in texts.items()], SCHEMA)
    found = {r.doc_id: r for r in fingerprints.fingerprint(frame).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(found) == sorted(texts)
    by_text = {}
    for i, doc in enumerate(order):
        text, after, r = texts[doc] or "", texts[order[(i + 1) % len(order)]] or "", found[doc]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(text, edited)) and r.near_next == pytest.approx(jaccard(text, after))
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_peeling_recovers_differences_of_all_sizes(spark):
    rng = random.Random(9)
    rows = []
    for n in (0, 1, 4, 9, 20, 60, 200, 900):
        for shared in (0, 3, 150):
            keys = [rng.getrandbits(64) - (1 << 63) for _ in range(2 * n + shared)]
            rows.append((keys[: n + shared], keys[n:], n))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    d = fingerprints.difference(F.col("a"), F.col("b"), fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))
    for r in frame.select("n", d.alias("d")).collect():
        assert (r.d.plus, r.d.minus) == (r.n, r.n)


def test_ties_single_rows_and_nulls(spark):
    one = fingerprints.fingerprint(spark.createDataFrame([(7, "abc. def. ghi.", "", 0)], SCHEMA)).first()
    assert one.near_next == 1.0 and one.n_chars == 14
    rows = [(1, "a. b.", "", 0), (1, "a. b.", "", 0), (1, "c.", "", 0), (None, "d.", "", 0)]
    assert fingerprints.fingerprint(spark.createDataFrame(rows, SCHEMA)).count() == 4
    assert fingerprints.fingerprint(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fingerprints.fingerprint(spark.createDataFrame([(7, "abc", "", 0)], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
