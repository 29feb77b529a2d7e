"""Running lineage and story of releases against plain loops."""

import hashlib
import random

import pytest

from chapterloom.operators import summaries

SHORTS = "release_id string, chapter_number int, content string, chapter_hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def chapters():
    """(release, number, content, hash) with repeated and null hashes, empty and null contents, a null release."""
    rng = random.Random(4)
    rows = []
    for release, n in (("a", 700), ("b", 3), ("c", 1), (None, 40)):
        numbers = list(range(1, n + 1))
        rng.shuffle(numbers)
        rows += [(release, i, rng.choice(["", None, "é𝄞", "x y"]), rng.choice([None, "same", *(sha(str(rng.random())) for _ in range(6))])) for i in numbers]
    return rows


def releases(rows):
    for release in {r[0] for r in rows}:
        yield release, sorted((r for r in rows if r[0] == release), key=lambda r: r[1])


@pytest.mark.parametrize("hashed", [1 << 30, 500_000])
def test_lineage_equals_a_loop(spark, chapters, monkeypatch, hashed):
    """Also with a release cut into parts. No window gathers hashes: that was a set of all of them for every chapter."""
    monkeypatch.setattr(summaries, "HASHED", hashed)
    wanted = {}
    for release, rows in releases(chapters):
        known = set()
        for _, number, _, h in rows:
            known |= {h} - {None}
            wanted[release, number] = sha("|".join(sorted(known)))
    found = summaries.lineage_hash(spark.createDataFrame(chapters, SHORTS))
    assert "collect_" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert len(got) == len(chapters) and {(r.release_id, r.chapter_number): r.lineage for r in got} == wanted


def test_equal_chapters_share_a_lineage(spark):
    rows = [("a", 1, "", "q"), ("a", 2, "", "z"), ("a", 2, "", "z"), ("a", 2, "", "k"), ("a", 3, "", "z")]
    found = sorted((r.chapter_number, r.lineage) for r in summaries.lineage_hash(spark.createDataFrame(rows, SHORTS)).collect())
    assert found == sorted([(1, sha("q")), (2, sha("k|q")), (2, sha("k|q|z")), (2, sha("k|q|z")), (3, sha("k|q|z"))])


def test_lineage_over_split_blocks(monkeypatch):
    monkeypatch.setattr(summaries, "BLOCK", 4)
    rng = random.Random(7)
    members = [rng.randbytes(rng.randrange(1, 9)).hex().encode() for _ in range(300)]
    for start in (0, 1, 50):
        known = set(members[:start])
        lineage = summaries._Lineage(sorted(known))
        assert lineage.digest() == hashlib.sha256(b"|".join(sorted(known))).hexdigest()
        for m in members[start:]:
            if m not in known:
                known.add(m)
                lineage.add(m)
                assert lineage.digest() == hashlib.sha256(b"|".join(sorted(known))).hexdigest()


@pytest.mark.parametrize("every", [1, 3])
def test_story_equals_a_loop(spark, chapters, every):
    """No window gathers lines: that was the text of all of them for every chapter."""
    wanted = {}
    for release, rows in releases(chapters):
        lines = []
        for _, number, content, _ in rows:
            if content:
                lines.append(f"第{number}章：{content}")
                if number % every == 0:
                    wanted[release, number] = (len("\n".join(lines)), sha("\n".join(lines)))
    found = summaries.story_so_far(spark.createDataFrame(chapters, SHORTS), every)
    assert "collect_" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert len(got) == len(wanted) and {(r.release_id, r.chapter_number): (r.n_chars, r.story_hash) for r in got} == wanted
