import numpy as np
import pytest
from tokenizers import Tokenizer

from chapterloom.llm import token_counts, tokens

TEXTS = ["", None, "one line", "a\nb\n\n\nc d e\n", "\n\n", "é𠮷 x\n  y\nz, it's\n" * 50, "x" * 5000 + "\n", "a<|endoftext|>\nb", "ends <|endoftext|>", " lead", "a \n b", "🙂🙃\n🙂"]


def brute(text, starts, rule):
    t = Tokenizer.from_file(tokens.default_path())
    offsets = t.encode(text, add_special_tokens=False).offsets
    ends = [*starts[1:], max(len(text), starts[-1])]
    held, crossing = [0] * len(starts), [0] * len(starts)
    for a, b in offsets:
        inside = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
        touched = [i for i, n in enumerate(inside) if n]
        at = {"first": touched[0], "last": touched[-1], "majority": max(touched, key=lambda i: (inside[i], -i))}[rule]
        held[at] += 1
        crossing[at] += len(touched) > 1
    return held, crossing, len(offsets)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines(spark, rule):
    rows = [(i, t, "k", 5) for i, t in enumerate(TEXTS)] + [(None, "x\ny", "k", 5), (2, "one line", "k", 5)]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, bounds string, section int"), rule=rule).collect()
    assert sum(r.doc_id is None for r in found) == 2 and sum(r.doc_id == 2 for r in found) == 2
    for i, text in enumerate(TEXTS):
        text = text or ""
        if i == 2:
            continue
        starts = [0, *(j + 1 for j, c in enumerate(text) if c == "\n" and j + 1 < len(text))]
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
        assert [r.start for r in own] == starts and own[-1].end == len(text)
        held, crossing, total = brute(text, starts, rule)
        assert [r.n_tokens for r in own] == held and [r.n_crossing for r in own] == crossing
        assert {r.doc_tokens for r in own} == {total} and sum(held) == total


def test_given_sections(spark):
    rows = [(1, "hello wonderful world", [3, 9]), (2, "abc", None), (3, "abc", [0, 2, 50, None])]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, cuts array<int>"), sections="cuts").collect()
    own = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in found}
    assert own[2, 0] == (0, 3, 1) and own[3, 2][:2] == (50, 50) and own[3, 2][2] == 0
    assert brute("hello wonderful world", [0, 3, 9], "majority")[0] == [own[1, i][2] for i in range(3)]


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
