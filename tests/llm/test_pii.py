import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chapterloom.llm import pii

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None,
    "",
    "no data here, v1.2 and 12-34.",
    "mail a.b_c%d+e-f@x-y.co.uk_z@q.de, also bad@@host.x and @x.y é𠮷 z@b.c.",
    "a@b.c@d.e f@g.h..i user@nodots then x@y.z-",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 0255.000.1.99 99999999999999999999.1.1.1 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005 and 4111  1111 1111 1111 0000000000000000000",
    "12345678901234567890 1-2-3-4-5-6-7-8-9-0-1-2 79927398713",
    "call +1 (212) 555-0100. or +44 20 7946 0958 ext, +1-2, +123456789012345678, ++1 234 567 890 5",
    "all: x@y.zz 10.0.0.1 4111111111111111 +1 234 567 8901\nü é +4111111111111111",
    "9" * 20000 + " " + "a." * 20000 + "@ " + "1." * 9000 + "+" + "(" * 5000,
]


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def stated(text):
    out = []
    for no, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            digits = sum(c.isdigit() for c in m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= digits <= 19 and luhn(m.group()), "phone": 9 <= digits <= 15}[kind]
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, kept string, spans int")


def test_base_spans_equal_the_stated_patterns(spark):
    found = {r.doc_id: r for r in pii.digest(pii.find(frame(spark, TEXTS))).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        spans = stated(text or "")
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert found[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (i, line, found[i].spans)
        for kind in STATED:
            assert found[i][f"n_{kind}"] == sum(s[3] == kind for s in spans)


def test_terms_that_disclose_a_value(spark):
    texts = [f"filler{i} Quixotl wrote to boss@corp.example today about case {i} with others" for i in range(4)]
    texts += [f"others wrote to plain things today {i} about filler with" for i in range(60)]
    texts += ["Quixotl alone"] * 1 + ["only once zyx@one.example uniqueword"] * 5
    rows = pii.find(frame(spark, texts), share=0.9).collect()
    for r in rows:
        base = [s.kind for s in r.base]
        added = [(s.start, s.end) for s in r.spans if s.kind == "term"]
        text = texts[r.doc_id]
        if r.doc_id < 4:
            assert base == ["email"] and [text[a:b] for a, b in added] == ["Quixotl", "case"]
        else:
            assert not added  # no value, or too few different texts


def test_terms_of_rare_values_are_marked_in_every_document(spark, tmp_path):
    """As the query calls it: a value of one text counts, and its terms go from texts without the value too."""
    from chapterloom.llm import queries

    texts = ["Xanthippe Zyx wrote to only@one.example today"]
    texts += [f"Quixotl wrote to boss@corp.example today {i % 3}" for i in range(8)] + ["Quixotl alone", None, ""]
    texts += ["others wrote to plain things alone today"] * 1000
    frame(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s.startswith("term")] for r in queries.op9_disclosing_terms(spark, f"file://{tmp_path}").collect()}
    words = {i: [(texts[i] or "")[int(a) : int(b)] for _, a, b in spans] for i, spans in found.items()}
    assert len(found) == len(texts) and words[0] == ["Xanthippe", "Zyx"]
    assert all(words[i] == ["Quixotl"] for i in range(1, 10))
    assert not any(words[i] for i in range(10, len(texts)))


def test_replaced(spark):
    texts = ["x a@b.cc y +1 234 567 8901 z", "4111111111111111", "none", ""]
    got = pii.find(frame(spark, texts), keep=("text",)).select("doc_id", pii.replaced(F.col("text"), F.col("spans")).alias("out")).collect()
    assert {r.doc_id: r.out for r in got} == {0: "x [EMAIL] y [PHONE] z", 1: "[CARD]", 2: "none", 3: ""}


def test_repeats_and_null_ids(spark):
    rows = [(1, "a@b.cc", None, 1), (1, "a@b.cc", None, 1), (None, "a@b.cc", "q", None)]
    found = pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string, kept string, spans int"))).collect()
    assert len(found) == 3 and {r.spans for r in found} == {"email:0:6"}


def test_empty_table(spark):
    assert pii.find(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.find(frame(spark, TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
