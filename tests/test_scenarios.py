"""Small scenarios with outcomes worked out by hand, and folds against plain loops."""

import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from chapterloom.functions import answers, levels, text, udfs
from chapterloom.operators import events, glossary, graph, merge, packets, quality, summaries
from chapterloom.sources import epub, html, tables

EVENT = "event_id long, event_us long, run_id string, release_id string, stage_name string, chapter_number int, block_id string, severity string, event_type string, k int, score double"


def event(i, kind, **more):
    row = {"event_id": i, "event_us": i * 1_000_000, "run_id": "r", "release_id": "b", "stage_name": kind.rsplit(".", 1)[0], "chapter_number": 1, "block_id": "blk-1", "severity": "info", "event_type": kind, "k": 1, "score": 0.0}
    return tuple((row | more).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def test_sampling_keeps_first_and_every_third(spark):
    rows = [event(i, "t.paragraph_completed") for i in range(1, 11)] + [event(20, "t.failed"), event(21, "t.paragraph_started", severity="error")]
    kept = {r.event_id for r in events.persisted(frame(spark, rows), every=3).collect()}
    assert kept == {1, 3, 6, 9, 20, 21}


def test_levels(spark):
    cases = {("s.started", "info"): 1, ("s.chapter_started", "info"): 2, ("s.paragraph_completed", "info"): 3, ("s.retry", "info"): 4, ("s.validation_failed", "info"): 4, ("paragraph_retry", "info"): 4, ("x", "info"): 1, ("s.retry", "error"): 0, ("s.started", "debug"): 4}
    got = spark.createDataFrame(list(cases), "t string, s string").select("t", "s", levels.event_level(F.col("t"), F.col("s")).alias("l")).collect()
    assert {(r.t, r.s): r.l for r in got} == cases


def test_stage_progress_and_active_chapter(spark):
    rows = [event(1, "t.started", k=12), event(2, "t.chapter_started", chapter_number=1), event(3, "t.chapter_completed", chapter_number=1), event(4, "t.chapter_completed", chapter_number=2), event(5, "t.chapter_skipped", chapter_number=3), event(6, "t.chapter_started", chapter_number=4)]
    r = events.stage_progress(frame(spark, rows)).first()
    assert (r.total, r.completed, r.active_chapter) == (12, 3, 4)


def test_chapter_status_fold(spark):
    rows = [event(1, "t.chapter_started", chapter_number=1), event(2, "t.chapter_started", chapter_number=2), event(3, "t.chapter_completed", chapter_number=2, k=3), event(4, "t.paragraph_skipped", chapter_number=3), event(5, "t.chapter_completed", chapter_number=3, k=3), event(6, "t.failed", chapter_number=4), event(7, "t.chapter_completed", chapter_number=5, k=10)]
    got = {r.chapter_number: r.status for r in events.chapter_status(frame(spark, rows)).collect()}
    assert got == {1: "in-progress", 2: "complete", 3: "high-risk", 4: "failed", 5: "failed"}


def test_block_progress(spark):
    rows = [event(0, "t.paragraph_started"), event(1, "t.paragraph_completed"), event(2, "t.paragraph_started", block_id="blk-2"), event(3, "x.y", severity="warning", block_id=None), event(7383, "x.z", severity="error", block_id=None)]
    r = events.block_progress(frame(spark, rows)).first()
    assert (r.completed_blocks, r.seen_blocks, r.warnings, r.failures, r.elapsed) == (1, 2, 1, 1, "2:03:03")


def plain_intervals(rows):
    """The fold as a loop."""
    out, cur = [], None
    for chapter, target, lore, masked, confidence in rows:
        if cur and (cur["t"] == target or cur["s"] == chapter):
            cur["l"] = cur["l"] if cur["l"] is not None else lore
            cur["m"], cur["c"] = cur["m"] or masked, max(cur["c"], confidence)
        else:
            if cur:
                cur["e"] = chapter - 1
                out.append(cur)
            cur = {"t": target, "s": chapter, "e": None, "l": lore, "m": masked, "c": confidence}
    return [tuple(c.values()) for c in [*out, cur]]


def test_relationship_intervals_equal_a_loop(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for key in range(60):
        own = sorted((rng.randrange(1, 9), f"t{rng.randrange(4)}", i, rng.choice([None, "a", "b"]), rng.random() < 0.3, round(rng.random(), 2)) for i in range(rng.randrange(1, 14)))
        want[f"s{key}"] = plain_intervals([(c, t, lo, m, x) for c, t, _, lo, m, x in own])
        rows += [("E", f"s{key}", t, c, lo, m, x, i) for c, t, i, lo, m, x in own]
    rng.shuffle(rows)
    got = {}
    observed = spark.createDataFrame(rows, "edge_type string, source_id string, target_id string, chapter_number int, lore_text string, is_masked boolean, confidence double, row_index int")
    for r in graph.relationship_intervals(observed).orderBy("source_id", "start_chapter").collect():
        got.setdefault(r.source_id, []).append((r.target_id, r.start_chapter, r.end_chapter, r.lore_text, r.is_masked, r.confidence))
    assert got == want


def test_role_transition_and_visibility(spark):
    rows = [("RANKED_AS", "zhang", "outer", 1, None, False, 0.5, 1), ("RANKED_AS", "zhang", "elder", 2, None, False, 0.5, 2)]
    rel = graph.relationship_intervals(spark.createDataFrame(rows, "edge_type string, source_id string, target_id string, chapter_number int, lore_text string, is_masked boolean, confidence double, row_index int"))
    got = {r.target_id: (r.start_chapter, r.end_chapter) for r in rel.collect()}
    assert got == {"outer": (1, 1), "elder": (2, None)}
    assert [r.target_id for r in rel.where(graph.visible(F.lit(1))).collect()] == ["outer"]
    assert [r.target_id for r in rel.where(graph.visible(F.lit(9))).collect()] == ["elder"]


def test_duplicate_target_blocks_promotion(spark):
    rows = [("r", "青云门", "faction", "Azure Sect"), ("r", "苍云门", "faction", "Azure Sect"), ("r", "剑", "item", "Sword"), ("r", "空", "item", ""), ("r", "中", "item", "中")]
    c = spark.createDataFrame(rows, "release_id string, norm string, category string, target string")
    locked = spark.createDataFrame([("剑", "item", "Sword")], "norm string, category string, target string")
    assert [r.norm for r in glossary.promotions(c, locked).collect()] == ["剑"]
    reasons = {(r.norm, r.reason) for r in glossary.conflicts(c, locked).collect()}
    assert ("青云门", "duplicate_target") in reasons and ("空", "naming_policy: empty target") in reasons and ("中", "naming_policy: CJK in target") in reasons


def test_contained_terms_beyond_the_broadcast_bound(spark):
    texts = spark.createDataFrame([(1, "abc def"), (2, "xyz"), (3, "a")], "id int, text string")
    terms = spark.createDataFrame([("bc d",), ("yz",), ("a",), ("",), ("q",)], "term string")
    small, large = (sorted((r.id, r.term) for r in glossary.contained_terms(texts, terms, "text", "term", size_bound=n).collect()) for n in (100, 1))
    assert small == large == [(1, "a"), (1, "bc d"), (2, "yz"), (3, "a")]


def test_glossary_beats_alias(spark):
    blocks = spark.createDataFrame([(1, "b1", "青云门的张三")], "doc_id long, block_id string, block_text string")
    aliases = spark.createDataFrame([("青云门", "e1"), ("张三", "e2")], "alias_text string, entity_id string")
    g = spark.createDataFrame([("青云门", "Azure", "faction", "zh")], "source_term string, target_term string, category string, lang string")
    none = spark.createDataFrame([], "source_text string, rendering string")
    assert [r.alias_text for r in glossary.alias_precedence(blocks, aliases, g, none).collect()] == ["张三"]


def test_upsert_rules(spark):
    a = spark.createDataFrame([("x", 3, 5, "old", None)], "k string, low int, n int, t string, keep string")
    b = spark.createDataFrame([("x", 1, 2, "new", "late"), ("y", 9, 9, "only", "y")], "k string, low int, n int, t string, keep string")
    got = {r.k: tuple(r)[1:] for r in merge.merge_latest(a, b, ["k"], {"low": "min", "n": "sum", "t": "incoming", "keep": "coalesce_existing"}).collect()}
    assert got == {"x": (1, 7, "new", "late"), "y": (9, 9, "only", "y")}


def test_deterministic_filter(spark):
    rows = [("三月",), ("2024.1.1",), ("时候",), ("今年",), ("剑",)]
    got = {r.source_term: r.reason for r in glossary.filtered_candidates(spark.createDataFrame(rows, "source_term string")).collect()}
    assert got["三月"] == got["2024.1.1"] == got["今年"] == "deterministic_filter: date_pattern"
    assert got["时候"] == "deterministic_filter: stop_list" and got["剑"] is None and len(text.STOPLIST) == 51


def test_risk_classes(spark):
    score = quality.risk_score(reveal=F.lit(1), pronouns=F.lit(1), placeholders=F.lit(2))
    r = spark.range(1).select(F.round(score, 6).alias("s"), quality.risk_class(score).alias("c")).first()
    assert (r.s, r.c) == (0.36, "MEDIUM")


def test_budget_drops_sections_in_order(spark):
    columns = (*packets.FIXED, *(c for own in packets.DEGRADE.values() for c in own))
    full = dict.fromkeys(columns, "") | {"glossary": "g", "previous_three": "x" * 2000, "aliases": " ", "relationships": "y" * 400, "snippets": "z" * 400}
    s = spark.createDataFrame([(1, *(full[c] for c in columns))], "doc_id long, " + ", ".join(f"{c} string" for c in columns))
    r = packets.budgeted(s, 120).first()
    assert r.degraded == "broad_continuity" and r.fits and r.before > 120 >= r.after
    r = packets.budgeted(s, 3).first()
    assert r.degraded == "broad_continuity|rerank_depth" and not r.fits
    assert packets.budgeted(s, 3000, counter=F.length).first().before == -(-2000 * 105 // 100) + 2 * 420 + 2 + 2


def test_chunks_keep_order_and_text(spark):
    rows = [(1, "alpha beta\n\ngamma delta\n\n" + "w" * 55), (2, "  "), (3, "")]
    got = packets.chunked(spark.createDataFrame(rows, "doc_id long, text string"), 30).orderBy("doc_id", "chunk_index").collect()
    assert [r.chunk for r in got if r.doc_id == 1] == ["alpha beta\n\ngamma delta", "w" * 28, "w" * 27] and {r.doc_id for r in got} == {1}
    assert all(len(r.chunk) <= 30 for r in got)


def test_future_knowledge_and_schema(spark):
    rows = [(1, 5, "in chapter 7 and 第 9 章 and Chapter 3"), (2, 5, "chapter 5")]
    got = summaries.future_knowledge(spark.createDataFrame(rows, "id int, n int, said string"), "said", "n").collect()
    assert [(r.id, r.ahead) for r in got] == [(1, [7, 9])]
    bad = summaries.schema_errors(spark.createDataFrame([(1, '{"tone":"x"}'), (2, None)], "id int, p string"), "p").collect()
    assert all("missing: key_events" in r.errors for r in bad)


def test_normalised_terms(spark):
    rows = [("  《Ab　 C》 ",), ("Straße",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(text.normalise_term(F.col("t"))).collect()] == ["ab c", "strasse"]


def test_placeholders_round_trip():
    for markup in ('<b class="x"><i>文本</i></b>', "plain", "a<br />b", "<em>x</em><hr /><s>y</s>", "<span>x<u>y</u></span>z"):
        placed, tags = udfs.to_placeholders(markup)
        assert udfs.from_placeholders(placed, tags) == (markup, [])
    placed, tags = udfs.to_placeholders("<b>1<i>2<span>3<u>4</u></span></i></b>")
    assert placed == "⟦B_1⟧1⟦I_1⟧2⟦SPAN_1⟧34⟦/SPAN_1⟧⟦/I_1⟧⟦/B_1⟧" and tags["U_1"] == "<u>"
    assert udfs.to_placeholders("x<font>y<b>z</b></font>")[0] == "xy⟦B_1⟧z⟦/B_1⟧"
    assert udfs.from_placeholders("x⟦/B_1⟧y⟦Z_3⟧", {"B_1": "<b>"}) == ("x</b>y⟦Z_3⟧", ["Unexpected closing B_1", "Unknown placeholder Z_3"])
    assert udfs.from_placeholders("⟦B_1⟧x⟦/Q_9⟧", {"B_1": "<b>"})[1] == ["Unknown placeholder Q_9", "Dangling opening B_1"]
    assert udfs.to_placeholders("a & <b")[0] == "a & <b"


@pytest.fixture()
def shelf(tmp_path):
    epub.write_epub([("One", ["first para", "a < b"]), ("Two", ["third"])], str(tmp_path / "a.epub"))
    (tmp_path / "broken.epub").write_bytes(b"not a zip")
    return tmp_path


def test_epub_source(spark, shelf):
    spark.dataSource.register(epub.EpubSource)
    for rows in (epub.read_epubs(spark, f"file://{shelf}").collect(), spark.read.format("epub").load(str(shelf)).collect()):
        good = sorted((r.chapter_number, r.block_order, r.tag, r.block_text) for r in rows if r.error is None)
        assert good == [(1, 1, "h1", "One"), (1, 2, "p", "first para"), (1, 3, "p", "a < b"), (2, 1, "h1", "Two"), (2, 2, "p", "third")]
        assert len([r for r in rows if r.error]) == 1
    names = zipfile.ZipFile(shelf / "a.epub").infolist()
    assert names[0].filename == "mimetype" and names[0].compress_type == zipfile.ZIP_STORED


def test_leaf_blocks():
    page = b"<html><body><div>lead<p>inner</p></div><p><b>only inline</b></p><p>x<b>y</b>z</p><table><tr><td>cell</td></tr></table></body></html>"
    assert list(epub.leaf_blocks(page)) == [("p", "inner"), ("p", "xyz"), ("table", "cell"), ("td", "cell")]


def test_lenient_html():
    assert html.blocks("<p>one<br>two<p>three<script>no</script><div>four &amp; five") == [("p", "one"), ("p", "two"), ("p", "three"), ("div", "four & five")]


def test_table_formats(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"text":"a","record":{"time":{"repr":"2024-01-02"},"level":{"name":"WARNING"},"name":"l","message":"m"}}\nbroken\n{"text":"b","record":{"time":{"repr":"2024-01-03"},"level":{"name":"INFO"},"name":"l","message":"n"}}\n')
    assert [(r.at, r.level) for r in tables.read_log(spark, str(tmp_path / "log.jsonl")).collect()] == [("2024-01-03", "info"), ("2024-01-02", "warning")]
    (tmp_path / "review.json").write_text('{"review_schema_version":1,"release_id":"r","entries":[{"candidate_id":"c","action":"keep"}]}')
    assert tables.read_review(spark, str(tmp_path / "review.json")).first().candidate_id == "c"
    with pytest.raises(Exception, match="review_schema_version"):
        tables.read_review(spark, str(tmp_path / "review.json"), version=2).collect()
    rows = spark.createDataFrame([(10, "j"), (2, "b"), (1, "a")], "chapter_number int, text string")
    tables.write_chapters(rows, str(tmp_path / "chapters"))
    got = tables.read_chapters(spark, str(tmp_path / "chapters"), "text string, chapter_number int", 2, 10).collect()
    assert sorted(r.chapter_number for r in got) == [2, 10]
    assert tables.verified_write(rows, str(tmp_path / "w"), "chapter_number", "text").count() == 0
    import sqlite3

    with sqlite3.connect(tmp_path / "t.db") as con:
        con.execute("create table t(a integer, b text)")
        con.execute("insert into t values (1, 'x')")
    assert tables.read_sqlite(spark, str(tmp_path / "t.db"), "select a, b from t", "a long, b string").collect() == [(1, "x")]


def pieces(t, most):
    """Sentence pieces by the stated rule, one step after the other."""
    import re

    if len(t) <= most:
        return [t]
    out, now = [], ""
    for s in re.findall(r"[^。！？.!?]+[。！？.!?]*|[。！？.!?]+", t):
        if len(now) + len(s) <= most:
            now += s
        elif now:
            out, now = [*out, now], s
        else:
            out, now = [*out, s[:most]], s[most:]
    out += [now] if now else []
    return [p[i : i + most] for p in out for i in range(0, len(p), most)]


def test_sentence_pieces(spark):
    texts = ["", "wait... what", "!!!", "...a", "a b. " * 30, "x" * 95 + ". y. z", "a. " + "x" * 95 + "... y. z", "。" * 50, "一二三。四五六！" * 9, "no stop at all " * 8]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.sentence_pieces(F.col("t"), 40).alias("p")).collect()
    for r in got:
        assert r.p == pieces(texts[r.i], 40) and "".join(r.p) == texts[r.i]


def test_terms_in_another_script_are_admitted(spark):
    rows = spark.createDataFrame([("r", 1, 0, "张三"), ("r", 1, 1, "A张"), ("r", 1, 2, "李7"), ("r", 1, 3, "第7章")], "release_id string, chapter_number int, row_index int, source_term string")
    chapters = spark.createDataFrame([("r", 1, "张三在第7章")], "release_id string, chapter_number int, text string")
    found = {r.row_index: r.verdict for r in glossary.admitted(rows, chapters).collect()}
    assert found == {0: "admitted", 1: "forbidden_letter", 2: "not_in_chapter", 3: "admitted"}


def test_echo_with_an_end_of_quoting(spark):
    rows = spark.createDataFrame([(r"a\E(b = out", r"a\E(b"), ("plain", r"\E")], "answer string, source string")
    assert [r[0].strip(" =") for r in rows.select(answers.without_echo(F.col("answer"), F.col("source"))).collect()] == ["out", "plain"]


def test_retry_pieces_lose_nothing(spark):
    """Against a loop over the sentences; a backslash is a stop of the retry split only."""
    texts = ["a\\b. c" * 40, "..." * 30, "one\\two\\three " * 9, "short", "", "x" * 95]

    def loop(t, stops, most=40):
        if len(t) <= most:
            return [t]
        pieces, now = [], ""
        for s in re.findall(f"[^{stops}]+[{stops}]*|[{stops}]+", t):
            if len(now) + len(s) <= most:
                now += s
            elif now:
                pieces, now = [*pieces, now], s
            else:
                pieces, now = [*pieces, s[:most]], s[most:]
        return [p[i : i + most] for p in [*pieces, *([now] if now else [])] for i in range(0, len(p), most)]

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for stops in (text.STOPS, text.RETRY_STOPS):
        got = [r.p for r in frame.select(text.sentence_pieces(F.col("t"), 40, stops).alias("p")).collect()]
        assert got == [loop(t, stops) for t in texts] and ["".join(p) for p in got] == texts


def test_updates_by_key(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, "x", "b"), (2, "x", "c")], "id int, k string, status string")
    new = spark.createDataFrame([(1, None, "A", 9), (2, "x", None, 9), (3, "x", "none", 9)], "id int, k string, status string, id2 int")
    assert sorted(map(str, (tuple(r) for r in glossary.with_updates(rows, new, ["id", "k"], ["status"]).collect()))) == ["(1, 'x', 'b')", "(1, None, 'A')", "(2, 'x', None)"]


def test_summaries_of_wrong_types(spark):
    full = {"chapter_number": 3, "characters_mentioned": ["a"], "key_events": ["b"], "new_terms": [], "relationships_changed": [{"entity": "e", "change": "c"}], "setting": "s", "tone": "t", "narrative_progression": "n", "is_story_chapter": True}
    cases = [
        ({}, ""),
        ({"chapter_number": "3"}, "schema_invalid: chapter_number must be an integer"),
        ({"key_events": ["a", 1]}, "schema_invalid: key_events must be a list of strings"),
        ({"new_terms": "x"}, "schema_invalid: new_terms must be a list of strings"),
        ({"relationships_changed": ["x", {"entity": 1, "change": "in Chapter 9"}]}, "schema_invalid: relationships_changed[0] must be an object; schema_invalid: relationships_changed[1].entity must be a non-empty string; future_knowledge: references chapter 9 while validating chapter 3"),
        ({"relationships_changed": {}}, "schema_invalid: relationships_changed must be a list"),
        ({"tone": None, "setting": "第 4 章 and chapter 4"}, "schema_invalid: tone must be a non-empty string; future_knowledge: references chapter 4 while validating chapter 3"),
        ({"is_story_chapter": "no"}, "schema_invalid: is_story_chapter must be a boolean"),
        ({"is_story_chapter": False}, "non_story_chapter_flagged"),
    ]
    frame = spark.createDataFrame([(3, json.dumps(full | c, ensure_ascii=False)) for c, _ in cases], "chapter long, payload string")
    got = summaries.validated_summaries(frame, "payload", "chapter").collect()
    assert [r.errors for r in got] == [e for _, e in cases] and [r.status for r in got] == ["success"] + ["failed"] * 8
    bad = spark.createDataFrame([(1, "broken"), (1, None), (1, "[1]")], "chapter long, payload string")
    assert {r.errors.split(":")[0] for r in summaries.validated_summaries(bad, "payload", "chapter").collect()} == {"schema_invalid"}
