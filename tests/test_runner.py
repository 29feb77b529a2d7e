import pytest
from pyspark.sql import functions as F

from chapterloom.functions import answers
from chapterloom.plans import runner


def test_order():
    assert runner.legal(None, "packets-build") and runner.legal("packets-build", "packets-build") and runner.legal("packets-build", "reset")
    assert not runner.legal("packets-build", "preprocess-glossary") and not runner.legal("packets-build", "unknown") and not runner.legal("reset", "packets-build")
    assert runner.following(None) == "preprocess-glossary" and runner.following("epub-rebuild") is None


def test_run_stops_at_failure_and_resumes(spark, tmp_path):
    log, calls, broken = f"file://{tmp_path}/log", [], [True]

    def graph():
        calls.append("graph")
        if broken[0]:
            raise ValueError("no")

    stages = {"preprocess-glossary": lambda: calls.append("glossary"), "preprocess-graph": graph, "packets-build": lambda: calls.append("packets")}
    assert runner.run(spark, log, "r", stages) == ["preprocess-glossary"]
    state = {r.stage: (r.status, r.message) for r in runner.states(spark, log).collect()}
    assert state == {"preprocess-glossary": ("completed", ""), "preprocess-graph": ("failed", "no")}
    broken[0] = False
    assert runner.run(spark, log, "r", stages, stop=lambda: "packets" in calls) == ["preprocess-graph", "packets-build"]
    assert calls == ["glossary", "graph", "graph", "packets"]


def test_answers(spark):
    rows = [("```json\n{\"a\":1}\n```", "x"), ("Term: a\n\nResult:  b ", "x"), ("src -> src : out ", "src"), ("plain", "x")]
    got = spark.createDataFrame(rows, "a string, s string").select(answers.without_fence(F.col("a")), answers.last_line(F.col("a")), answers.without_echo(F.col("a"), F.col("s"))).collect()
    assert got[0][0] == '{"a":1}' and got[1][1] == "b" and got[2][2] == ": out" and tuple(got[3]) == ("plain",) * 3


def test_instants_and_prompts(spark):
    rows = [("2024-01-02T03:04:05Z",), ("2024-01-02T05:04:05+02:00",), ("2024-01-02T03:04:05",), (" ",), ("never",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(answers.instant(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] == 1704164645000000 and got[3:] == [None, None]
    p = answers.Prompt.parse("# version: 3\n\nSay {what} to {who}.")
    assert p.version == "3" and spark.range(1).select(p.fill(what=F.lit("hi"), who=F.lit("all"))).first()[0] == "Say hi to all."
    with pytest.raises(ValueError):
        answers.Prompt.parse("no version")
