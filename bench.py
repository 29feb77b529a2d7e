"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chapterloom.plans import registry  # noqa: E402
from chapterloom.session import build_session  # noqa: E402

QUERIES = (
    "stage_summary",
    "observability_counters",
    "event_sampling",
    "chapter_status",
    "pulse_histogram",
    "candidate_merge",
    "glossary_conflicts",
    "glossary_subset",
    "alias_precedence",
    "idiom_policy_validation",
    "story_so_far",
    "lineage_hash",
    "relationship_intervals",
    "chapter_view",
    "graph_violations",
    "chapter_packet_overview",
    "packet_budget",
    "paragraph_risk",
    "readability",
    "critic_prune",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    plans = registry.queries()
    plans["stage_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the executors
    times = {}
    for name in QUERIES:
        began = time.time()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
