"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pageloom.plans.queries import QUERIES  # noqa: E402
from pageloom.session import local_session  # noqa: E402

HEADLINES = [
    "h1_parse_nodes", "h4_readiness", "corpus_quality", "b4_text_blocks", "g2_block_summary", "r1_unit_cover",
    "r3_sentence_candidates", "r2_protected_spans", "a5_merge_extractions", "u1_route_pages", "u4_resolve_url", "t6_text_width",
    "r7_replay_navigation", "st5_latest_progress", "st9_stable_window",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "pageloom-bench")
    QUERIES["h1_parse_nodes"](spark, sf_dir).limit(1).collect()  # start the Python workers
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        # noop runs the whole plan and moves no result to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
