"""Headline queries, each run once to warm up and then timed over its whole result.

Prints one JSON line.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from linestream.session import local_session  # noqa: E402

HEADLINE = [
    "clean_lines",
    "paragraph_rollup",
    "assemble_original",
    "language_profile",
    "detect_language",
    "resolve_sources",
    "tm_lookup",
    "apply_translations_region",
    "lexicon_translate",
    "translate_batches",
    "line_identity",
    "frame_diff",
    "drop_stale_responses",
    "session_state",
    "debounce_last",
    "interaction_spans",
    "max_overlap_display",
    "topmost_window_at",
    "split_sections",
    "replay_live",
    "replay_live_auto",
    "translate_capture",
]


def timed(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    names = sys.argv[1:] or HEADLINE
    took = {}
    for n in names:
        timed(spark, n, sf)
        took[n] = round(timed(spark, n, sf), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
