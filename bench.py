"""Time the headline queries, the better of two runs each, and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` (comma separated)
replaces the headline list; ``all`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans.catalog import PLANS
from tidemark.session import local_session

HEADLINES = (
    "feed_top_24h", "feed_search", "feed_search_fallback", "feed_story_timeline", "feed_resolve_story",
    "feed_daily_index", "feed_fingerprint", "mirror_apply_changes", "mirror_stream",
    "storage_dir_sizes", "storage_top_children", "storage_classify_by_prefix", "storage_tier_stats",
    "storage_audit_actions",
    "style_phrase_hits", "style_flat_rhythm", "style_checks", "style_qc_report",
    "research_timeline_gaps", "research_assign_phase", "research_best_source", "research_independent_sources",
    "governance_dead_links", "governance_fact_conflicts", "governance_duplicate_rules", "governance_rule_chain",
    "evals_failure_streaks", "evals_spec_contract", "evals_territory_overlap", "stream_streak_alerts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(PLANS) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    PLANS["feed_top_24h"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(2):
            start = time.perf_counter()
            PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
    report = {
        "metric": "headline queries, sum of the better of two runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
