"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradelattice.plans.queries import REGISTRY  # noqa: E402
from gradelattice.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2  # the better of two runs, after one warm-up query

HEADLINE = [
    "context_long", "context_alpha_cut", "context_nominal_scaling", "context_stats", "context_embedding",
    "modal_extent", "modal_intent", "modal_closure_suppliers", "modal_closure_wide",
    "derive_down_luk", "derive_up_luk", "closure_luk", "closure_goguen",
    "concepts_powerset", "concepts_cbo", "concepts_crisp", "concepts_suppliers", "concepts_types", "concept_extents",
    "fuzzy_concepts_luk", "fuzzy_concepts_goguen", "fuzzy_concepts_users", "next_closure_order",
    "hasse_edges_crisp", "hasse_edges_modal", "hasse_edges_types", "hasse_edges_family", "hasse_edges_fuzzy", "hasse_rows_fuzzy",
    "fuzzy_subset_pairs", "degree_stats", "lattice_metrics", "join_closure", "link_score", "quota_sample",
    "scan_context", "concept_listing", "dot_lines",
    "lattice_metrics_types", "link_score_types", "incremental_hasse", "incremental_hasse_restart", "scan_context_lenient",
    "fuzzy_concepts_quota", "dominance_lookup", "incremental_hasse_fuzzy", "closure_large", "concepts_real", "sample_lines", "windowed_context",
]


def main() -> None:
    spark = local_session("bench", cpus=CPUS)
    REGISTRY["concepts_region"](spark, SF_DIR).count()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            REGISTRY[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline query seconds, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()
