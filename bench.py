"""Time the headline queries on the benchmark tables and print one JSON line.

Each query is planned and run to completion without a sink: once to warm up, then ``BENCH_RUNS`` times
(default 3), of which the median counts.  ``BENCH_QUERIES`` (comma separated, or ``all``) picks others.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "usage_rollup usage_class usage_batch external_references call_site_build ancestors subtypes call_graph_both2 "
    "recursive_callers call_degrees call_tree_callees search_strings search_regex search_names search_numbers "
    "string_distribution archive_report class_diff method_diff mapping_diff mapping_compose mapping_invert "
    "mapping_apply_sites mapping_write pattern_library pattern_nested_all detector_scores decrypt_candidates "
    "encrypted_call_sites static_inlining opaque_predicates unreachable_code dead_code entropy_windowed byte_diff "
    "checksums snapshot_samples last60 status_changes archive_scan decoded_code"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from codelode.plans import load_all
    from codelode.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(2, int(cpus)) if cpus.isdigit() else 8)
    plans = load_all()[0]
    picked = os.environ.get("BENCH_QUERIES")
    names = list(plans) if picked == "all" else picked.split(",") if picked else HEADLINE

    def once(name: str) -> float:
        start = time.perf_counter()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
