"""Time the headline queries; prints one JSON line.

Each query runs once to warm up on the smallest scale and is then timed at
``BENCH_SF_DIR`` with its result written to the ``noop`` sink, so the whole result
is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = (
    "sessionize_1h interval_union_project split_local_midnight combined_clock_sweep calendar_day_project timeline_week corpus_counts coverage_pivot usage_dedup_rank token_cost_daily token_cost_session canonical_dedup "
    "evidence_sets artifact_extract repetition_errors episode_segments episode_render trace_pair_calls trace_transitions lexical_topk semantic_topk hybrid_rrf cluster_keywords chunk_text rolling_windows neighborhood alias_most_specific"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from palimpsest.plans import content, records, registry, scope, work  # noqa: F401

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.environ.get("BENCH_WARM_DIR", str(Path(sf_dir).parent / "sf0.001"))
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run = registry.QUERIES[name]
        if os.path.isdir(warm):
            run(spark, warm).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
