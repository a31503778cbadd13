"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from weft import registry
from weft.session import session

HEADLINE = [
    "shared_tables", "data_dependencies", "cross_package_edges", "execution_levels", "contains_star", "mv_lineage", "mv_complexity",
    "lookup_left", "merge_join_inner", "router", "conditional_split", "infa_aggregator", "ssis_aggregate", "rank_top", "normalizer",
    "scd_type2", "update_strategy", "fact_key_resolution", "pivot_max_case", "sequence_generator", "bm25_scores", "search_content", "quality_all", "tokenize", "type_targets",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["row_count"](spark, sf).collect()  # starts the session's threads
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
