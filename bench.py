"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pisoval.catalog.queries import QUERIES  # noqa: E402
from pisoval.session import local_session  # noqa: E402

HEADLINES = ["normalize_text", "amenity_flags", "amenity_states", "state_and_occupation", "nearest_poi", "assign_area",
             "build_features", "score_trees", "score_trees_expression", "score_trees_410", "value_native", "validate_strict",
             "duplicates_in_batch", "results", "errors", "reconcile", "training_profile"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    listings = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name, "listings": listings,
                      "listings_per_sec_results": round(listings / seconds["results"])}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
