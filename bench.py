"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "latest_price_inner", "median_ppsm", "district_segment_aggregates", "price_drops", "append_price_changes", "merge_listings",
    "versioned_history", "search_listings", "quality_metrics", "paid_price_by_type", "paid_price_rank", "paid_rollup_month",
    "comparable_estimate", "bottom_estimate", "grid_estimate", "deal_estimate", "district_by_polygon", "district_by_nearest_any",
    "impute_building_info", "detect_reposts", "risk_tags", "address_parsing", "offers_mapped", "interest_price_all", "change_classes",
    "lots_against_market", "value_properties", "stream_price_changes",
]


def main() -> None:
    from hearthmark.plans.catalog import QUERIES
    from hearthmark.session import build_session
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's engine
    times: dict[str, float] = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
