"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankfield.catalog import load  # noqa: E402
from rankfield.session import local_session  # noqa: E402

HEADLINE = (
    "e1_prior_rolling", "e2_roll_over_valid", "e17_form_set", "e26_build", "l_findings", "d3_resolve_grid",
    "b3_map_driver", "c8_driver_pace", "g6_rolling_temperature", "g13_forecast", "i4_kendall", "i14_paired_comparison",
    "f3_score", "j3_walk_forward", "k14_resampled_totals",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8, "bench")
    queries, _ = load()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
