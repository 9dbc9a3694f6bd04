"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row produced,
nothing collected to the driver) and timed; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ranklab.plans.catalog import REGISTRY  # noqa: E402
from ranklab.session import build_session  # noqa: E402

HEADLINE = (
    "gold_features",
    "season_standings",
    "historical_stats",
    "head_to_head",
    "circuit_most_wins",
    "two_stage_forecast",
    "legacy_forecast",
    "scored_predictions",
    "leaderboard",
    "effective_predictions",
    "bronze_roundtrip",
    "stream_ingest",
    "compat_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # warm-up: JVM, parquet footers, codegen caches
    REGISTRY["entrant_form"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    sf = Path(sf_dir).name.replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
