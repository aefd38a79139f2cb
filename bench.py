"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then BENCH_RUNS times; the median is reported.
Results are consumed by a no-op sink, so every row and column is computed but nothing is
collected. Session start is excluded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "agg08_ship_stats",
    "agg07_monthly_trend",
    "top02_games_by_wagered",
    "fea01_member_features",
    "fea02_training_table",
    "day01_daily_metrics",
    "day02_win_rate_training",
    "gen03_redistribute",
    "dem01_bank_demand",
    "flr02_allocate",
    "voy03_training",
    "voy04_profit_forecast",
    "sem07_two_tables",
    "sem08_monthly_revenue_trend",
    "jon05_latest_ship",
    "win03_session_recency",
    "ml04_stratified_split",
    "ret01_bm25_top5",
    "ret03_vector_top5",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from spindrift.registry import QUERIES
    from spindrift.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=cpus, app="bench")
    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median wall seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
