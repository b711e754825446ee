"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (input), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per query
after one warm-up; the median counts). Results go to Spark's no-op sink: every row and column is
computed, none is collected.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hearsay.checks.queries import queries  # noqa: E402
from hearsay.session import build_session  # noqa: E402

HEADLINE = (
    "daily_top_posts", "top_posts_per_day", "bronze_summary", "posts_silver", "silver_metrics",
    "quality_summary", "enrich_gold", "model_scores", "sentiment_by_subreddit", "topic_trends",
    "emotion_analysis", "daily_metrics", "label_metric_keys", "kpis", "daily_trends",
    "top_subreddits", "dominant_sentiment", "explore_recent", "confident_negative_top10",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("hearsay-bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    known, times = queries(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
