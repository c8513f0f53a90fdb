"""Headline queries, timed: prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the fastest run
counts. Results go to a sink that takes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from rankloom.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "retrieve_top_20",
    "two_stage_top_5",
    "text_search_two_stage",
    "pair_feature_vectors",
    "ranking_report_at_10",
    "predicted_and_ideal_positions",
    "hard_negatives",
    "sampled_in_batch_negatives",
    "listnet",
    "plistmle",
    "lambda_loss_ndcg2pp",
    "lambda_gradients",
    "spearman_correlation",
    "kendall_correlation",
    "lambdamart_predictions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:] or times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
