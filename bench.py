"""Headline queries, timed. The line of figures is printed anew after every query, so
that the last line holds all of them, or all that ended if a run is stopped.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all),
BENCH_SHARED_DIR (warehouse and intermediate tables; default spark-warehouse).
Every query is written in full to the no-op sink, so nothing is pruned away by
counting.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from urlrisk.plans import registered as r  # noqa: E402

HEADLINE = (
    "feat_weighted", "url_parts", "class_profile", "merged_dataset", "dedup_first", "undersample",
    "oversample", "stratified_split", "stratified_folds", "equal_per_class", "classification_report",
    "dictionary_flags", "batch_summary", "prediction_log", "smote_balance", "score_urls", "train_compare",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("urlrisk-bench")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Feature work is heavy per byte: do not merge small partitions into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", os.path.abspath(os.environ.get("BENCH_SHARED_DIR", "spark-warehouse")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    urls = spark.read.parquet(f"{sf_dir}/events.parquet").count()  # starts the executors as well
    settled = r.settled_corpus(spark, sf_dir).count() if "train_compare" in names else None
    seconds = {}
    for name in names:
        started = time.time()
        r.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        result = {
            "metric": "total_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": sf_dir.rsplit("/sf", 1)[-1], "urls": urls,
        }
        if "feat_weighted" in seconds:
            result["feature_urls_per_sec"] = round(urls / seconds["feat_weighted"])
        if "train_compare" in seconds:  # what is trained on: one row per settled URL
            result |= {"settled_urls": settled, "train_urls_per_sec": round(settled / seconds["train_compare"], 1)}
        print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
