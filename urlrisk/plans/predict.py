"""Batch scoring with a stored model."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..operators.scoring import batch_summary, class_distribution, compare_urls, score, throughput
from ..operators.features import add_features
from ..sources.artifacts import load_model
from ..sources.paths import stored
from ..sources.readers import unique_urls
from ..sources.registry import Registry


def predict(urls: DataFrame, out: str, run_id: str, with_features: bool = False, log: bool = True) -> DataFrame:
    """Score a table of URLs (columns url and, optionally, user_id). Rows with a
    user are appended to the prediction log."""
    spark = urls.sparkSession
    model, classes, features = load_model(spark, f"{out}/models", run_id)
    scored = score(urls, model, classes, features, run_id, with_features=with_features)
    if log and "user_id" in urls.columns:
        scored = stored(scored, "scored")
        Registry(spark, out).log_predictions(scored)
    return scored


def predict_test(urls: DataFrame, out: str, run_id: str, order=None) -> dict:
    """Batch test: unique URLs, success rate, class distribution, timing.

    The scored table is stored; the report holds only its summaries.
    """
    started = time.time()
    urls = unique_urls(urls, order) if order else urls.select("url").distinct()
    path = f"{out}/reports/predict_test_{run_id}"
    predict(urls, out, run_id, with_features=True, log=False).write.mode("overwrite").parquet(path)
    scored = urls.sparkSession.read.parquet(path)
    summary = batch_summary(scored).first().asDict()
    return {
        "status": summary.pop("status"),
        "summary": {
            **summary,
            "class_distribution": {r["class"]: r["n"] for r in class_distribution(scored).collect()},
        },
        "timing": throughput(summary["total"], time.time() - started),
        "model_id": run_id,
        "predict_results": path,
    }


def compare(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Feature table of 2 to 5 URLs side by side."""
    df = spark.createDataFrame(list(enumerate(urls, 1)), "no int, url string")
    return compare_urls(add_features(df), "no", list(range(1, len(urls) + 1)))
