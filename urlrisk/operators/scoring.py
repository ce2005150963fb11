"""Scoring results: structure, advice, batch summary and URL comparison."""

from __future__ import annotations

import re

from pyspark.ml import Transformer
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.feature import StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.advice import advice
from ..functions.catalog import FEATURES
from .features import add_features

EMPTY_URL = "The URL is empty"
BAD_URL = "Malformed authority in URL"


def align(df: DataFrame, expected) -> DataFrame:
    """Exactly the expected feature columns in that order, after the others;
    missing ones are 0, NULLs become 0."""
    have = set(df.columns)
    others = [c for c in df.columns if c not in set(expected) and c not in FEATURES]
    return df.select(
        *others,
        *[(F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in expected],
    )


def url_status(url: Column, valid: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "failed").when(~valid, "failed").otherwise("success")


def url_error(url: Column, valid: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", EMPTY_URL).when(~valid, BAD_URL)


def result_columns(df: DataFrame, model_id: str | None) -> DataFrame:
    """Finish rows that carry status, error, class, confidence and probabilities."""
    ok = F.col("status") == "success"
    known = lambda c: F.when(ok, c)
    return (
        df.withColumn("class", known(F.col("class")))
        .withColumn("confidence", known(F.col("confidence")))
        .withColumn("probabilities", known(F.col("probabilities")))
        .withColumn("is_malicious", known(F.col("class") != "benign"))
        .withColumn("suggested_desc", known(advice(F.col("class"), F.col("confidence"))))
        .withColumn("model_id", F.lit(model_id))
        .withColumn("timestamp", F.current_timestamp())
    )


def read_features(model: Transformer, features) -> set[str]:
    """The features that can change what `model` returns: those that a pipeline of
    assembler, scaler and one decision tree splits on, and all of any other model."""
    stages = getattr(model, "stages", [])
    known = [VectorAssembler, StandardScalerModel, DecisionTreeClassificationModel]
    if [type(s) for s in stages] != known:
        return set(features)
    inputs = stages[0].getInputCols()
    return {inputs[int(i)] for i in re.findall(r"\(feature (\d+) ", stages[-1].toDebugString)}


def score(
    df: DataFrame, model: Transformer, classes, features=FEATURES, model_id: str | None = None,
    url: str = "url", with_features: bool = False, dictionaries=None,
) -> DataFrame:
    """Score every row of `df`; empty or malformed URLs become failed rows.

    One narrow plan: features, assembler, scaler and model are projections. Features that
    no split of a tree reads are not computed, unless the caller wants them.
    """
    work = add_features(df, url, dictionaries=dictionaries)
    valid = F.col("is_valid_url")
    work = work.withColumns(
        {"status": url_status(F.col(url), valid), "error": url_error(F.col(url), valid)}
    )
    read = set(features) if with_features else read_features(model, features)
    scored = model.transform(align(work.drop(*[c for c in features if c not in read and c not in df.columns]), features))
    p = F.col("_p")
    names = F.array(*[F.lit(c) for c in classes])
    scored = scored.withColumn("_p", vector_to_array("probability")).withColumns(
        {
            "class": F.element_at(names, F.col("prediction").cast("int") + 1),
            "confidence": F.array_max(p),
            "probabilities": F.map_from_arrays(names, p),
        }
    )
    out = result_columns(scored, model_id)
    result = [
        "status", "error", "class", "is_malicious", "confidence", "probabilities",
        "suggested_desc", "model_id", "timestamp",
    ]
    carried = [c for c in df.columns if c not in result]
    return out.select(*carried, *result, *(features if with_features else ()))


def batch_summary(scored: DataFrame, by=()) -> DataFrame:
    """total, successful, failed, success rate in percent, overall status."""
    good = F.count_if(F.col("status") == "success")
    total = F.count("*")
    return scored.groupBy(*by).agg(
        total.alias("total"), good.alias("successful"), (total - good).alias("failed"),
        F.round(good / total * 100, 2).alias("success_rate"),
        F.when(good == total, "success").when(good > 0, "partial_success").otherwise("failed").alias("status"),
    )


def class_distribution(scored: DataFrame, by=()) -> DataFrame:
    """Rows and percent per predicted class among the successful rows."""
    counts = scored.where("status = 'success'").groupBy(*by, "class").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by)) * 100  # a few classes per group
    return counts.withColumn("percent", F.round(share, 1))


def throughput(total: int, seconds: float) -> dict:
    """Timing part of a batch report."""
    return {
        "total_time_seconds": round(seconds, 3),
        "average_time_ms": round(seconds / total * 1000, 2) if total else 0,
        "urls_per_second": round(total / seconds, 2) if seconds > 0 else 0,
    }


def compare_urls(featured: DataFrame, number: str, numbers, features=FEATURES) -> DataFrame:
    """Features as rows (by name), one column `url_<number>` per compared URL."""
    if not 2 <= len(numbers) <= 5:
        raise ValueError("a comparison takes 2 to 5 URLs")
    chosen = featured.where(F.col(number).isin(*numbers))
    long = chosen.unpivot([number], list(features), "feature", "value")
    cells = [F.max(F.when(F.col(number) == n, F.col("value"))).alias(f"url_{n}") for n in numbers]
    return long.groupBy("feature").agg(*cells).orderBy("feature")
