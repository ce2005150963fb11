"""Training, evaluation and one-model-per-dataset training."""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.catalog import FEATURES
from ..operators import models as m
from ..operators.bounded import collect_bounded
from ..operators.curation import dataset_profile, dedup_first_seen, benign_pool, preprocess, validate
from ..operators.features import add_features
from ..operators.imbalance import imbalance_profile
from ..operators.metrics import classification_report, weighted_metrics
from ..operators.sampling import (
    equal_per_class, fill_single_class, oversample, stratified_folds, stratified_split, undersample,
)
from ..operators.smote import smote
from ..sources.artifacts import save_model
from ..sources.paths import stored
from ..sources.registry import Registry, dataset_metrics
from ..sources.sinks import write_cv_results, write_features, write_report


def balance(df: DataFrame, method: str, seed: int) -> DataFrame:
    """Balanced feature table; every row gets `row_key`, unique also among copies
    and synthetic rows. SMOTE needs two minority rows, else rows are repeated."""
    if method == "none":
        return df.withColumn("row_key", F.col("url"))
    if method == "undersampling":
        return undersample(df, seed).withColumn("row_key", F.col("url"))
    if method == "smote":
        counts = df.groupBy("label").count().collect()
        if min(r["count"] for r in counts) >= 2:
            return smote(df, seed)
    copies = oversample(df, seed)
    return copies.withColumn("row_key", F.concat_ws("#", "url", "copy_no")).drop("copy_no")


def prepare(featured: DataFrame, settings: Settings) -> tuple[DataFrame, dict, str]:
    """(rows with is_test, imbalance info, balancing method) from a feature table."""
    info = imbalance_profile(featured).first().asDict()
    method = "none"
    if settings.apply_balancing:
        method = settings.balance_method or info["balancing_method"]
    seed = settings.seed
    if settings.balance_train_only:
        marked = stratified_split(featured, seed, settings.test_size)
        train = balance(marked.where("NOT is_test").drop("is_test"), method, seed)
        test = marked.where("is_test").withColumn("row_key", F.col("url"))
        rows = train.withColumn("is_test", F.lit(False)).unionByName(test)
    else:
        balanced = stored(balance(featured, method, seed), "balanced")
        rows = stratified_split(balanced, seed, settings.test_size, identity="row_key")
    return rows, info, method


#: A task that scores rows reads the whole model first, so it gets this many rows.
ROWS_PER_TASK = 20_000


def distinct_rows(test: DataFrame, features) -> DataFrame:
    """Distinct rows of label and features with their number `n`, in few partitions."""
    found = stored(test.groupBy("label", *[f"`{c}`" for c in features]).agg(F.count("*").alias("n")), "test")
    return found.coalesce(max(1, math.ceil(found.count() / ROWS_PER_TASK)))


def evaluate_model(model, test: DataFrame, classes) -> dict:
    """Metrics, confusion matrix and report of a fitted pipeline: one pass over `test`, whose
    rows count `n` times."""
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int") + 1)
    scored = model.transform(test).select("label", name.alias("prediction"), "n")
    cells = scored.groupBy("label", "prediction").agg(F.sum("n").alias("n")).collect()
    counts = test.sparkSession.createDataFrame(cells, "label string, prediction string, n long")
    found = {(r["label"], r["prediction"]): r["n"] for r in cells}
    report = {r["class"]: r.asDict() for r in classification_report(counts).collect()}
    return {
        **weighted_metrics(counts).first().asDict(),
        "confusion_matrix": [[found.get((t, p), 0) for p in classes] for t in classes],
        "classification_report": report,
    }


def train_and_compare(rows: DataFrame, settings: Settings, features=FEATURES) -> dict:
    """Tune and fit every algorithm; a failing one is reported and left out.

    Returns results per algorithm, class names and the champion (best F1).
    """
    indexer = m.label_indexer(rows.select("label"))
    classes = list(indexer.labels)
    train = indexer.transform(rows.where("NOT is_test"))
    train = m.class_weights(stratified_folds(train, settings.seed, settings.folds, identity="row_key"))
    train = stored(train, "train").persist()
    test = distinct_rows(rows.where("is_test"), features)
    plan = {
        a: m.sample_candidates(settings.grids.get(a, m.GRIDS.get(a)), settings.candidates, settings.seed) for a in settings.algorithms
    }
    prepared = m.preparation(train, features)
    data = m.binned_rows(train, plan, settings, features)

    def compare(algorithm):
        candidates = plan[algorithm]
        try:
            found = m.search_one(train, algorithm, candidates, settings, data, features)
            if "error" in found:
                raise ValueError(found["error"])
            scores = found["scores"]
            table = m.cv_results(rows.sparkSession, candidates, scores, found.get("seconds"))
            means = [sum(s) / len(s) for s in scores]
            best = max(range(len(candidates)), key=lambda i: means[i])
            model = m.fit_best(train, algorithm, candidates[best], {"data": data} if data else {}, prepared, settings.seed, features)
            return {
                "model": model,
                "params": candidates[best],
                "cv_score": means[best],
                "cv_results": table,
                "metrics": evaluate_model(model, test, classes),
                "feature_importance": m.feature_importance(model, features),
            }
        except Exception as e:  # one algorithm must not stop the others
            return {"error": str(e)}

    order = m.longest_first(plan)
    with ThreadPool(max(1, len(order))) as pool:  # one algorithm's last model is fitted while others are searched
        done = dict(zip(order, pool.map(compare, order, chunksize=1)))
    results = {a: done[a] for a in plan}
    train.unpersist()
    good = {a: r for a, r in results.items() if "error" not in r}
    if not good:
        raise ValueError(f"no algorithm could be trained: { {a: r['error'] for a, r in results.items()} }")
    champion = max(good, key=lambda a: good[a]["metrics"]["f1"])
    return {"results": results, "classes": classes, "champion": champion}


def comparison_table(spark: SparkSession, results: dict) -> DataFrame:
    rows = [
        (a, float(r["cv_score"]), float(r["metrics"]["f1"]), float(r["metrics"]["accuracy"]))
        for a, r in results.items()
        if "error" not in r
    ]
    return spark.createDataFrame(
        rows, "algorithm string, cv_score double, test_f1 double, test_accuracy double"
    )


def training_report(
    run_id: str, algorithm: str, outcome: dict, info: dict, method: str, sizes: dict, seconds: float,
    features=FEATURES, artifacts=None,
) -> dict:
    mine = outcome["results"][algorithm]
    return {
        "run_id": run_id,
        "training_time_seconds": seconds,
        "model_used": algorithm,
        "best_parameters": mine["params"],
        "dataset_info": {
            "total_samples": info["total_samples"],
            "train_samples": sizes["train"],
            "test_samples": sizes["test"],
            "num_features": len(features),
            "balancing_method": method,
            "class_distribution": info["class_distribution"],
        },
        "class_performance": mine["metrics"]["classification_report"],
        "confusion_matrix": mine["metrics"]["confusion_matrix"],
        "model_comparison": {
            a: {
                "cv_score": r["cv_score"],
                "test_f1": r["metrics"]["f1"],
                "test_accuracy": r["metrics"]["accuracy"],
            }
            for a, r in outcome["results"].items()
            if "error" not in r
        },
        "feature_selection": {
            "original_feature_count": len(features),
            "selected_feature_count": len(features),
            "selected_features": list(features),
            "feature_importance": dict(mine["feature_importance"]),
        },
        "artifacts": artifacts or {},
    }


def _sizes(rows: DataFrame) -> dict:
    counted = rows.groupBy("is_test").count().collect()
    by = {r["is_test"]: r["count"] for r in counted}
    return {"train": by.get(False, 0), "test": by.get(True, 0)}


def _finish(spark, rows, featured, info, method, outcome, settings, out, run_id, started, name, extra):
    """Artifacts, registry, reports and metrics of one trained dataset."""
    best = outcome["champion"]
    mine = outcome["results"][best]
    path = save_model(mine["model"], spark, f"{out}/models", run_id, best, outcome["classes"])
    registry = Registry(spark, out)
    version = registry.register(
        {
            "service_conf_id": extra.get("service_conf_id"),
            "run_id": run_id,
            "name": name.format(algorithm=best),
            "algorithm": best,
            "model_uri": path,
            **{k: float(mine["metrics"][k]) for k in ("accuracy", "precision", "recall", "f1")},
            "config_json": str({"run_id": run_id, "confusion_matrix": mine["metrics"]["confusion_matrix"]}),
        }
    )
    seconds = time.time() - started
    sizes = _sizes(rows)
    reports = {}
    for algorithm, r in outcome["results"].items():
        if "error" in r:
            registry.log_metrics(run_id, {f"error_algorithm_{algorithm}_failure": r["error"]})
            continue
        reports[algorithm] = training_report(
            run_id, algorithm, outcome, info, method, sizes, seconds, artifacts={"model": path}
        )
        write_report(spark, reports[algorithm], f"{out}/reports", f"{algorithm}_training_report_{run_id}")
        write_cv_results(r["cv_results"], f"{out}/reports", algorithm)
        registry.log_metrics(
            run_id,
            {
                f"{algorithm}_cv_score": r["cv_score"],
                **{f"{algorithm}_param_{k}": v for k, v in r["params"].items()},
                **{f"{algorithm}_{k}": r["metrics"][k] for k in ("accuracy", "precision", "recall", "f1")},
            },
        )
    for row in dataset_metrics(run_id, featured, rows).collect():
        extra = {**extra, row["key"]: row["value"]}
    registry.log_metrics(
        run_id,
        {**extra, "balancing_method": method, "train_size": sizes["train"], "test_size": sizes["test"],
         "num_features": len(FEATURES), "training_time_seconds": seconds},
    )
    return {
        "status": "success", "run_id": run_id, "best_algorithm": best, "metrics": mine["metrics"],
        "version": version, "training_time": seconds, "reports": reports,
        "best_report": reports[best], "artifacts": {"model": path},
    }


def train(labelled: DataFrame, out: str, settings: Settings | None = None, service_conf_id=None,
          strict: bool = False, dictionaries=None, run_id: str | None = None) -> dict:
    """Train on a merged (url, label) table; models, registry and reports go below `out`."""
    settings = settings or Settings()
    spark, started, run_id = labelled.sparkSession, time.time(), run_id or uuid.uuid4().hex
    registry = Registry(spark, out)
    try:
        if strict:
            ok, findings = validate(labelled)
            if not ok:
                path = f"{out}/reports/validation_{run_id}"
                findings.write.parquet(path)
                raise ValueError(f"the training table is not valid, see {path}")
        featured = _feature_table(preprocess(labelled), f"{out}/extraction/{run_id}", dictionaries)
        rows, info, method = prepare(featured, settings)
        rows = stored(rows, "rows")
        if method != "none":
            write_features(rows, f"{out}/extraction/{run_id}", f"features_after_balance_{method}")
        outcome = train_and_compare(rows, settings)
        return _finish(spark, rows, featured, info, method, outcome, settings, out, run_id, started,
                       "malicious_url_detector_{algorithm}", {"service_conf_id": service_conf_id})
    except Exception as e:
        registry.log_metrics(run_id, {"error_training_failure": str(e)})
        return {"status": "failed", "run_id": run_id, "error": str(e)}


def _feature_table(df: DataFrame, root: str, dictionaries=None) -> DataFrame:
    """Features written once (the input of every later pass) and read back."""
    featured = add_features(df, dictionaries=dictionaries).drop("is_valid_url")
    path = write_features(featured, root, "features_before_balance")
    return df.sparkSession.read.parquet(path)


def evaluate(labelled: DataFrame, out: str, settings: Settings | None = None) -> dict:
    """Train and compare without registering anything."""
    settings = settings or Settings()
    featured = _feature_table(preprocess(labelled), f"{out}/evaluate")
    rows, _, _ = prepare(featured, settings)
    rows = stored(rows, "rows")
    outcome = train_and_compare(rows, settings)
    good = {a: r for a, r in outcome["results"].items() if "error" not in r}
    return {
        "dataset_info": {**_sizes(rows), "features": len(FEATURES)},
        "results": {a: {k: r[k] for k in ("metrics", "cv_score", "params")} for a, r in good.items()},
        "best_algorithm": outcome["champion"],
    }


def per_dataset_rows(df: DataFrame, seed: int, order=None) -> DataFrame:
    """Training rows of all datasets in one pass: equal classes for two-class
    datasets, benign pool rows added to single-class ones. A dataset counts a URL
    once: its first row by `order`, or its least label where there is no order."""
    keys = ["dataset", "url"]
    if order is not None:
        df = dedup_first_seen(df, order, keys)
    else:
        df = df.groupBy(*keys).agg(F.min("label").alias("label"))
    df = stored(df.select("dataset", "url", "label"), "datasets")
    pool = benign_pool(df)
    return equal_per_class(df, seed).withColumn("from_pool", F.lit(False)).unionByName(
        fill_single_class(df, pool, seed)
    )


def train_per_dataset(df: DataFrame, out: str, settings: Settings | None = None, prefix="obo_training",
                      order=None) -> dict:
    """One model per dataset. Curation and features run once for all datasets; a
    failing dataset is reported and the rest goes on."""
    settings = replace(settings or Settings(), apply_balancing=False, balance_method=None)
    spark, started = df.sparkSession, time.time()
    chosen = per_dataset_rows(df, settings.seed, order)
    # A pool row may repeat a dataset's own URL, so the key names its origin too.
    featured = add_features(chosen).drop("is_valid_url").withColumn(
        "row_key", F.concat_ws("#", "dataset", "url", F.col("from_pool").cast("string"))
    )
    path = f"{out}/extraction/{uuid.uuid4().hex}"
    featured.write.mode("overwrite").partitionBy("dataset").parquet(path)
    table = spark.read.parquet(path)
    profile = collect_bounded(dataset_profile(table).orderBy("dataset"), "datasets")
    result = {"status": "success", "datasets_trained": [], "datasets_failed": [], "models": {}}
    for r in profile:
        name, begun, run_id = r["dataset"], time.time(), uuid.uuid4().hex
        try:
            mine = table.where(F.col("dataset") == name)
            info = imbalance_profile(mine).first().asDict()
            rows = stored(stratified_split(mine, settings.seed, settings.test_size, identity="row_key"), "rows")
            method = "benign_merge" if rows.where("from_pool").limit(1).count() else "undersample_to_min"
            outcome = train_and_compare(rows, settings)
            result["models"][name] = _finish(
                spark, rows, mine, info, method, outcome, settings, out, run_id, begun,
                "{algorithm}_" + name + "_model",
                {"dataset_name": name, "training_mode": "one_by_one", "run_name": f"{prefix}_{name}"},
            )
            result["datasets_trained"].append(name)
        except Exception as e:
            result["datasets_failed"].append({"dataset": name, "error": str(e)})
    if result["datasets_failed"]:
        result["status"] = "partial_success" if result["datasets_trained"] else "failed"
    result["total_training_time"] = time.time() - started
    return result
