"""Model registry, prediction log and run metrics as append-only tables.

A model's version is claimed before its row is written: the claim is a file named after
the number, which the file system creates for one caller only. Whoever comes second takes
the next number. A caller that ends between claim and row leaves a number unused. Every
commit has a folder of its own, so writers at the same time do not meet.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import create_new, exists, list_files

MODEL_SCHEMA = (
    "service_conf_id long, run_id string, name string, algorithm string, model_uri string, "
    "accuracy double, recall double, precision double, f1 double, config_json string, "
    "version long, alias string, stage string, updated_at timestamp"
)
METRIC_SCHEMA = "run_id string, key string, value string, ts timestamp"


class Registry:
    """Tables below one folder; every change appends a row."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.parquet(f"{self.root}/{name}/{uuid.uuid4().hex}")

    def _claim(self, name: str) -> int:
        """A version number of `name` that no other caller gets."""
        folder = f"{self.root}/model_versions/{quote(name, safe='')}"
        taken = [int(f.rsplit("/", 1)[-1]) for f in list_files(self.spark, folder) if f.rsplit("/", 1)[-1].isdigit()]
        last = self.models().where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = max([last or 0, *taken]) + 1
        while not create_new(self.spark, f"{folder}/{version}"):
            version += 1
        return version

    def models(self) -> DataFrame:
        return self._read("model_registry", MODEL_SCHEMA)

    def metrics(self) -> DataFrame:
        return self._read("run_metrics", METRIC_SCHEMA)

    def register(self, row: dict, alias: str = "champion", stage: str = "Production") -> int:
        """Append a model version under its name; the version is returned."""
        version = self._claim(row["name"])
        columns = [f.strip().split(" ")[0] for f in MODEL_SCHEMA.split(",")]
        full = {**{c: None for c in columns}, **row, "version": version, "alias": alias, "stage": stage}
        schema = MODEL_SCHEMA.rsplit(",", 1)[0]
        df = self.spark.createDataFrame([tuple(full[c] for c in columns[:-1])], schema)
        self._append(df.withColumn("updated_at", F.current_timestamp()), "model_registry")
        return version

    def by_service(self, service_conf_id: int) -> DataFrame:
        return current_models(self.models()).where(F.col("service_conf_id") == service_conf_id)

    def by_run(self, run_id: str) -> DataFrame:
        return self.models().where(F.col("run_id") == run_id)

    def log_metrics(self, run_id: str, values: dict) -> None:
        if not values:
            return
        rows = [(run_id, k, str(v)) for k, v in values.items()]
        df = self.spark.createDataFrame(rows, "run_id string, key string, value string")
        self._append(df.withColumn("ts", F.current_timestamp()), "run_metrics")

    def log_predictions(self, scored: DataFrame) -> None:
        prediction_log(scored, self.models()).write.mode("append").parquet(f"{self.root}/prediction")


def current_models(models: DataFrame, key: str = "service_conf_id", at: str = "updated_at") -> DataFrame:
    """Latest row per service: the effect of insert-or-update on an append-only table."""
    latest = F.max_by(F.struct(*models.columns), F.struct(at, "version")).alias("m")
    return models.groupBy(key).agg(latest).select("m.*")


def aliased_models(models: DataFrame) -> DataFrame:
    """The version that each (name, alias) points to."""
    latest = F.max_by(F.struct(*models.columns), F.col("version")).alias("m")
    return models.where("alias IS NOT NULL").groupBy("name", "alias").agg(latest).select("m.*")


def prediction_log(scored: DataFrame, models: DataFrame) -> DataFrame:
    """Log rows for scored URLs that have a user: metrics of the model's run, or
    the confidence as accuracy and 0 for the rest when the run is not registered.

    `models` has one row per training run. The join key is the run id, hot by nature:
    Spark broadcasts the models by their size, and AQE splits the hot run otherwise.
    """
    by_run = models.groupBy(F.col("run_id").alias("model_id")).agg(
        *[F.max_by(c, "version").alias(f"m_{c}") for c in ("accuracy", "recall", "precision", "f1")]
    )
    rows = scored.where("status = 'success' AND user_id IS NOT NULL").join(
        by_run, "model_id", "left"
    )
    zero = lambda c: F.coalesce(f"m_{c}", F.lit(0.0)).alias(f"{c}_score")
    return rows.select(
        "user_id", "url", "model_id",
        F.coalesce("m_accuracy", "confidence").alias("accuracy_score"),
        zero("recall"), zero("precision"), zero("f1"), "suggested_desc",
    )


def dataset_metrics(run_id: str, before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Sizes, class counts and ratios before and after balancing as key/value rows."""
    def side(df, prefix, size_key):
        counts = df.groupBy(label).agg(F.count("*").alias("n"))
        sums = counts.agg(F.sum("n").alias("total"), (F.max("n") / F.min("n")).alias("ratio"))
        wide = sums.select(F.explode(F.array(
            F.struct(F.lit(size_key).alias("key"), F.col("total").cast("double").alias("value")),
            F.struct(F.lit(f"{prefix}_imbalance_ratio").alias("key"), F.col("ratio").alias("value")),
        )).alias("kv")).select("kv.*")
        per = counts.select(
            F.concat(F.lit(f"{prefix}_class_count_"), F.col(label)).alias("key"),
            F.col("n").cast("double").alias("value"),
        )
        return per.unionByName(wide)

    rows = side(before, "original", "original_dataset_size").unionByName(
        side(after, "balanced", "balanced_dataset_size")
    )
    return rows.select(F.lit(run_id).alias("run_id"), "key", "value")
