"""Prediction and training workers.

A queue is a folder; a message is one JSON line of a file dropped there. Results
go to tables, one folder per micro-batch that is written as a whole and overwritten
when a batch is repeated. The tables of job results are the ledger: a job that
succeeded in another batch is not worked on again, one that failed may be sent again,
and of messages with one job_id in a batch the least text counts. Trainings write their
result one by one, so a repeated batch trains only what has none. The per-URL results
are rows; the per-job result has the counts.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import batch_summary, score
from ..plans.train import train
from ..config import Settings
from ..sources.artifacts import load_model, run_ids
from ..sources.paths import exists, remove, stored
from ..sources.readers import merged_dataset

# Queue names.
TRAINING_QUEUE = "ml_training_queue"
PREDICTION_QUEUE = "ml_prediction_queue"
RESULT_QUEUE = "ml_result_queue"

JOB_SCHEMA = (
    "job_id string, url string, urls array<string>, user_id long, model_id string, "
    "service_conf_id long, dataset_files array<string>, algorithms array<string>, "
    "run_name string, balance_method string, _corrupt_record string"
)
JOB_RESULT = (
    "job_id string, job_type string, status string, error string, total long, successful long, "
    "failed long, run_id string, best_algorithm string"
)


def parse_jobs(lines: DataFrame) -> DataFrame:
    """Message columns plus `bad`, the reason a message cannot be worked on. A
    message without job_id gets one from its text."""
    job = F.from_json("value", JOB_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.where("trim(value) <> ''").select("value", job.alias("j"))
    return parsed.select(
        "value", "j.*", F.when(
            F.col("j").isNull() | F.col("j._corrupt_record").isNotNull(), "Malformed job message"
        ).alias("bad"),
    ).withColumn("job_id", F.coalesce("job_id", F.md5("value"))).drop("_corrupt_record")


def job_urls(jobs: DataFrame) -> DataFrame:
    """One row per URL of a prediction job: the list if there is one, else the
    single URL (NULL if that is missing too)."""
    targets = F.when(F.col("urls").isNotNull(), F.col("urls")).otherwise(F.array("url"))
    return jobs.select(
        "job_id", "model_id", "user_id", F.col("urls").isNotNull().alias("is_batch"),
        F.explode(targets).alias("url"),
    )


def job_results(scored: DataFrame) -> DataFrame:
    """Counts per job. A batch job succeeds as a whole; a single URL decides its job."""
    summary = batch_summary(scored, by=["job_id", "is_batch"])
    single = F.when(F.col("successful") > 0, "success").otherwise("failed")
    return summary.select(
        "job_id", F.lit("prediction").alias("job_type"),
        F.when(F.col("is_batch"), "success").otherwise(single).alias("status"),
        F.lit(None).cast("string").alias("error"), "total", "successful", "failed",
    )


def unfinished(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """One message per job_id (the least text), of jobs that `done` (job_id, status) does
    not hold as successful. Broken messages without a job_id have one from their text."""
    one = jobs.groupBy("job_id").agg(F.min(F.struct("value", *[c for c in jobs.columns if c not in ("value", "job_id")])).alias("_m"))
    good = done.where("status = 'success'").select("job_id").distinct()
    return one.select("job_id", "_m.*").join(good, "job_id", "left_anti").select(*jobs.columns)


def _failed(jobs: DataFrame, kind: str, error) -> DataFrame:
    return jobs.select(
        "job_id", F.lit(kind).alias("job_type"), F.lit("failed").alias("status"), error.alias("error")
    )


def _write(df: DataFrame, root: str, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{RESULT_QUEUE}/{table}/batch={batch}")


def _ledger(spark: SparkSession, root: str, table: str, without_batch: int) -> DataFrame:
    """Job results of the batches but one."""
    path = f"{root}/{RESULT_QUEUE}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], JOB_RESULT)
    return spark.read.schema(f"{JOB_RESULT}, batch long").parquet(path).where(F.col("batch") != without_batch).drop("batch")


def handle_predictions(jobs: DataFrame, batch: int, root: str, out: str, models: dict, default_model) -> None:
    """Score the prediction jobs of one micro-batch; `models` caches by run id."""
    spark = jobs.sparkSession
    jobs = stored(unfinished(jobs, _ledger(spark, root, "prediction_jobs", batch)), "prediction-jobs")
    jobs = jobs.withColumn("model_id", F.coalesce("model_id", F.lit(default_model)))
    empty = F.col("urls").isNotNull() & (F.size("urls") == 0)
    problem = F.coalesce(F.col("bad"), F.when(empty, "The job has an empty list of URLs"),
                         F.when(F.col("model_id").isNull(), "The job names no model and there is no default"))
    jobs = jobs.withColumn("problem", problem)
    good = jobs.where("problem IS NULL")
    asked = good.where(F.col("model_id").isin(run_ids(spark, f"{out}/models"))).select("model_id").distinct().collect()  # at most the models that exist
    parts, broken = [], {}
    for run_id in sorted(r["model_id"] for r in asked):
        try:
            if run_id not in models:
                models[run_id] = load_model(spark, f"{out}/models", run_id)
        except Exception as e:
            broken[run_id] = type(e).__name__
            continue
        parts.append(score(job_urls(good.where(F.col("model_id") == run_id)), *models[run_id], run_id))
    usable = [r["model_id"] for r in asked if r["model_id"] not in broken]
    reason = F.lit("not found")
    for run_id, name in broken.items():
        reason = F.when(F.col("model_id") == run_id, name).otherwise(reason)
    text = F.concat(F.lit("Failed to load model: "), "model_id", F.lit(" ("), reason, F.lit(")"))
    done = _failed(jobs.where("problem IS NOT NULL"), "prediction", F.col("problem")).unionByName(
        _failed(good.where(~F.col("model_id").isin(usable)), "prediction", text)
    )
    path = f"{root}/{RESULT_QUEUE}/predictions/batch={batch}"
    if parts:
        reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(path)
        done = done.unionByName(job_results(spark.read.parquet(path)), allowMissingColumns=True)
    else:
        remove(spark, path)  # of an attempt that found a model
    _write(_typed(done), root, "prediction_jobs", batch)


def _typed(df: DataFrame) -> DataFrame:
    """The job-result schema, missing columns as NULL."""
    have = set(df.columns)
    fields = [f.strip().split(" ") for f in JOB_RESULT.split(",")]
    return df.select(
        *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields]
    )


def handle_training(jobs: DataFrame, batch: int, root: str, out: str, data: str, settings: Settings) -> None:
    """Train per job, one after the other; each training is a distributed job. A result is
    written as its training ends. Jobs come to the driver a partition at a time."""
    spark = jobs.sparkSession
    todo = stored(unfinished(jobs, _ledger(spark, root, "training_jobs", batch)), "training-jobs")
    for job in todo.toLocalIterator():  # messages, not data
        path = f"{root}/{RESULT_QUEUE}/training_jobs/batch={batch}/job={hashlib.md5(job['job_id'].encode()).hexdigest()}"
        if exists(spark, f"{path}/_SUCCESS"):
            continue
        result = {"status": "failed", "error": job["bad"]}
        if job["bad"] is None:
            result = _train_one(spark, job, out, data, settings)
        row = (job["job_id"], "training", result["status"], result.get("error"), None, None, None,
               result.get("run_id"), result.get("best_algorithm"))
        spark.createDataFrame([row], JOB_RESULT).coalesce(1).write.mode("overwrite").parquet(path)


def _train_one(spark, job, out, data, settings) -> dict:
    try:
        if not job["dataset_files"]:
            raise ValueError("the job names no dataset file")
        chosen = Settings(**{
            **settings.__dict__,
            "algorithms": tuple(job["algorithms"] or settings.algorithms),
            "balance_method": job["balance_method"] or settings.balance_method,
        })
        merged = merged_dataset(spark, data, job["dataset_files"], f"{out}/merged/{job['job_id']}")
        return train(merged, out, chosen, service_conf_id=job["service_conf_id"])
    except Exception as e:
        return {"status": "failed", "error": str(e)}


def _queue(spark: SparkSession, root: str, name: str, per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(f"{root}/{name}")


def prediction_worker(spark, root, out, default_model=None, per_trigger=None, available_now=True):
    """Start the prediction query; `out` holds the models."""
    models: dict = {}

    def work(lines, batch):
        handle_predictions(parse_jobs(lines), batch, root, out, models, default_model)

    return _start(_queue(spark, root, PREDICTION_QUEUE, per_trigger), work, f"{root}/_checkpoints/prediction", available_now)


def training_worker(spark, root, out, data, settings=None, per_trigger=None, available_now=True):
    def work(lines, batch):
        handle_training(parse_jobs(lines), batch, root, out, data, settings or Settings())

    return _start(_queue(spark, root, TRAINING_QUEUE, per_trigger), work, f"{root}/_checkpoints/training", available_now)


def combined_worker(spark, root, out, data, settings=None, default_model=None, available_now=True):
    """Both queues in one query; in every micro-batch training comes first."""
    models: dict = {}
    both = _queue(spark, root, TRAINING_QUEUE, None).withColumn("queue", F.lit("training")).unionByName(
        _queue(spark, root, PREDICTION_QUEUE, None).withColumn("queue", F.lit("prediction"))
    )

    def work(lines, batch):
        lines.persist()
        training = parse_jobs(lines.where("queue = 'training'").select("value"))
        handle_training(training, batch, root, out, data, settings or Settings())
        predictions = parse_jobs(lines.where("queue = 'prediction'").select("value"))
        handle_predictions(predictions, batch, root, out, models, default_model)
        lines.unpersist()

    return _start(both, work, f"{root}/_checkpoints/combined", available_now)


def _start(stream: DataFrame, work, checkpoint: str, available_now: bool):
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def results(spark: SparkSession, root: str) -> DataFrame:
    """The result of every job so far: the latest, where a failed job was sent again."""
    df = spark.createDataFrame([], f"{JOB_RESULT}, batch long")
    for table in ("training_jobs", "prediction_jobs"):
        path = f"{root}/{RESULT_QUEUE}/{table}"
        if exists(spark, path):
            df = df.unionByName(spark.read.schema(f"{JOB_RESULT}, batch long").parquet(path).select(df.columns))
    fields = [c for c in df.columns if c not in ("job_id", "job_type", "batch")]
    last = df.groupBy("job_id", "job_type").agg(F.max_by(F.struct(*fields), "batch").alias("r"))
    return last.select("job_id", "job_type", "r.*")


def pending(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs (queue, job_id, ...) that have no result yet."""
    return jobs.join(done.select("job_id").distinct(), "job_id", "left_anti")


def queue_depth(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return pending(jobs, done).groupBy("queue").agg(F.count("*").alias("job_count"))


def queue_status(spark: SparkSession, root: str) -> DataFrame:
    """queue, job_count of the three queues (the result queue counts results)."""
    done = results(spark, root)
    counts = done.select(F.lit("result").alias("queue")).groupBy("queue").agg(F.count("*").alias("job_count"))
    for kind, name in (("training", TRAINING_QUEUE), ("prediction", PREDICTION_QUEUE)):
        if exists(spark, f"{root}/{name}"):
            jobs = parse_jobs(spark.read.text(f"{root}/{name}")).withColumn("queue", F.lit(kind))
            counts = counts.unionByName(queue_depth(jobs, done))
    return counts
