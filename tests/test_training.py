import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlrisk.config import Settings, check_algorithms, check_balance_method
from urlrisk.functions.catalog import FEATURES
from urlrisk.operators import models as m
from urlrisk.operators import scoring as sc
from urlrisk.operators import selection as se
from urlrisk.operators.features import add_features
from urlrisk.plans import train as tr
from urlrisk.plans.predict import compare, predict, predict_test
from urlrisk.sources.registry import Registry
from urlrisk.streaming import workers as wk

TREE = {"decision_tree": {"maxDepth": [3], "minInstancesPerNode": [1]}}
QUICK = Settings(algorithms=("decision_tree", "svm"), candidates=1, folds=2,
                 grids={**TREE, "svm": {"regParam": [0.01], "elasticNetParam": [0.0], "maxIter": [5]}})


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"http://www.site{i}.example.com/page/{i}", "benign") for i in range(90)]
    rows += [(f"http://10.0.{i % 9}.{i}:8080/x{i}.exe?u={i}", "malicious") for i in range(40)]
    rows += [("bad[.]com/1", "malicious")]
    return spark.createDataFrame(rows, "url string, label string")


@pytest.fixture(scope="module")
def trained(spark, labelled, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("trained"))
    return out, tr.train(labelled, out, QUICK, service_conf_id=5, strict=True)


def test_settings():
    with pytest.raises(ValueError):
        check_algorithms(["nope"])
    with pytest.raises(ValueError):
        check_balance_method("nope")
    with pytest.raises(ValueError):
        Settings(balance_method="other")
    assert m.sample_candidates(m.GRIDS["svm"], 20, 1) == m.sample_candidates(m.GRIDS["svm"], 20, 1)
    assert len(m.sample_candidates(m.GRIDS["decision_tree"], 20, 1)) == 9
    picks = m.sample_candidates(m.GRIDS["xgboost"], 20, 1)
    assert len({str(p) for p in picks}) == 20
    assert all(1e-6 <= p["regParam"] <= 1e-1 for p in m.sample_candidates(m.GRIDS["svm"], 50, 2))


def test_train_end_to_end(spark, trained):
    out, result = trained
    assert result["status"] == "success", result
    assert result["metrics"]["f1"] > 0.9
    report = result["best_report"]
    assert report["dataset_info"]["balancing_method"] == "oversampling"
    info = report["dataset_info"]
    assert info["train_samples"] + info["test_samples"] == 180 and info["test_samples"] == 54
    assert set(report["model_comparison"]) == {"decision_tree", "svm"}
    assert len(report["feature_selection"]["feature_importance"]) == 73
    registry = Registry(spark, out)
    assert registry.by_service(5).first()["run_id"] == result["run_id"]
    keys = {r["key"]: r["value"] for r in registry.metrics().collect()}
    assert float(keys["original_class_count_malicious"]) == 41 and float(keys["balanced_dataset_size"]) == 180
    assert json.dumps(result["reports"], default=str)


def test_predict(spark, trained):
    out, result = trained
    urls = spark.createDataFrame(
        [("http://10.0.0.1:8080/a.exe", 1), ("www.site3.example.com/", 1), ("", 1), (None, 1), ("bad[.]com", 2)],
        "url string, user_id long")
    rows = {r["url"]: r for r in predict(urls, out, result["run_id"]).collect()}
    assert rows["http://10.0.0.1:8080/a.exe"]["is_malicious"] is True
    good = rows["www.site3.example.com/"]
    assert good["status"] == "success" and abs(sum(good["probabilities"].values()) - 1) < 1e-9
    assert good["confidence"] == max(good["probabilities"].values())
    assert rows[""]["status"] == rows[None]["status"] == rows["bad[.]com"]["status"] == "failed"
    assert rows["bad[.]com"]["class"] is None and rows["bad[.]com"]["error"] == sc.BAD_URL
    assert spark.read.parquet(f"{out}/prediction").count() == 2
    summary = predict_test(urls, out, result["run_id"])
    assert summary["status"] == "partial_success"
    assert summary["summary"]["total"] == 5 and summary["summary"]["success_rate"] == 40.0
    with pytest.raises(FileNotFoundError):
        predict(urls, out, "no-such-run")


def test_alignment(spark):
    df = spark.createDataFrame([("u", 1.0, None)], "url string, url_length double, dot_count double")
    row = sc.align(df, ["dot_count", "digit_ratio", "url_length"]).first()
    assert tuple(row) == ("u", 0.0, 0.0, 1.0)


def test_compare(spark):
    rows = {r["feature"]: r for r in compare(spark, ["http://a.b/", "https://ccc.d/e.exe"]).collect()}
    assert len(rows) == 73 and rows["url_length"]["url_1"] == 11.0 and rows["url_length"]["url_2"] == 19.0
    with pytest.raises(ValueError):
        compare(spark, ["one"])


def test_failures_stay_isolated(spark, labelled, tmp_path):
    settings = Settings(algorithms=("decision_tree", "svm"), candidates=1, folds=2, apply_balancing=False,
                        grids={**TREE, "svm": {"noSuchParam": [1]}})
    result = tr.evaluate(labelled, str(tmp_path), settings)
    assert result["best_algorithm"] == "decision_tree" and set(result["results"]) == {"decision_tree"}
    bad = spark.createDataFrame([("a", "weird"), (None, "benign")], "url string, label string")
    failed = tr.train(bad, str(tmp_path / "bad"), QUICK, strict=True)
    assert failed["status"] == "failed" and "validation" in failed["error"]


def test_balance_train_only_keeps_the_test_part(spark, labelled):
    featured = add_features(labelled).drop("is_valid_url")
    settings = Settings(balance_method="smote", balance_train_only=True)
    rows, _, method = tr.prepare(featured, settings)
    assert method == "smote"
    test = rows.where("is_test")
    assert test.count() == 40 and test.where("url IS NULL").count() == 0
    counts = {r["label"]: r["count"] for r in rows.where("NOT is_test").groupBy("label").count().collect()}
    assert counts["benign"] == counts["malicious"] == 63


def test_per_dataset_rows_count_a_repeated_url_once(spark):
    rows = [("d", f"http://bad{i % 10}.example/", "malicious") for i in range(60)]
    rows += [("d", f"http://good{i}.example/", "benign") for i in range(5)]
    got = tr.per_dataset_rows(spark.createDataFrame(rows, "dataset string, url string, label string"), seed=3)
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {"malicious": 5, "benign": 5}


def test_per_dataset(spark, labelled, tmp_path):
    two = labelled.withColumn("dataset", F.lit("two"))
    one = labelled.where("label = 'malicious'").withColumn("dataset", F.lit("one"))
    settings = Settings(algorithms=("decision_tree",), candidates=1, folds=2, grids=TREE)
    result = tr.train_per_dataset(two.unionByName(one), str(tmp_path), settings)
    assert result["status"] == "success" and sorted(result["datasets_trained"]) == ["one", "two"], result
    methods = {d: r["best_report"]["dataset_info"] for d, r in result["models"].items()}
    assert methods["one"]["balancing_method"] == "benign_merge"
    assert methods["two"]["balancing_method"] == "undersample_to_min"
    assert methods["two"]["total_samples"] == 82 and methods["one"]["total_samples"] == 82


def test_selection(spark, labelled):
    featured = add_features(labelled).drop("is_valid_url").cache()
    names = ["url_length", "dot_count", "digit_ratio", "unicode_domain_flag", "path_length"]
    kept = se.above_variance(featured, names)
    assert "unicode_domain_flag" not in kept and "url_length" in kept
    pdf = featured.select(names).toPandas()
    corr = pdf.corr().abs().fillna(0).to_numpy()
    expected = []
    for i in range(len(names)):
        if not any(corr[i, j] > 0.95 for j in expected):
            expected.append(i)
    assert se.uncorrelated(featured, names) == [names[i] for i in expected]
    cells = spark.createDataFrame([("f", 0, "a", 5), ("f", 1, "b", 5), ("g", 0, "a", 5), ("g", 0, "b", 5)],
                                  "feature string, bin int, label string, n long")
    mi = {r["feature"]: r["mi"] for r in se.information(cells).collect()}
    assert mi["f"] == pytest.approx(np.log(2)) and mi["g"] == pytest.approx(0.0)
    assert "unicode_domain_flag" not in se.informative(featured, names, k=2)


def test_exact_quantile_bins_and_correlations(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = np.column_stack([rng.normal(size=n) * 1e-9, np.round(rng.normal(size=n), 1), rng.integers(-3, 3, n) * 1e12, np.full(n, 0.1), -rng.random(n)])
    x[:, 4] += 2 * x[:, 1]
    names = list("abcde")
    rows = [(*map(float, r), "yes" if r[1] > 0.2 else "no") for r in x] + [(None, float("nan"), -0.0, None, None, "yes")]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in names) + ", label string").repartition(7)
    cuts = se.exact_cuts(df, names, 10)
    for f in range(5):
        values = np.sort([r[f] for r in rows if r[f] is not None and r[f] == r[f]])
        assert cuts[f] == [values[-(-k * len(values) // 10) - 1] for k in range(1, 10)]
    mi = {r["feature"]: r["mi"] for r in se.mutual_information(df, names).collect()}
    assert set(mi) == set(names) and mi["b"] > 0.5 > mi["c"] and mi["d"] < 0.01
    assert se.mutual_information(df.limit(0), names).count() == 0 and se.correlations(df.limit(0), names).count() == 0
    r = {(p["feature_a"], p["feature_b"]): p["r"] for p in se.correlations(df.dropna().where("NOT isnan(b)"), names).collect()}
    want = np.corrcoef(x[:, [0, 1, 2, 4]].T)
    at = dict(zip("abce", range(4)))
    assert len(r) == 10 and all(v is None if "d" in k else abs(v - want[at[k[0]], at[k[1]]]) < 1e-9 for k, v in r.items())
    assert se.uncorrelated(df.dropna().where("NOT isnan(b)"), names) == ["a", "b", "c", "d"]


def test_workers(spark, trained, tmp_path):
    out, result = trained
    root = tmp_path / "queue"
    jobs = root / wk.PREDICTION_QUEUE
    jobs.mkdir(parents=True)
    run = result["run_id"]
    (jobs / "1.json").write_text("\n".join(json.dumps(j) for j in [
        {"job_id": "a", "url": "http://10.0.0.1:8080/a.exe", "model_id": run},
        {"job_id": "b", "urls": ["http://x.com/", "", "bad[.]com"], "model_id": run, "user_id": 3},
        {"job_id": "c", "urls": []}, {"job_id": "d", "url": "http://x.com/", "model_id": "missing"},
        {"job_id": "e"}]) + "\n{broken\n")
    wk.prediction_worker(spark, str(root), out, default_model=run).awaitTermination()
    done = {r["job_id"]: r for r in wk.results(spark, str(root)).collect()}
    assert len(done) == 6
    assert (done["a"]["status"], done["a"]["total"]) == ("success", 1)
    assert (done["b"]["status"], done["b"]["total"], done["b"]["successful"], done["b"]["failed"]) == ("success", 3, 1, 2)
    assert done["c"]["status"] == done["d"]["status"] == done["e"]["status"] == "failed"
    assert sum(r["error"] == "Malformed job message" for r in done.values()) == 1
    # a restart finds nothing new, a new message is worked on alone
    (jobs / "2.json").write_text(json.dumps({"job_id": "f", "url": "http://y.com/", "model_id": run}))
    wk.prediction_worker(spark, str(root), out, default_model=run).awaitTermination()
    assert wk.results(spark, str(root)).count() == 7
    # a repeated batch gives the same rows, also when a model is gone by then
    lines = spark.read.text(str(jobs / "1.json"))
    count = lambda: spark.read.parquet(str(root / wk.RESULT_QUEUE / "predictions")).count()
    rows = count()
    wk.handle_predictions(wk.parse_jobs(lines), 0, str(root), out, {}, run)
    assert count() == rows and wk.results(spark, str(root)).count() == 7
    wk.handle_predictions(wk.parse_jobs(lines), 0, str(root), str(tmp_path / "no-models"), {}, run)
    done = {r["job_id"]: r for r in wk.results(spark, str(root)).collect()}
    assert count() == 1 and done["a"]["error"] == f"Failed to load model: {run} (not found)" and done["f"]["status"] == "success"
    # failed jobs are worked on when they are sent again, a successful one is not
    again = lines.union(spark.read.text(str(jobs / "2.json"))).union(lines)
    wk.handle_predictions(wk.parse_jobs(again), 5, str(root), out, {}, run)
    done = {r["job_id"]: r for r in wk.results(spark, str(root)).collect()}
    assert len(done) == 7 and count() == rows and done["a"]["status"] == "success" and done["b"]["total"] == 3
    (jobs / "3.json").write_text(json.dumps({"job_id": "g", "url": "http://y.com/"}))
    status = {r["queue"]: r["job_count"] for r in wk.queue_status(spark, str(root)).collect()}
    assert status == {"prediction": 1, "result": 7}


def test_combined_worker(spark, labelled, trained, tmp_path):
    out, result = trained
    root, data = tmp_path / "queue", tmp_path / "data"
    for q in (wk.TRAINING_QUEUE, wk.PREDICTION_QUEUE):
        (root / q).mkdir(parents=True)
    data.mkdir()
    labelled.toPandas().to_csv(data / "set.csv", index=False)
    (root / wk.TRAINING_QUEUE / "t.json").write_text("\n".join(json.dumps(j) for j in [
        {"job_id": "t1", "dataset_files": ["set.csv"], "algorithms": ["decision_tree"], "service_conf_id": 9,
         "balance_method": "undersampling"},
        {"job_id": "t2"}, {"job_id": "t3", "dataset_files": ["set.csv"], "algorithms": ["nope"]}]))
    (root / wk.PREDICTION_QUEUE / "p.json").write_text(json.dumps({"job_id": "p1", "url": "http://x.com/"}))
    settings = Settings(candidates=1, folds=2, grids=TREE)
    wk.combined_worker(spark, str(root), out, str(data), settings, default_model=result["run_id"]).awaitTermination()
    done = {r["job_id"]: r for r in wk.results(spark, str(root)).collect()}
    assert done["t1"]["status"] == "success" and done["t1"]["job_type"] == "training", done["t1"]
    assert done["t2"]["status"] == done["t3"]["status"] == "failed"
    assert done["p1"]["status"] == "success"
    assert Registry(spark, out).by_service(9).first()["run_id"] == done["t1"]["run_id"]
    # a batch that is repeated, or a job sent again, trains nothing that has a result
    lines = wk.parse_jobs(spark.read.text(str(root / wk.TRAINING_QUEUE)))
    for batch in (0, 1):
        wk.handle_training(lines, batch, str(root), out, str(data), settings)
    again = {r["job_id"]: r for r in wk.results(spark, str(root)).collect()}
    assert len(again) == 4 and again["t1"]["run_id"] == done["t1"]["run_id"] and again["t3"]["status"] == "failed"


def test_scoring_computes_only_what_a_tree_reads(spark):
    from urlrisk.operators import models as mo
    from urlrisk.operators import scoring as sc
    from urlrisk.operators.features import add_features

    rows = spark.range(60).selectExpr("if(id % 2 = 0, 'http://a.example/' || id, 'http://b.example/x?q=' || id) as url", "if(id % 2 = 0, 'benign', 'malicious') as label")
    train = mo.label_indexer(rows).transform(rows).transform(lambda d: add_features(d).drop("is_valid_url"))
    model = mo.pipeline("decision_tree", {"maxDepth": 3}, 7).fit(train)
    read = sc.read_features(model, sc.FEATURES)
    assert read and len(read) < 10
    urls = rows.union(spark.sql("select 'http://[bad/', null union all select '', null"))
    lean, whole = (sc.score(urls, model, ["benign", "malicious"], with_features=w).select("url", "status", "error", "class", "confidence", "probabilities") for w in (False, True))
    assert sorted(map(str, lean.collect())) == sorted(map(str, whole.collect()))
    plan = lean._jdf.queryExecution().optimizedPlan().toString()
    assert "random_string_domain_flag" in read or "aeiou" not in plan
