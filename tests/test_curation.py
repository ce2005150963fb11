import random

from pyspark.sql import functions as F

import pytest

from urlrisk.functions.labels import normalize_label
from urlrisk.functions.advice import advice
from urlrisk.operators import curation as c
from urlrisk.operators.imbalance import balance_method, imbalance_profile, severity
from urlrisk.operators.metrics import (
    champion, classification_report, confusion_matrix, weighted_metrics,
)


def test_label_normalisation(spark):
    raw = [None, "0", "1.0", "2", "3", "True", "false", " Safe ", "GOOD", "malware_download", "4",
           "unknown", "-0.5", "Phishing\n", ""]
    want = ["malicious", "benign", "malicious", "malicious", "malicious", "malicious", "benign",
            "benign", "benign", "malicious", "4", "unknown", "benign", "malicious", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(normalize_label(F.col("raw"))).collect()]
    assert got == want
    numbers = spark.createDataFrame([(0.0, True), (1.9, False)], "a double, b boolean")
    rows = numbers.select(normalize_label(F.col("a")), normalize_label(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("benign", "malicious"), ("malicious", "benign")]


def test_standardize_aliases(spark):
    df = spark.createDataFrame([("u", "t", "0", "spam")], "url string, text string, type string, class string")
    assert tuple(c.standardize(df).first()) == ("u", "malicious")
    assert tuple(c.standardize(df.drop("url", "class")).first()) == ("t", "benign")
    assert tuple(c.standardize(df.select("text")).first()) == ("t", "malicious")
    with pytest.raises(ValueError):
        c.standardize(df.select("type"))


ROWS = [("a", "benign"), ("a", "malicious"), ("b", "benign"), ("b", "benign"), ("c", "malicious"),
        (None, "malicious"), (None, "benign"), ("d", "malicious"), ("d", "malicious")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(u, l, i) for i, (u, l) in enumerate(rows)],
                                 "url string, label string, pos int").repartition(3)


def test_conflicts_and_dedup(spark):
    df = frame(spark)
    assert [tuple(r) for r in c.conflicts(df).collect()] == [("a", 2, 2)]
    left = c.remove_conflicts(df)
    assert left.count() == 7 and left.where("url IS NULL").count() == 2
    want = {("b", "benign"), ("c", "malicious"), ("d", "malicious"), (None, "benign")}
    assert {tuple(r) for r in c.settle(df.select("url", "label")).collect()} == want
    two_steps = c.dedup_min_label(c.remove_conflicts(df))
    assert {tuple(r) for r in two_steps.collect()} == want
    merged = c.merged([df.select("url", "label"), df.select("url", "label")]).collect()
    assert [tuple(r) for r in merged] == [(None, "benign"), ("b", "benign"), ("c", "malicious"), ("d", "malicious")]


def test_first_seen(spark):
    got = {tuple(r) for r in c.dedup_first_seen(frame(spark), "pos").collect()}
    assert got == {("a", "benign", 0), ("b", "benign", 2), ("c", "malicious", 4), (None, "malicious", 5),
                   ("d", "malicious", 7)}
    rng = random.Random(1)
    rows = [(f"u{rng.randrange(50)}", f"l{i}") for i in range(500)]
    first = {}
    for u, l in rows:
        first.setdefault(u, l)
    got = {(r["url"], r["label"]) for r in c.dedup_first_seen(frame(spark, rows), "pos").collect()}
    assert got == set(first.items())


def test_validation(spark):
    df = spark.createDataFrame([("a", "benign"), (None, "weird"), ("b", None)], "url string, label string")
    found = {tuple(r) for r in c.validation_issues(df).collect()}
    assert found == {("null_values", "url", 1), ("null_values", "label", 1), ("invalid_label", "weird", 1)}
    ok, findings = c.validate(df)
    assert not ok and findings.count() == 3
    ok, findings = c.validate(df.where("label = 'benign'"))
    assert ok and findings.count() == 0
    many = spark.createDataFrame([(str(i), f"odd{i}") for i in range(50)], "url string, label string")
    assert c.validate(many)[1].count() == 50
    assert c.validate(spark.createDataFrame([("x",)], "other string"))[0] is False


def test_preprocess(spark):
    df = spark.createDataFrame(
        [("a", " Phishing ", 1), ("a", "benign", 2), (None, "benign", 3), ("b", "odd", 4), ("c", "0", 5)],
        "url string, type string, pos int")
    got = {(r["url"], r["label"]) for r in c.preprocess(df, order="pos").collect()}
    assert got == {("a", "malicious"), ("c", "benign")}


def test_profile_and_pool(spark):
    df = spark.createDataFrame(
        [("x", "u1", "benign"), ("x", "u2", "malicious"), ("x", "u3", "benign"), ("y", "u4", "malicious"),
         ("z", "u1", "benign"), ("z", "u5", "malicious")], "dataset string, url string, label string")
    rows = {r["dataset"]: tuple(r)[1:] for r in c.dataset_profile(df).collect()}
    assert rows == {"x": (3, 2, 1, True, 1), "y": (1, 0, 1, False, 0), "z": (2, 1, 1, True, 1)}
    assert {r["url"] for r in c.benign_pool(df).collect()} == {"u1", "u3"}


def test_balance_rules(spark):
    cases = [(199, 100, "balanced", "none"), (200, 100, "mild", "oversampling"), (2000, 1000, "mild", "smote"),
             (500, 100, "moderate", "smote"), (400, 40, "severe", "oversampling"),
             (2000, 100, "extreme", "smote"), (20001, 1000, "extreme", "undersampling"),
             (50, 5, "severe", "oversampling"), (499, 100, "mild", "oversampling"), (1000, 100, "severe", "smote")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)],
                               "i int, hi long, lo long, want_s string, want_m string")
    level = severity(F.col("hi") / F.col("lo"))
    rows = df.select("*", level.alias("s"), balance_method(level, F.col("hi") + F.col("lo"), F.col("lo"), F.col("hi")).alias("m"))
    for r in rows.collect():
        assert (r["s"], r["m"]) == (r["want_s"], r["want_m"]), r
    one = spark.createDataFrame([("benign",)] * 6 + [("malicious",)] * 2, "label string")
    p = imbalance_profile(one).first()
    assert p["class_counts"] == {"benign": 6, "malicious": 2} and p["imbalance_ratio"] == 3.0
    assert p["class_distribution"] == {"benign": 0.75, "malicious": 0.25} and p["is_imbalanced"]
    assert p["balancing_method"] == "oversampling" and p["total_samples"] == 8


def test_golden_metrics(spark):
    counts = spark.createDataFrame(
        [("benign", "benign", 157641), ("benign", "malicious", 5694),
         ("malicious", "benign", 11905), ("malicious", "malicious", 150484)],
        "label string, prediction string, n long")
    w = weighted_metrics(counts).first()
    assert w["accuracy"] == pytest.approx(0.945969593889305, abs=1e-14)
    assert w["f1"] == pytest.approx(0.9459469453089422, abs=1e-14)
    assert w["precision"] == pytest.approx(0.9466133114040953, abs=1e-14)
    assert w["recall"] == pytest.approx(0.945969593889305, abs=1e-14)
    report = {r["class"]: r for r in classification_report(counts).collect()}
    assert report["benign"]["precision"] == pytest.approx(0.9297830677220341, abs=1e-14)
    assert report["benign"]["recall"] == pytest.approx(0.9651391312333547, abs=1e-14)
    assert report["macro avg"]["f1"] == pytest.approx(0.9459434956942228, abs=1e-14)
    assert report["weighted avg"]["support"] == report["accuracy"]["support"] == 325724
    m = {r["label"]: (r["pred_benign"], r["pred_malicious"])
         for r in confusion_matrix(counts, ["benign", "malicious"]).collect()}
    assert m == {"benign": (157641, 5694), "malicious": (11905, 150484)}


def test_metrics_with_missing_classes(spark):
    counts = spark.createDataFrame([("a", "b", 3), ("b", "b", 1)], "label string, prediction string, n long")
    report = {r["class"]: r for r in classification_report(counts).collect()}
    assert report["a"]["precision"] == report["a"]["f1"] == 0.0
    assert report["b"]["precision"] == 0.25 and report["b"]["recall"] == 1.0
    best = champion(spark.createDataFrame([("x", 0.5), ("z", 0.9), ("y", 0.9)], "algorithm string, f1 double"))
    assert best.first()["algorithm"] == "y"


def test_advice(spark):
    df = spark.createDataFrame(
        [("benign", 0.95), ("benign", 0.8), ("benign", 0.6), ("malicious", 0.87654), ("phishing", 0.5),
         ("malware", 0.5), ("redirect", 0.5), ("spam", 0.5)], "c string, p double")
    got = [r[0] for r in df.select(advice(F.col("c"), F.col("p"))).collect()]
    assert got[0].endswith("high confidence.") and "caution" in got[1] and "Verify" in got[2]
    assert got[3] == "This URL has been classified as malicious with 87.65% confidence."
    assert all("50.00%" in t for t in got[4:])
