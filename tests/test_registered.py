"""Registered queries against their SQL on the smallest tables (the quick ones;
oracle_check.py runs all of them at any scale)."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from urlrisk.config import ALGORITHMS, Settings
from urlrisk.plans import registered

QUICK = (
    "label_normalize alias_projection label_conflicts conflict_removal dedup_min dedup_first merged_dataset "
    "validate_issues preprocess dataset_profile benign_pool unique_url_list url_list_split undersample oversample "
    "stratified_split stratified_folds single_class_fill archive_names scan_feed dictionary_migrate "
    "registry_current registry_aliases job_results queue_depth url_parts text_statistics"
).split()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, small, name):
    ok, text = compare(spark, con, small, name, entry)
    assert ok, text


def test_registry_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registered.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["feature", "n_benign", "n_malicious", "mean_benign", "mean_malicious"]
    assert df.count() == 73


def test_feature_plan_has_no_shuffle_and_prunes_columns(spark, small):
    from urlrisk.operators.features import add_features

    pages = spark.read.parquet(f"{small}/pages.parquet")
    plan = add_features(pages).select("high_entropy", "path_length")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "ReadSchema: struct<url:string>" in plan


def test_registered_search_is_the_full_one_and_ends(spark, small):
    """All four algorithms, 20 candidates (9 is a decision tree's whole grid), 5 folds."""
    compared = {r.algorithm: r for r in registered.QUERIES["train_compare"](spark, small).collect()}
    assert set(compared) == set(ALGORITHMS) and all(0 < r.cv_score <= 1 and 0 < r.test_f1 <= 1 for r in compared.values())
    table = registered.QUERIES["cv_candidates"](spark, small).collect()
    assert Counter(r.algorithm for r in table) == {"decision_tree": 9, "random_forest": 20, "xgboost": 20, "svm": 20}
    for r in table:
        scores = [r[f"split{i}_test_score"] for i in range(Settings().folds)]
        assert abs(sum(scores) / 5 - r.mean_test_score) < 1e-12 and r.mean_fit_time > 0
        assert r.param_maxDepth is not None or r.algorithm == "svm"
    for name, r in compared.items():
        best = [t for t in table if t.algorithm == name and t.rank_test_score == 1]
        assert best and best[0].mean_test_score == r.cv_score
