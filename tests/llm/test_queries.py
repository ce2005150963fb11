"""Registered queries against their SQL, and the pipeline against plain rules."""

import collections

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from urlrisk.llm import line_rules, near_dedup, queries


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, small, name):
    ok, text = compare(spark, connect(small), small, name, entry)
    assert ok, text


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("kept", entry_column())
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "line_rules":
            want = collections.Counter()
            for r in docs.collect():
                judged = line_rules.judge_text(None if r.text is None else r.text.encode(), line_rules.LineRules())
                if judged[7]:
                    want[r.doc_id, judged[8]] += 1
            assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want
        if name == "near_duplicates":
            ids = [r.doc_id for r in out.collect()]
            assert len(ids) == len(set(ids)) < docs.count()
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] > kept[3] > 0
    ends = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(0 < r[1] <= 2048 for r in ends)
    whole = docs.selectExpr("sum(length(ids)) = 4 * sum(length)").first()[0]
    assert whole


def entry_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_pipeline_of_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0


def test_near_duplicates_stage_keeps_what_brute_force_keeps(spark, small):
    """The stage as shipped, on documents of one planted chain of near copies as well."""
    from test_operators import brute_near

    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    words = [f"w{i}" for i in range(90)]
    planted = []
    for k in range(30):  # neighbours at about 0.81, ends of the chain far apart
        planted.append((10**9 + (7 * k) % 30, " ".join(words), "en", "planted", 0))
        words[7 * k % 86] = f"n{k}"
        words[7 * k % 86 + 4] = f"m{k}"
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    least = brute_near([(r.doc_id, r.text) for r in docs.collect()], 5)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = sorted(r.doc_id for r in stage(spark, docs, small).collect())
    assert got == sorted(i for i, c in least.items() if i == c) and len(got) < len(least) - 20


def test_near_duplicate_stage_does_not_move_texts_that_stay(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the decisions were large
    try:
        docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
        out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, small)
        plan = out._jdf.queryExecution().sparkPlan()
        while plan.nodeName() != "Union":
            plan = plan.children().apply(0)
        assert "SortMergeJoin" not in plan.children().apply(0).toString()
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        judged = near_dedup.near_duplicates(docs, near_dedup.Forest(words=5, percent=80))
        assert sorted(ids) == sorted(r.doc_id for r in judged.where("kept").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
