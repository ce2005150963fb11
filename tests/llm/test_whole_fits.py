"""Fits that read every labelled row, examples that hold their text."""

import numpy as np
from pyspark.sql import functions as F

from urlrisk.llm import quality
from urlrisk.llm.scratch import Scratch


def test_every_labelled_row_is_in_a_pair(spark):
    rows = [(i, int(i % 50 != 0), [float(i)] + [0.0] * 14) for i in range(1000)]
    made = spark.createDataFrame(rows, "doc_id long, quality int, f array<double>")
    settings = quality.Settings(group=100)
    dealt = quality._deal(made, 980, 20, settings)
    assert {r.doc_id for r in dealt.collect()} == set(range(1000))
    by = dealt.groupBy("group").agg(F.sum("quality").alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    assert len(by) == 10 and all(r.good and r.bad for r in by)
    pairs = dealt.groupBy("group").applyInPandas(quality._pairs(np.zeros(15), np.full(15, 1e3)), "d array<double>")
    # With a mean of 0 and a deviation of 1,000, the first difference tells a pair's rows apart.
    assert pairs.count() == sum(max(r.good, r.bad) for r in by) >= 980


def test_quality_learns_from_more_rows_than_any_sample_held(spark):
    """Only documents beyond the first 10,000 say what is bad: 12 of them."""
    text = F.when(F.col("id") < 9988, F.lit("A plain and honest sentence stands here. It is followed by one more.")).otherwise(F.lit("$$ | | 11 $$ | 22 $$ |"))
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < 9988).cast("int").alias("quality"))
    model = quality.train(docs, labels, F.lit(True))
    assert model.score(b"$$ | | 11 $$ | 22 $$ |") < 0.3 < model.score(b"A plain and honest sentence stands here. It is followed by one more.")


def test_value_at_any_rank(spark):
    values = [0.5] * 30 + [float(x) for x in np.random.default_rng(1).normal(0, 1e-9, 500)] + [-1e6, 1e6, 3.25]
    scores = Scratch(spark, "ranks").put(spark.createDataFrame([(v,) for v in values], "score double"), "s")
    for rank in (1, 2, 250, 501, 505, 531, 532, 533):
        assert quality.value_at(scores, rank) == sorted(values)[rank - 1]


def test_examples_hold_their_text_also_of_long_conversations(spark):
    from urlrisk.llm import chat

    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(201)] + [(2, 0, "user", "q"), (None, 0, "assistant", "a </s>")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.position): r for r in made.examples.collect()}
    whole = "".join(f"<s>[INST] {r} [/INST] {t} </s>" for c, _, r, t in rows if c == 1)
    assert sorted(p for c, p in got if c == 1) == [*range(1, 200, 2), 200]
    for (c, p), r in got.items():
        if c == 1:
            assert whole.startswith(r.context + r.target) and r.target == (f"turn {p}" if p % 2 else "")
            assert (r.mask_start, r.mask_end) == (len(r.context), len(r.context) + len(r.target))
    assert (got[2, 0].context, got[2, 0].target) == ("<s>[INST] user [/INST] q </s>", "")
    assert (got[None, 0].context, got[None, 0].target) == ("<s>[INST] assistant [/INST] ", "a <\\/s>")
