"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the corpus's words by weight, none above a multiple of its own size. A
source's target is whole epochs, in which every document takes part, and a rest. The
rest goes to the documents with the smallest exponential keys, -ln(u) / weight, up to
the word budget. u is a hash of seed and document, so reruns agree.

No source is sorted in one task: rows are range-partitioned by (source, key), each
partition's words are summed, and prefix sums start from the sums of the partitions
before. What is computed in one task is per partition or per source, not per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import WORD


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cleanliness(text: Column) -> Column:
    """A quality weight from 0.1 to 1: less for texts with many symbols."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    share = symbols / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 5 * share), F.lit(0.1))


def exponential_key(seed: int, identity: list[Column], weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1] from a hash; no key for weights of 0 or below."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11)  # 53 bits
    u = (h + 1) / F.lit(float(2**53))
    return F.when(weight > 0, -F.log(u) / weight)


def ranked_sources(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """`sizes` with `rank`: 0, 1, 2 ... by code point of the source, null last. The sort is
    distributed; ranks follow from the counts of the sorted partitions."""
    ordered = scratch.put(
        sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_i", F.monotonically_increasing_id()), "sources"
    )
    # Ids within a partition are dense and start at partition << 33.
    part = F.shiftright("_i", 33)
    counts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    within = F.col("_i") - F.shiftleft(F.col("_p"), 33)
    return ordered.withColumn("_p", part).join(starts, "_p").withColumn("rank", F.col("_start") + within).drop("_p", "_i", "_start")


def with_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """`source, source_size, target`: `share` of all words by weight, no target above `most`
    times its source's size; the excess goes to the others by weight, until none is above.
    Each round is one small aggregate that yields three numbers."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = scratch.put(ranked_sources(sizes, scratch).withColumn("weight", weight), "ranked")
    limit = most * F.col("source_size")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words per unit of weight
    while True:
        capped = F.col("weight") * level >= limit if level else F.lit(False)
        spent, rest = table.agg(F.sum(F.when(capped, limit)), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (total - (spent or 0.0)) / rest if rest else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * level, limit) if level else F.lit(0.0)
    return table.select("source", "source_size", target.cast("double").alias("target"))


def _key(seed: int, quality: Column | None) -> Column:
    text = F.col("text")
    key = exponential_key(seed, [F.col("doc_id"), text], cleanliness(text) if quality is None else quality)
    return F.coalesce(key, F.lit(float("inf")))


def _judged(
    docs: DataFrame, weights: tuple[float, ...], share: float, most: int, key: Column, partitions: int | None,
    carry: tuple[str, ...], last: str, scratch: Scratch,
) -> DataFrame:
    """`doc_id, source, size, _key, source_size, target, epochs, once` and the columns in
    `carry`; rows with equal keys and ids come in order of `last`. Texts are read once."""
    rows = docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"), key.alias("_key"))
    rows = scratch.put(rows, "rows")  # without texts
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.put(
        rows.repartitionByRange(n, F.col("source").asc_nulls_first(), "_key", "doc_id").withColumn("_p", F.spark_partition_id()), "keyed"
    )
    scratch.drop(rows)
    sums = scratch.put(ranged.groupBy("source", "_p").agg(F.sum("size").alias("_sum")), "sums")
    sizes = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = with_targets(sizes, weights, share, most, scratch)
    before = Window.partitionBy("source").orderBy("_p")
    starts = sums.select("source", "_p", (F.sum("_sum").over(before) - F.col("_sum")).alias("_start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    starts = scratch.put(starts, "starts")
    joined = ranged.join(starts, ranged["source"].eqNullSafe(starts["source"]) & (ranged["_p"] == starts["_p"])).drop(
        starts["source"], starts["_p"]
    )
    within = Window.partitionBy("_p", "source").orderBy("_key", "doc_id", last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    budget = F.col("target") - epochs * F.col("source_size")
    up_to = F.col("_start") + F.sum("size").over(within)
    once = (F.col("size") > 0) & (up_to - F.col("size") / 2 <= budget) & (budget > 0)
    return joined.withColumns({"epochs": epochs, "once": once})


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17,
    quality: Column | None = None, partitions: int | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """`doc_id, source, size, source_size, target, times, taken` and the columns in `carry`,
    one row per row of `docs` (`doc_id, text, source`).

    `times` says how often the mix repeats a document, `taken` is times * size. Whole
    epochs come first; then the documents with the smallest keys are taken once more, and
    the one that crosses the budget is taken if that leaves the source nearer its target.
    Null and empty texts have size 0 and are never taken beyond the epochs; a null source
    is a source; equal rows have equal keys and stand side by side. A quality weight that
    is null, or not above 0, puts a document last. An empty table gives an empty table.
    """
    judged = _judged(docs, weights, share, most, _key(seed, quality), partitions, carry, "size", Scratch(docs.sparkSession, "mixing"))
    times = (F.col("epochs") + F.col("once").cast("int")).cast("long")
    return judged.withColumn("times", times).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), *carry
    )


def times(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17,
    quality: Column | None = None, partitions: int | None = None,
) -> DataFrame:
    """The rows of `docs` (`doc_id, text, source` and any others) with the `times` of `mix`.

    Texts stay where they are: what a source takes once more is all up to its last row in
    order of the keys, so a row is told by its own key, and only one row per source is
    joined. Of equal rows, the first ones in the table come first. `docs` are read twice
    and must give the same rows in the same order, as a stored table does.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key = _key(seed, quality)
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    judged = _judged(placed, weights, share, most, key, partitions, ("_row",), "_row", scratch)
    upto = F.max(F.when(F.col("once"), F.struct("_key", "doc_id", "_row"))).alias("_upto")
    limits = scratch.put(judged.groupBy("source").agg(F.max("epochs").alias("_epochs"), upto), "limits")
    limits = limits.withColumnRenamed("source", "_source")
    rows = placed.withColumn("_own", F.struct(key.alias("_key"), "doc_id", "_row")).join(limits, F.col("source").eqNullSafe(F.col("_source")))
    once = F.coalesce(F.col("_own") <= F.col("_upto"), F.lit(False)) & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return rows.select(*docs.columns, (F.col("_epochs") + once.cast("int")).cast("long").alias("times"))
