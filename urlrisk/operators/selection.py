"""Optional feature selection: variance, correlation, mutual information, top k.

Tables are read as they lie, never unpivoted: a task adds up what its rows say about all
features at once (a Gramian, counts of leading bits, counts per bin and class) and hands
on sums whose size depends on the features alone. Spark adds these by key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import FEATURES
from ..sources.paths import stored

# Thresholds.
VARIANCE = 0.01
CORRELATION = 0.95
MUTUAL_INFORMATION = 0.01
TOP_K = 50


def variances(df: DataFrame, features=FEATURES) -> DataFrame:
    """feature, variance (population): one pass."""
    row = df.agg(*[F.var_pop(f).alias(f) for f in features])
    return row.unpivot([], list(features), "feature", "variance")


def above_variance(df: DataFrame, features=FEATURES, threshold: float = VARIANCE) -> list[str]:
    found = {r["feature"]: r["variance"] for r in variances(df, features).collect()}
    return [f for f in features if (found[f] or 0.0) > threshold]


def _matrix(batch, count: int):
    import numpy as np

    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(count)]).astype(float)


def _products(batches: Iterator, low: list[float]) -> Iterator:
    """Sums of products of all features, less their minima, over a task's rows: a row per
    feature, whose last two entries are its sum and the number of rows."""
    import numpy as np
    import pyarrow as pa

    d = len(low)
    total = np.zeros((d, d + 2))
    for batch in batches:
        x = _matrix(batch, d) - low
        total[:, :d] += x.T @ x
        total[:, d] += x.sum(0)
        total[:, d + 1] += len(x)
    yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=("i", "s"))


def correlations(df: DataFrame, features=FEATURES) -> DataFrame:
    """feature_a, feature_b, r: Pearson's correlation of each two features (a before b in
    the given order); NULL if one is constant. Rows with a NULL feature take no part; without
    rows there are no pairs. One pass for the minima, one for the sums.

    Minima are subtracted first, so that a constant feature gives exact zeros.
    """
    names = list(features)
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in names]).dropna()
    low = list(rows.agg(*[F.min(f) for f in names]).first())
    if not names or low[0] is None:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double")
    parts = rows.mapInArrow(lambda it: _products(it, low), "i int, s array<double>")
    sums = parts.select("i", F.posexplode("s").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    d = len(names)
    sums = stored(sums, "products")  # features x features numbers
    own = sums.where("i = j").select("i", F.col("s").alias("square"))
    own = own.join(sums.where(F.col("j") == d).select("i", F.col("s").alias("sum")), "i")
    own = own.join(sums.where(F.col("j") == d + 1).select("i", F.col("s").alias("n")), "i")
    own = own.select("i", "sum", "n", (F.col("square") - F.col("sum") * F.col("sum") / F.col("n")).alias("spread"))
    other = own.select(F.col("i").alias("j"), F.col("sum").alias("sum_b"), F.col("spread").alias("spread_b"))
    pair = sums.where(F.col("i") < F.col("j")).join(own, "i").join(other, "j")
    both = F.sqrt(F.col("spread")) * F.sqrt(F.col("spread_b"))
    r = F.when(both > 0, (F.col("s") - F.col("sum") * F.col("sum_b") / F.col("n")) / both)
    name = F.array(*[F.lit(f) for f in names])
    return pair.select(F.get(name, F.col("i")).alias("feature_a"), F.get(name, F.col("j")).alias("feature_b"), r.alias("r"))


def uncorrelated(df: DataFrame, features=FEATURES, threshold: float = CORRELATION) -> list[str]:
    """Features whose absolute correlation with every earlier kept one is at most
    the threshold. Constant features correlate with nothing."""
    close = {(r["feature_a"], r["feature_b"]) for r in correlations(df, features).where(F.abs("r") > threshold).collect()}
    kept: list[str] = []
    for f in features:
        if not any((k, f) in close for k in kept):
            kept.append(f)
    return kept


PENDING = 1 << 16  # counts of a feature that a task keeps unmerged
DIGIT = 13  # leading bits settled by one pass of `exact_cuts`; five passes settle a double


def _sortable(x):
    """Doubles as signed integers in the same order."""
    import numpy as np

    bits = (x + 0.0).view(np.int64)  # one zero
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _leading(batches: Iterator, parents: list, shift: int, above: int) -> Iterator:
    """Rows per (feature, bits above `shift`), of values whose bits above `above` are in
    `parents` of that feature (None: of all values)."""
    import numpy as np
    import pyarrow as pa

    keys, counts, held = [[] for _ in parents], [[] for _ in parents], [0] * len(parents)

    def merge(f):
        every, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys[f]]), return_inverse=True)
        counts[f] = [np.bincount(at, np.concatenate([np.zeros(0), *counts[f]]), len(every)).astype(np.int64)]
        keys[f], held[f] = [every], len(every)

    for batch in batches:
        x = _matrix(batch, len(parents))
        for f, parent in enumerate(parents):
            if parent is not None and not len(parent):
                continue
            v = _sortable(np.ascontiguousarray(x[:, f][~np.isnan(x[:, f])]))
            if parent is not None:
                v = v[np.isin(v >> above, parent)]
            found = pa.array(v >> shift).value_counts()  # by hash: a batch is not sorted
            keys[f].append(found.field(0).to_numpy())
            counts[f].append(found.field(1).to_numpy())
            held[f] += len(found)
            if held[f] > PENDING and len(keys[f]) > 8:
                merge(f)
    for f in range(len(parents)):
        merge(f)
        yield pa.record_batch([pa.array(np.full(held[f], f, np.int32)), pa.array(keys[f][0]), pa.array(counts[f][0])], names=("f", "key", "n"))


def exact_cuts(table: DataFrame, features, bins: int) -> list[list[float]]:
    """For each feature the values at ranks ceil(k * n / bins), k from 1 to bins - 1, of its
    n values in ascending order (NULL and NaN left out; no value, no cuts).

    A radix selection for all columns at once: a pass over the stored `table` counts the
    values by their next leading bits, where a cut may still lie, and so names the bits of
    every cut. A task holds at most bins * 2^13 counts of a feature, the driver the cuts.
    """
    import numpy as np

    spark, d = table.sparkSession, len(features)
    rows = table.select(*features)
    parents: list = [None] * d
    wanted, above = None, 64
    while above > 0:
        shift = max(0, above - DIGIT)
        found = rows.mapInArrow(lambda it, p=parents, s=shift, a=above: _leading(it, p, s, a), "f int, key long, n long")
        counts = stored(found.groupBy("f", "key").agg(F.sum("n").alias("n")), "leading")
        if wanted is None:
            sizes = counts.groupBy("f").agg(F.sum("n").alias("n")).collect()
            wanted = [(r["f"], 0, k, -(-k * r["n"] // bins)) for r in sizes for k in range(1, bins)]
            parent = F.lit(0).cast("long")
        else:
            parent = F.shiftright("key", above - shift)
        asked = spark.createDataFrame(wanted, "f int, parent long, k int, rank long")
        before = Window.partitionBy("f", "parent").orderBy("key")  # at most 2^13 rows
        runs = counts.withColumn("parent", parent).withColumn("up_to", F.sum("n").over(before))
        hit = runs.join(asked, ["f", "parent"]).where("rank <= up_to AND rank > up_to - n")
        wanted = [(r["f"], r["key"], r["k"], r["rank"]) for r in hit.select("f", "key", "k", (F.col("rank") - F.col("up_to") + F.col("n")).alias("rank")).collect()]
        parents = [np.array(sorted({w[1] for w in wanted if w[0] == f}), np.int64) for f in range(d)]
        above = shift
    keys = [sorted(w[1] for w in wanted if w[0] == f) for f in range(d)]
    restore = lambda k: (k ^ ((k >> 63) & np.int64(2**63 - 1))).view(np.float64)
    return [restore(np.array(k, np.int64)).tolist() for k in keys]


def _binned_counts(batches: Iterator, cuts: list, bins: int) -> Iterator:
    """Rows per (feature, bin, label); the bin of a NULL or NaN is `bins`."""
    import numpy as np
    import pyarrow as pa

    d, sums = len(cuts), {}
    for batch in batches:
        x = _matrix(batch, d)
        at = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        at = np.where(np.isnan(x), bins, at) + np.arange(d) * (bins + 1)
        labels = np.array(batch.column(d).to_pylist(), object)
        for label in set(labels.tolist()):
            sums[label] = sums.get(label, 0) + np.bincount(at[labels == label].ravel(), minlength=d * (bins + 1))
    for label, n in sums.items():
        cell = np.flatnonzero(n)
        yield pa.record_batch(
            [pa.array((cell // (bins + 1)).astype(np.int32)), pa.array((cell % (bins + 1)).astype(np.int32)),
             pa.array([label] * len(cell), pa.string()), pa.array(n[cell].astype(np.int64))], names=("f", "bin", "label", "n"))


def mutual_information(df: DataFrame, features=FEATURES, label="label", bins: int = 10) -> DataFrame:
    """feature, mi: mutual information in nats of the binned feature with the label.

    Bins are bounded by exact quantiles: a value's bin is the number of cuts
    (`exact_cuts`) below it. Rows without a label take no part; an empty table gives an
    empty table. The narrow table is stored, since it is passed over six times.
    """
    names = list(features)
    columns = [F.col(f).cast("double").alias(f) for f in names]
    table = stored(df.where(F.col(label).isNotNull()).select(*columns, F.col(label).cast("string").alias("_label")), "selection")
    cuts = exact_cuts(table, names, bins)
    cells = table.mapInArrow(lambda it: _binned_counts(it, cuts, bins), "f int, bin int, label string, n long")
    name = F.array(*[F.lit(f) for f in names])
    return information(cells.groupBy(F.get(name, F.col("f")).alias("feature"), "bin", "label").agg(F.sum("n").alias("n")))


def flag_information(df: DataFrame, flags, label="label") -> DataFrame:
    """feature, mi of columns with few values each. Equal rows become one with a count
    before they are unpivoted: what is unpivoted and shuffled grows with the combinations."""
    rows = df.groupBy(label, *flags).agg(F.count("*").alias("n"))
    long = rows.unpivot([label, "n"], list(flags), "feature", "bin")
    return information(long.groupBy("feature", "bin", F.col(label).alias("label")).agg(F.sum("n").alias("n")))


def information(cells: DataFrame) -> DataFrame:
    """feature, mi from counts n per (feature, bin, label); cells without a bin or label
    count in the totals alone. Windows, not joins: the counts are made once."""
    over = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    sums = cells.select("*", over("feature").alias("t"), over("feature", "bin").alias("nb"), over("feature", "label").alias("nl"))
    sums = sums.dropna(subset=["feature", "bin", "label"])
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("nl")))
    return sums.groupBy("feature").agg(F.sum(term).alias("mi"))


def informative(df: DataFrame, features=FEATURES, threshold: float = MUTUAL_INFORMATION, k: int = TOP_K) -> list[str]:
    """The k features with most information about the label, above the threshold."""
    top = mutual_information(df, features).where(F.col("mi") > threshold)
    return [r["feature"] for r in top.orderBy(F.desc("mi"), "feature").limit(k).collect()]
