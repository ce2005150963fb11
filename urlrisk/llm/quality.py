"""Document quality by Bradley-Terry pairwise ranking.

Each preference pair holds a good and a bad document. The chance that the good one wins
is the logistic function of the difference of their scores, which are linear in surface
features; so the fit is a logistic loss on feature differences. The share of bad
documents among all labelled rows then gives the quantile of the scores below which a
document counts as bad.

Every labelled row takes part: moments, pairs, fit and quantile are Spark aggregates over
all of them. Rows are dealt into groups by a hash, and within a group each row is paired
with one of the other class, the rows of the smaller class in turn. A Newton step is one
pass over the pairs. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import slices, utf8

_SYMBOLS = b"#*$%&|<>@^~{}[]_=+\\/"
_ENDS = (b".", b"!", b"?", b":", b'"')


@dataclass(frozen=True)
class Settings:
    group: int = 4096  #: labelled rows in a group, about
    steps: int = 25  #: Newton steps at most
    l2: float = 1e-3
    threshold: float = 0.3  #: the output score at the quantile
    seed: int = 23


@dataclass(frozen=True)
class Model:
    """score = logistic((w . f(x) - cut) / scale + logit(threshold))."""

    mean: tuple = ()
    deviation: tuple = ()
    weights: tuple = ()
    cut: float = 0.0
    scale: float = 1.0
    threshold: float = 0.3
    constant: float | None = 0.5

    def score(self, text: bytes | None) -> float:
        import math

        if self.constant is not None:
            return self.constant
        z = (float(_expand([features(text)], self.mean, self.deviation)[0] @ self.weights) - self.cut) / self.scale
        z += math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def features(text: bytes | None) -> list[float]:
    """Surface features of a whole text; zeros for a null or empty one."""
    import math

    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 15
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    distinct = len(set(words))
    pairs = set(zip(words, words[1:], strict=False))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    without_symbols = len(text.translate(None, _SYMBOLS))
    digits = size - len(text.translate(None, b"0123456789"))
    capitals = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = size - len(text.translate(None, b".,;:!?"))
    return [
        math.log(n), size / n, 1 - without_symbols / size, digits / size, capitals / size, marks / n,
        distinct / n, len(pairs) / max(n - 1, 1), same / n, sum(w in (b"|", b"-", b">") for w in words) / n,
        len(set(lines)) / len(lines), sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines),
        math.log(n / len(lines)), sum(len(w) <= 3 for w in words) / n,
        sum(w[-1:] in _ENDS or w[-1:] == b"," for w in words) / n,
    ]


def _expand(rows, mean, deviation):
    """Standard scores, clipped, with their squares."""
    import numpy as np

    z = np.clip((np.asarray(rows, float) - mean) / deviation, -6, 6)
    return np.hstack([z, z * z])


def _deal(made: DataFrame, n_good: int, n_bad: int, settings: Settings) -> DataFrame:
    """`made` with a group number. Rows of the smaller class go to several groups where it
    has less than 64 rows for each, so that no group is without them."""
    groups = max(1, (n_good + n_bad) // settings.group)
    copies = max(1, -(-64 * groups // min(n_good, n_bad))) if groups > 1 else 1
    smaller = F.col("quality") == int(n_good < n_bad)
    rows = made.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(smaller, copies - 1).otherwise(0))))
    return rows.withColumn("group", F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id", "f", "_copy"), F.lit(groups)))


def _pairs(mean, deviation):
    def run(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("doc_id", kind="stable")
        z = _expand(np.stack(frame["f"].to_numpy()), mean, deviation)
        good, bad = (z[(frame["quality"] == q).to_numpy()] for q in (1, 0))
        n = max(len(good), len(bad)) if len(good) and len(bad) else 0
        at = np.arange(n)
        d = good[at % len(good)] - bad[at % len(bad)] if n else np.zeros((0, z.shape[1]))
        return pd.DataFrame({"d": list(d)})

    return run


def _sums(w):
    """Loss, gradient and curvature of the logistic loss over a task's pairs, packed."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n = len(w)
        total = np.zeros(2 + n + n * n)
        for batch in batches:
            d = batch.column(0).flatten().to_numpy().reshape(-1, n)
            margin = d @ w
            lose = 1 / (1 + np.exp(np.clip(margin, -50, 50)))
            total[0] += len(d)
            total[1] += np.logaddexp(0, -margin).sum()
            total[2 : 2 + n] -= lose @ d
            total[2 + n :] += ((d * (lose * (1 - lose))[:, None]).T @ d).ravel()
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=("s",))

    return run


def fit_pairs(pairs: DataFrame, size: int, settings: Settings):
    """Weights that minimise the mean logistic loss on differences of feature rows (`d`),
    with a penalty, by Newton steps that are halved where the loss would rise."""
    import numpy as np

    best, at, trial, step = np.inf, np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(settings.steps):
        parts = pairs.mapInArrow(_sums(trial), "s array<double>").select(F.posexplode("s").alias("i", "s"))
        s = np.array([r.s for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()])  # a few numbers a feature
        loss = s[1] / s[0] + settings.l2 / 2 * (trial @ trial)
        if loss > best:
            step = step / 2
        else:
            done = best - loss < 1e-9
            best, at = loss, trial
            if done:
                break
            gradient = s[2 : 2 + size] / s[0] + settings.l2 * at
            step = -np.linalg.solve(s[2 + size :].reshape(size, size) / s[0] + settings.l2 * np.eye(size), gradient)
        if np.abs(step).max() < 1e-9:
            break
        trial = at + step
    return at


def _scored(mean, deviation, w):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            scores = _expand(x, mean, deviation) @ w if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=("quality", "score"))

    return run


def value_at(scores: DataFrame, rank: int) -> float:
    """The value of column `score` at an ascending `rank` (from 1): counts in 1,024 equal
    bins, again within the bin that holds it, until that has one value."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        width = (high - low) / 1024
        place = F.least(F.floor((F.col("score") - low) / width), F.lit(1023)).alias("bin") if width else F.lit(0).alias("bin")
        inside = scores.where(F.col("score").between(low, high)).groupBy(place)
        for r in sorted(inside.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()):  # at most 1,024
            if rank <= r.n:
                if width == 0 or (r.low, r.high) == (low, high):
                    return float(r.low)
                low, high = r.low, r.high
                break
            rank -= r.n
    return float(low)


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, 512):
            rows = [features(t) for t in utf8(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=("doc_id", "f"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Fit on labelled rows where `learn` (a condition on doc_id) holds. `labels` (`doc_id,
    quality`): the least of a document's labels counts, null labels are ignored. Without
    both good and bad documents every score is the good share."""
    import numpy as np

    known = labels.where(learn & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    scratch = Scratch(docs.sparkSession, "quality")
    # Features first: what is joined and shuffled is narrow, and no text is.
    narrow = docs.where(learn).select("doc_id", "text").mapInArrow(_features, "doc_id long, f array<double>")
    made = scratch.put(narrow.join(known, "doc_id").select("doc_id", "quality", "f"), "labelled")
    size = 15
    moments = [F.avg(F.col("f")[i]).alias(f"m{i}") for i in range(size)] + [F.avg(F.col("f")[i] * F.col("f")[i]).alias(f"s{i}") for i in range(size)]
    by = {r.quality: r for r in made.groupBy("quality").agg(F.count("*").alias("n"), *moments).collect()}
    if len(by) < 2:
        return Model(constant=float(next(iter(by))) if by else 0.5)
    # Both classes weigh the same in scaling, whatever their shares. Sums may be added in
    # any order: their last digits are cut.
    first, second = (sum(np.array([r[f"{c}{i}"] for i in range(size)]) for r in by.values()) / 2 for c in "ms")
    mean, deviation = np.round(first, 9), np.round(np.sqrt(np.maximum(second - first * first, 0)), 9) + 1e-9
    n_good, n_bad = by[1].n, by[0].n
    dealt = _deal(made, n_good, n_bad, settings).select("group", "doc_id", "quality", "f")
    pairs = scratch.put(dealt.groupBy("group").applyInPandas(_pairs(mean, deviation), "d array<double>"), "pairs")
    w = np.round(fit_pairs(pairs, 2 * size, settings), 7)
    scores = scratch.put(made.select("quality", "f").mapInArrow(_scored(mean, deviation, w), "quality int, score double"), "scores")
    # The share of bad rows is the quantile below which a document counts as bad.
    rank = min(n_bad, n_good + n_bad - 1)
    cut = (value_at(scores, rank) + value_at(scores, rank + 1)) / 2
    spread = scores.groupBy("quality").agg(F.avg("score"), F.avg(F.col("score") * F.col("score"))).collect()
    middle, square = sum(r[1] for r in spread) / 2, sum(r[2] for r in spread) / 2
    scale = float(np.round(np.sqrt(max(square - middle * middle, 0.0)) / 2, 9)) + 1e-9
    return Model(tuple(mean), tuple(deviation), tuple(w), cut, scale, settings.threshold, None)
