"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; all other training text counts as unlabelled.
The risk is corrected by the class prior p: p * E_P[l(+)] + max(0, E_U[l(-)] - p * E_P[l(-)]),
so that toxic texts among the unlabelled ones do not pull the classifier to clean.

The classifier is fitted on a bounded sample (`positives`, `unlabelled`: parameters);
the prior covers all labelled rows. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import add_columns, slices, utf8

#: ASCII punctuation and symbols end a word.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    positives: int = 4000
    unlabelled: int = 8000
    vocabulary: int = 512
    min_documents: int = 5
    min_z: float = 5.0  #: significance of the difference between positives and unlabelled
    steps: int = 500
    rate: float = 0.1
    l2: float = 1e-5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """A linear classifier on the presence of words and word beginnings."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -20.0

    def score(self, text: bytes | None) -> float:
        import math

        z = self.bias + sum(self.weights[w] for w in self.weights.keys() & features(text))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def features(text: bytes | None) -> set[bytes]:
    """Distinct words of a text, ASCII letters in lower case, and the first four and five
    bytes of each longer word, marked by a star."""
    words = set((text or b"").lower().translate(_SPLIT).split())
    return words | {w[:4] + b"*" for w in words if len(w) > 4} | {w[:5] + b"*" for w in words if len(w) > 5}


def fit_nnpu(x, positive, prior: float, settings: Settings):
    """Weights and bias of a linear classifier under the non-negative risk with the sigmoid
    loss, which is bounded: a prior that is somewhat off moves it little. `x`: rows by
    features, `positive`: which rows are confirmed, the others are unlabelled."""
    import numpy as np

    n = x.shape[1]
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    p, u = x[positive], x[~positive]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, settings.steps + 1):
        sp, su = sigmoid(p @ theta[:n] + theta[n]), sigmoid(u @ theta[:n] + theta[n])
        negative_risk = su.mean() - prior * sp.mean()
        gp = gn_p = -prior * sp * (1 - sp) / len(sp)
        gn_u = su * (1 - su) / len(su)
        if negative_risk >= 0:
            gp, gu = gp + gn_p, gn_u
        else:  # step back where the corrected risk has fallen below zero
            gp, gu = -gn_p, -gn_u
        gradient = np.append(gp @ p + gu @ u + settings.l2 * theta[:n], gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n], float(theta[n])


def _word_lists(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, 512):
            # One character for each byte: a beginning may end within a letter.
            words = [sorted(w.decode("latin-1") for w in features(t)) for t in utf8(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=("positive", "words"))


def bounded(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """A repeatable sample of about `most` rows by a hash of doc_id; all rows if fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def bounded_rows(table: DataFrame, most: int, seed: int, scratch: Scratch) -> DataFrame:
    """The stored `table` itself, or about `most` of its rows if it has over twice as many:
    a sample of ids holds more rows where ids repeat."""
    n = table.count()
    if n <= 2 * most:
        return table
    numbered = table.withColumn("_row", F.monotonically_increasing_id())
    some = F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(1 << 30)) < int(most / n * (1 << 30))
    return scratch.put(numbered.where(some).drop("_row"), "bounded")


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Fit on the rows of `docs` (`doc_id, text`) where `learn` (a condition on doc_id)
    holds. `labels` (`doc_id, toxic`): several labels of a document count as toxic if one
    does; null labels are ignored. Without positives every score is about 0."""
    import numpy as np

    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, confirmed = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not confirmed:
        return Model()
    prior = min(confirmed / total, 0.9)
    texts = docs.where(learn).select("doc_id", "text")
    toxic = bounded(known.where("toxic = 1"), settings.positives, settings.seed).select("doc_id")
    # `positives` bounds the ids: they may be broadcast, and no text is shuffled.
    positives = texts.join(F.broadcast(toxic), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
    unlabelled = bounded(texts, settings.unlabelled, settings.seed + 1).select(F.lit(False).alias("positive"), "text")
    sample = scratch.put(positives.unionByName(unlabelled).mapInArrow(_word_lists, "positive boolean, words array<string>"), "sample")
    sample = bounded_rows(sample.where("positive"), settings.positives, settings.seed, scratch).unionByName(
        bounded_rows(sample.where("NOT positive"), settings.unlabelled, settings.seed + 1, scratch)
    )
    n_p, n_u = sample.agg(F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))).first()
    if not n_p or not n_u:
        return Model()
    in_p, in_u = F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))
    counts = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(in_p.alias("p"), in_u.alias("u"))
    share = (F.col("p") + F.col("u") + 1) / float(n_p + n_u + 2)
    z = (F.col("p") / float(n_p) - F.col("u") / float(n_u)) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    clear = (F.col("p") + F.col("u") >= settings.min_documents) & (F.abs(z) >= settings.min_z)
    chosen = counts.where(clear).orderBy(F.abs(z).desc(), "word").limit(settings.vocabulary)
    vocabulary = [r.word for r in chosen.collect()]
    if not vocabulary:
        return Model(bias=float(np.log(prior / (1 - prior))))
    place = F.array(*[F.lit(w) for w in vocabulary])
    kept = sample.select("positive", F.array_intersect("words", place).alias("words"))
    kept = kept.orderBy(F.xxhash64("words"), "words", "positive").toArrow()
    index = {w: i for i, w in enumerate(vocabulary)}
    lists = kept.column("words").to_pylist()
    x = np.zeros((len(lists), len(vocabulary)), np.float32)
    for i, words in enumerate(lists):
        x[i, [index[w] for w in words]] = 1
    positive = np.array(kept.column("positive").to_pylist(), bool)
    weights, bias = fit_nnpu(x, positive, prior, settings)
    return Model({w.encode("latin-1"): float(a) for w, a in zip(vocabulary, weights, strict=True)}, bias)


def score(docs: DataFrame, model, carry: list[str] | None = None) -> DataFrame:
    """Columns of `docs` (or those in `carry`) with `score`, from 0 to 1. Null texts score
    as empty ones; repeated rows stay; a column named score is replaced; an empty table
    gives an empty table."""
    return add_columns(docs, "text", "score double", lambda column: [[model.score(t) for t in utf8(column)]], carry)
