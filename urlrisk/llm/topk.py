"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt evenly to shards of bounded size. A shard's index has, for each
dimension, postings sorted by component and cut into segments of quantised impact. A
query sorts all segments by the most they can add, and works them off from the top into
accumulators. What a vector can still gain is bounded by the next segment's impact, so
after every few segments the vectors that can reach the k best found so far are known.
A shard stops only when that proof leaves few of them; those are scored exactly.

A task has one shard and one block of queries, both of bounded size. Only k rows per
query and shard leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import dealt

OUT_SCHEMA = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Index:
    """Parameters of the index and the search."""

    shard_values: int = 1 << 20  #: vector components in a shard, which bounds its memory
    query_rows: int = 2048
    levels: int = 12  #: segments in a dimension
    step: int = 192  #: segments between two proofs
    few: float = 0.2  #: share of a shard that is scored without further pruning


def quantise(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(embedding: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Shard:
    """Impact-ordered postings of some vectors."""

    def __init__(self, ids, vectors, index: Index):
        import numpy as np

        self.ids, self.vectors, self.index = ids, vectors, index
        order = np.argsort(vectors, axis=0, kind="stable")  # by dimension: rows from low to high
        values = np.take_along_axis(vectors, order, axis=0)
        self.rows, self.values, segments = [], [], []
        for j, v in enumerate(values.T):
            if len(v):
                width = max((int(v[-1]) - int(v[0])) // index.levels + 1, 1)
                cuts = np.append(np.flatnonzero(np.diff((v - v[0]) // width, prepend=-1)), len(v))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    self.rows.append(order[a:b, j].copy())
                    self.values.append(v[a:b].copy())
                    segments.append((j, v[a], v[b - 1]))
        self.segments = np.array(segments, np.int64).reshape(-1, 3)

    def search(self, own: int, query, k: int):
        """Positions and exact scores that hold the k best (all ties at the end included)."""
        import numpy as np

        alive = np.flatnonzero(self.ids != own)
        few = max(2 * k, int(self.index.few * len(alive)))
        if len(alive) <= few:
            return alive, self.vectors[alive] @ query
        dimension, low, high = self.segments.T
        weight = query[dimension]
        impact = np.maximum(weight * low, weight * high)
        work = np.flatnonzero(weight != 0)  # the others add nothing
        work = work[np.argsort(-impact[work], kind="stable")]
        total, least, weights = np.zeros(len(self.ids), np.int64), None, weight.tolist()
        for at in range(0, len(work), self.index.step):
            for s in work[at : at + self.index.step].tolist():
                total[self.rows[s]] += weights[s] * self.values[s]
            rest = work[at + self.index.step :]
            # What is unseen adds at most its dimension's greatest impact among the segments left.
            more = np.zeros(len(query), np.int64)
            np.maximum.at(more, dimension[rest], impact[rest])
            most = total[alive]
            # Exact scores of the most promising vectors prove a lower limit.
            best = alive[np.argpartition(most, -2 * k)[-2 * k :]]
            limit = np.partition(self.vectors[best] @ query, -k)[-k]
            least = limit if least is None else max(least, limit)
            alive = alive[most + more.sum() >= least]
            if len(alive) <= few:
                break
        return alive, self.vectors[alive] @ query


def _matrix(column, width: int):
    """Lists of integers as rows, padded with zeros."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.list_value_length(column).to_numpy()
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = pc.list_flatten(column).to_numpy()
    return out


def _search(key, left, right, k: int, index: Index):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ("query_id", "vec_id", "score")
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (left, right))
    shard = Shard(left.column("vec_id").to_numpy(), _matrix(left.column("v"), width), index)
    q, v, s = [], [], []
    for own, query in zip(right.column("query_id").to_pylist(), _matrix(right.column("v"), width), strict=True):
        at, score = shard.search(own, query, k)
        ids = shard.ids[at]
        order = np.lexsort((ids, -score))[:k]
        q.append(np.full(len(order), own))
        v.append(ids[order])
        s.append(score[order])
    return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in (q, v, s)], names=names)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, index: Index = Index()) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k rows with the greatest inner product for each
    query, ties to the smaller vec_id, all rows if there are fewer.

    `vectors` has `vec_id, embedding`; `is_query` is a condition on vec_id. Rows without a
    vec_id, and vectors that are null or hold null or non-finite components, take no part.
    Shorter vectors count as padded with zeros. A query's candidates are all rows with
    another vec_id, repeated rows one by one; of several vectors under a query's vec_id the
    least is asked for. An empty table gives an empty table.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    table = scratch.put(rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding"), scale).alias("v")), "vectors")
    queries = scratch.put(table.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries")
    n, width = table.agg(F.count("*"), F.max(F.size("v"))).first()
    shards, blocks = max(1, -(-n * (width or 1) // index.shard_values)), max(1, -(-queries.count() // index.query_rows))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = table.withColumn("_s", dealt(shards).cast("int")).withColumn("_b", spread(blocks))
    right = queries.withColumn("_b", dealt(blocks).cast("int")).withColumn("_s", spread(shards))
    found = left.groupBy("_s", "_b").cogroup(right.groupBy("_s", "_b")).applyInArrow(
        lambda key, a, b: _search(key, a, b, k, index), OUT_SCHEMA
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
