"""Connected components by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Each step is an aggregate and joins on stored tables; adaptive execution can split the
joins where a node has very many links, and nothing is collected but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.scratch import Scratch


def _stars(arcs: DataFrame, keep, scratch: Scratch, name: str) -> DataFrame:
    """Every neighbour v of u gets linked to the least id around u. `arcs` (u, v)."""
    least = scratch.put(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    linked = arcs.join(least, "u")
    out = linked.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if name == "small":  # u itself hangs below the least one as well
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = scratch.put(out.where("a <> b").distinct(), name)
    scratch.drop(least)
    return out


def _checksum(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(2**31 - 1))), F.bit_xor(h)).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """`node, component` (the least node reachable) of every node on a link `a, b`;
    ids are integers, direction and repeats do not matter, self links are ignored."""
    edges = scratch.put(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    last = None
    while (now := _checksum(edges)) != last:
        last = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _stars(both, F.col("v") > F.col("u"), scratch, "large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = _stars(down, F.lit(True), scratch, "small")
        scratch.drop(edges, large)
        edges = small
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def merged(known: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """`node, component` after the links `more` (a, b) join components of `known`. Only
    the components that they touch are gone through again."""
    if more.isEmpty():
        return known
    name = known.select("node", "component")
    ends = more.join(name.toDF("a", "_a"), "a", "left").join(name.toDF("b", "_b"), "b", "left")
    ends = ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    moved = scratch.put(components(ends, scratch).toDF("component", "_now"), "moved")
    kept = known.join(moved, "component", "left").select("node", F.coalesce("_now", "component").alias("component"))
    fresh = moved.join(name.select(F.col("node").alias("component")), "component", "left_anti")
    return kept.unionByName(fresh.toDF("node", "component"))
