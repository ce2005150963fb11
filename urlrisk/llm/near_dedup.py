"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. One pass over whole texts yields a document's shingle set as its size, a 128-bit
   fingerprint, a signature (for each tree a path of minimum hashes) and a brief (the
   least hash of each of 512 ranges, one byte each). Documents with equal sets are one
   class from here on; its smallest id stands for it.
2. Each tree sorts the classes by path. Classes that share the first `min_depth` values
   form a region. Pairs of a region are candidates; those whose set sizes or briefs lie too
   far apart to reach the threshold are left out in place.
3. First come neighbours with long common prefixes: a region of more than `crowd` classes
   is opened one level deeper, and so on, and walked in sorted order. What a few trees find
   is confirmed on the full shingle sets, made anew from the texts, and joined into
   components; the other trees then look only where components meet. A region hands on a
   spanning forest of its most similar pairs.
4. Then all pairs between components of a region are candidates. A pair is handed on by the
   first tree in which it meets. A region with more than `most_pairs` of them is left to
   the next forest: longer paths (`next_depths`), and as many more sorted orders as keep
   the chance to miss a pair at the threshold where it was. The last forest tries whole
   regions, crowded ones in blocks that each two meet.
5. Connected components of the confirmed links; the smallest id of each stays.

With 16 trees and depth 3, a pair at similarity 0.8 is missed with probability
(1 - 0.8^3)^16, about 1e-5, and less above; with 29 trees of depth 5 and 63 of depth 8 as
well. A pair that only meets in crowded regions goes through all three, so it is missed
with at most the sum. A brief samples the union of two sets without
replacement, so small sets are compared almost exactly and large ones with a standard
deviation of 0.018; pairs are left out from 4 deviations below the threshold on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.components import components, merged
from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import doubtful, slices, utf8

#: Words whose hash a worker keeps; beyond, the cache starts anew (hashes do not depend on it).
CACHE_WORDS = 300_000

SKETCH_SCHEMA = "doc_id long, n_shingles long, fingerprint binary, signature binary, brief binary"

_cache: dict[bytes, int] = {}


@dataclass(frozen=True)
class Forest:
    """Parameters. `words` per shingle; links need 100 * intersection >= percent * union.
    `bins`: ranges of a brief. `deviations`: a pair is confirmed unless its estimate lies
    further below the threshold than this many standard deviations."""

    words: int = 5
    percent: int = 80
    trees: int = 16
    min_depth: int = 3
    max_depth: int = 8
    crowd: int = 1024
    most_pairs: int = 4_000_000  #: of one region that are tried before a deeper forest
    next_depths: tuple[int, ...] = (5, 8)
    bins: int = 512
    deviations: float = 4.0
    seed: int = 7

    def deeper(self) -> Forest | None:
        """The forest for what this one leaves: each row shares a longer path with fewer
        others, in so many trees that a pair at the threshold is missed as rarely."""
        import math

        if not self.next_depths:
            return None
        depth = self.next_depths[0]
        miss = lambda d: math.log1p(-((self.percent / 100) ** d))
        trees = math.ceil(self.trees * miss(self.min_depth) / miss(depth) - 1e-9)
        return replace(self, trees=trees, min_depth=depth, max_depth=max(depth, self.max_depth), next_depths=self.next_depths[1:], seed=self.seed + 1)


def shingles(text: bytes | None, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lower-cased; of
    the whole word sequence if it has fewer words; empty without words."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    try:
        h = np.array([_cache[w] for w in words], np.uint64)
    except KeyError:
        if len(_cache) > CACHE_WORDS:
            _cache.clear()
        for w in words:
            if w not in _cache:
                _cache[w] = xxhash.xxh64_intdigest(w)
        h = np.array([_cache[w] for w in words], np.uint64)
    n = len(words) - k + 1
    out = np.full(n, 0x243F6A8885A308D3, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _multipliers(forest: Forest):
    import numpy as np

    rng = np.random.default_rng(forest.seed)
    n = forest.trees * forest.max_depth
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(values, forest: Forest, factors) -> bytes:
    """Minimum hashes of a non-empty shingle set: big-endian 32-bit values, tree by tree."""
    import numpy as np

    a, b = factors
    low = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(values), 2048):  # bounds the memory of a very long text
        h = values[at : at + 2048, None] * a + b
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        np.minimum(low, h.min(0), out=low)
    return (low >> np.uint64(32)).astype(">u4").tobytes()


def brief(values, forest: Forest) -> bytes:
    """One byte for each of `bins` equal ranges of hashes: the low byte (1 to 255) of the
    least hash of a sorted set in that range, 0 where the range is empty."""
    import numpy as np

    at, first = np.unique((values >> np.uint64(32)) * np.uint64(forest.bins) >> np.uint64(32), return_index=True)
    out = np.zeros(forest.bins, np.uint8)
    out[at.astype(np.int64)] = (values[first] % np.uint64(256)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _sketch(batches: Iterator, forest: Forest) -> Iterator:
    import pyarrow as pa
    import xxhash

    factors = _multipliers(forest)
    names = ("doc_id", "n_shingles", "fingerprint", "signature", "brief")
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    for whole in batches:
        for batch in slices(whole, 512):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                s = shingles(text, forest.words)
                if len(s):
                    rows.append((doc, len(s), xxhash.xxh128_digest(s.tobytes()), signature(s, forest, factors), brief(s, forest)))
                else:
                    rows.append((doc, 0, None, None, None))
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _paths(classes: DataFrame, forest: Forest) -> DataFrame:
    """A row for each class and tree: `id, tree, path`."""
    width = 4 * forest.max_depth
    tree = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1)))
    rows = classes.select("id", "signature", tree.alias("tree"))
    return rows.select("id", "tree", F.substring("signature", F.col("tree") * width + 1, F.lit(width)).alias("path"))


def _shared(paths: DataFrame, forest: Forest, scratch: Scratch) -> DataFrame:
    """Rows of `paths` that share their first `min_depth` values with others:
    `id, tree, path, region, rows` (the rows of that region)."""
    keyed = paths.withColumn("region", F.xxhash64("tree", F.substring("path", 1, 4 * forest.min_depth)))
    counts = scratch.put(keyed.groupBy("region").agg(F.count("*").alias("rows")).where("rows > 1"), "counts")
    return scratch.put(keyed.join(counts, "region"), "shared")


def _regions(shared: DataFrame, forest: Forest, scratch: Scratch) -> DataFrame:
    """`id, tree, path, depth`: rows in regions that are opened deeper while crowded. Rows
    that are alone at a deeper level are left out here and met in `_meetings`."""
    depth, crowded = forest.min_depth, F.col("rows") > forest.crowd
    out = shared.where(~crowded).select("id", "tree", "path", F.lit(depth).alias("depth"))
    current = shared.where(crowded).select("id", "tree", "path")
    while depth < forest.max_depth and not current.isEmpty():
        depth += 1
        keyed = current.withColumn("_k", F.xxhash64("tree", F.substring("path", 1, 4 * depth)))
        counts = scratch.put(keyed.groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1"), "counts")
        settled = counts if depth == forest.max_depth else counts.where(F.col("_n") <= forest.crowd)
        out = out.unionByName(keyed.join(settled, "_k").select("id", "tree", "path", F.lit(depth).alias("depth")))
        current = scratch.put(keyed.join(counts.where(F.col("_n") > forest.crowd), "_k").drop("_k", "_n"), "crowded")
    return out


def _labelled(rows: DataFrame, linked: DataFrame, region: str = "region") -> DataFrame:
    """`rows` (with id) in regions that hold more than one component, with `group`: a
    class's component, or itself."""
    rows = rows.join(linked.select(F.col("node").alias("id"), "component"), "id", "left")
    rows = rows.withColumn("group", F.coalesce("component", "id")).drop("component")
    mixed = rows.groupBy(region).agg(F.min("group").alias("_a"), F.max("group").alias("_b")).where("_a <> _b").select(region)
    return rows.join(mixed, region, "left_semi")


def _meetings(shared: DataFrame, linked: DataFrame, forest: Forest, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Parts in which all rows of a region (by `min_depth` values) that are in different
    components (`group`) meet: `part, side, tree, id, group`, first of crowded regions, then
    of the others; and the ids of rows in regions that are left to a deeper forest.

    A region of up to `crowd` rows is one part. A larger one is cut into blocks of about
    `crowd` rows, and each two blocks are a part (sides 1 and 2), each block with itself
    another (side 0). A component of more than `crowd` rows has blocks of its own, which
    need not meet each other. Regions within one component are left out.
    """
    crowded = F.col("rows") > forest.crowd
    rows = scratch.put(_labelled(shared.select("region", "rows", "tree", "id"), linked), "labelled")
    small = rows.where(~crowded).select(F.col("region").alias("part"), F.lit(0).alias("side"), "tree", "id", "group")
    rows = rows.where(crowded).drop("rows")
    if rows.isEmpty():
        return small.limit(0), small, None
    slices = F.ceil(F.col("own") / forest.crowd).alias("slices")
    groups = scratch.put(rows.groupBy("region", "group").agg(F.count("*").alias("own")), "groups")
    left = None
    if forest.next_depths:
        own = F.col("own").cast("double")
        work = groups.groupBy("region").agg(((F.sum(own) * F.sum(own) - F.sum(own * own)) / 2).alias("pairs"))
        heavy = scratch.put(work.where(F.col("pairs") > forest.most_pairs).select("region"), "heavy")
        left = scratch.put(rows.join(heavy, "region", "left_semi").select("id").distinct(), "left")
        rows, groups = rows.join(heavy, "region", "left_anti"), groups.join(heavy, "region", "left_anti")
    large = scratch.put(groups.where(F.col("own") > forest.crowd).select("region", "group", slices), "large")
    rest = groups.where(F.col("own") <= forest.crowd).groupBy("region").agg(F.sum("own").alias("own"))
    rest = scratch.put(rest.select("region", slices), "rest")
    every = large.select("region", F.col("group").alias("owner"), "slices").unionByName(
        rest.select("region", F.lit(None).cast("long").alias("owner"), "slices")
    )
    block = F.xxhash64("region", F.col("owner").isNull(), F.coalesce("owner", F.lit(0)), "slice").alias("block")
    blocks = every.select("region", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    blocks = scratch.put(blocks.select("region", "owner", block), "blocks")
    two = blocks.toDF("region", "owner_x", "x").join(blocks.toDF("region", "owner_y", "y"), "region")
    two = two.where("x <= y and (owner_x is null or owner_y is null or owner_x <> owner_y)")
    part = F.xxhash64("x", "y").alias("part")
    meets = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("x").alias("block"), F.lit(1).alias("side")), F.struct(F.col("y").alias("block"), F.lit(2).alias("side")))
    )
    two = two.select(part, F.explode(meets).alias("m")).select("part", "m.block", "m.side")
    own = rows.join(large.withColumnRenamed("slices", "_own"), ["region", "group"], "left")
    own = own.join(rest.withColumnRenamed("slices", "_rest"), "region", "left")
    own = own.withColumn("owner", F.when(F.col("_own").isNotNull(), F.col("group")))
    own = own.withColumn("slice", F.pmod(F.xxhash64("id"), F.coalesce("_own", "_rest")))
    return own.select("tree", "id", "group", block).join(two, "block").select("part", "side", "tree", "id", "group"), small, left


def _near(x, y, total, forest: Forest):
    """Estimated similarity (in 1/10000) of rows of briefs, and whether it leaves the
    threshold possible. `total`: sum of the two set sizes.

    The m ranges that are not empty in both hold a sample of m from the union's f members,
    without replacement: variance p (1 - p) (f - m) / (m (f - 1)).
    """
    import numpy as np

    p = forest.percent / 100
    same = ((x == y) & (x != 0)).sum(1)
    seen = ((x | y) != 0).sum(1)
    m = np.maximum(seen, 1)
    f = np.maximum(total / (1 + p), m)  # of a pair at the threshold
    deviation = np.sqrt(p * (1 - p) * (f - m) / (m * np.maximum(f - 1, 1)))
    near = same / m >= p - forest.deviations * deviation - 1e-9
    return same * 10_000 // m, near | (seen == 0)  # without a sample nothing is ruled out


def _alike(region, values, sizes, group, side, forest: Forest, reach: int):
    """Places (i, j) and estimated similarity of rows in one region that may be similar
    enough; rows with one `group` are left out, and of two blocks those on one `side`. A
    row meets those that follow it as far as its region goes, up to the distance `reach`."""
    import numpy as np

    left, right, agree = [], [], []
    at = np.arange(len(region))
    for lag in range(1, min(reach, len(region))):
        at = at[at < len(region) - lag]
        at = at[region[at] == region[at + lag]]
        if not len(at):
            break
        apart = at[(group[at] != group[at + lag]) & ((side[at] + side[at + lag]) % 3 == 0)]
        one, two = sizes[apart], sizes[apart + lag]
        apart = apart[100 * np.minimum(one, two) >= forest.percent * np.maximum(one, two)]
        for part in np.array_split(apart, len(apart) // 20_000 + 1):
            for width in (forest.bins // 4, forest.bins):  # most pairs fall to a quarter of the ranges
                similar, near = _near(values[part, :width], values[part + lag, :width], sizes[part] + sizes[part + lag], forest)
                part, similar = part[near], similar[near]
            left.append(part)
            right.append(part + lag)
            agree.append(similar)
    if not left:
        return np.zeros((3, 0), np.int64)
    return np.stack([np.concatenate(left), np.concatenate(right), np.concatenate(agree)])


def _spanning(n: int, edges):
    """A maximum spanning forest (Boruvka) of edges (i, j, weight) among n nodes: which
    edges it takes. The edges' places break ties."""
    import numpy as np

    order = np.argsort(edges[2], kind="stable")
    a, b, place = edges[0][order], edges[1][order], order
    label, taken = np.arange(n), []
    while True:
        live = label[a] != label[b]
        a, b, place = a[live], b[live], place[live]
        if not len(a):
            return np.concatenate(taken) if taken else np.zeros(0, np.int64)
        best = np.full(n, -1)
        index = np.arange(len(a))
        np.maximum.at(best, label[a], index)
        np.maximum.at(best, label[b], index)
        chosen = np.unique(best[best >= 0])
        taken.append(place[chosen])
        x, y = label[a[chosen]], label[b[chosen]]
        root = np.arange(n)
        while True:  # the least label of each tree of chosen edges
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
            if (root[x] == root[y]).all():
                break
        label = root[label]


def _pairs(batches: Iterator, forest: Forest, whole_regions: bool, spanning: bool) -> Iterator:
    """Candidate pairs from rows (region, id, brief, group, n_shingles, side, tree, keys)
    sorted by region: those of a maximum spanning forest of the groups, or all between
    different groups that do not meet in an earlier tree (`keys`: one number per tree, equal
    where two rows meet).

    Without `whole_regions`, rows are sorted by path as well; a region that is crowded at
    full depth is then walked in windows, which only finds links early.
    """
    import numpy as np
    import pyarrow as pa

    kept = None  # rows of the last region, which may go on in the next batch

    def of(region, ids, values, group, sizes, side, tree, keys):
        edges = _alike(region, values, sizes, group, side, forest, len(ids) if whole_regions else forest.crowd)
        if spanning:
            nodes = np.unique(group, return_inverse=True)[1]
            edges = edges[:, _spanning(len(ids), (nodes[edges[0]], nodes[edges[1]], edges[2]))]
        elif edges.shape[1]:
            first = (keys[edges[0]] == keys[edges[1]]).argmax(1)
            edges = edges[:, first == tree[edges[0]]]
        if edges.shape[1]:
            a, b = ids[edges[0]], ids[edges[1]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=("a", "b"))

    for whole in batches:
        for batch in slices(whole, 20_000):
            region, ids, group, sizes, side, tree = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5, 6))
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
            keys = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            rows = (region, ids, values, group, sizes, side, tree, keys)
            if kept is not None:
                rows = tuple(np.concatenate(x) for x in zip(kept, rows, strict=True))
            start = int(np.argmax(rows[0] == rows[0][-1]))  # the open region waits
            if start:
                yield from of(*(x[:start] for x in rows))
                rows = tuple(x[start:] for x in rows)
            elif not whole_regions and len(rows[0]) > 4 * forest.crowd:  # windows that overlap by `crowd`
                yield from of(*rows)
                rows = tuple(x[-forest.crowd :] for x in rows)
            kept = rows
    if kept is not None:
        yield from of(*kept)


def _confirm(batches: Iterator, forest: Forest) -> Iterator:
    import numpy as np
    import pyarrow as pa

    last, two = None, None
    for whole in batches:
        for batch in slices(whole, 256):
            left, right = [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True)
            for a, b, text_a, text_b in rows:
                if text_b != last:  # rows come in order of b
                    last, two = text_b, shingles(text_b, forest.words)
                one = shingles(text_a, forest.words)
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= forest.percent * (len(one) + len(two) - common):
                    left.append(a)
                    right.append(b)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=("a", "b"))


def _confirmed(docs: DataFrame, pairs: DataFrame, forest: Forest, scratch: Scratch) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = doubtful(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, "id", scratch)
    texts = texts.where("_doubtful").drop("_doubtful").join(ids, "id", "left_semi")
    texts = scratch.put(texts, "texts")  # of candidates only, as are those that move
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirm(it, forest), "a long, b long")
    found = scratch.put(found.distinct(), "confirmed")
    scratch.drop(texts)
    return found


def grouped(docs: DataFrame, classes: DataFrame, more: DataFrame, forest: Forest, scratch: Scratch) -> DataFrame:
    """`node, component` of classes linked with others; `more` are links known already.

    A large group of near copies costs about one pair for each copy: the first trees join
    nearly all of it, and later ones look only between components.
    """
    shared = _shared(_paths(classes, forest), forest, scratch)
    briefs = classes.select("id", "n_shingles", "brief")
    columns = ["region", "id", "brief", "group", "n_shingles", "side", "tree", "keys"]
    width = 4 * forest.max_depth
    meets = F.transform(
        F.sequence(F.lit(0), F.lit(forest.trees - 1)),
        lambda t: F.shiftrightunsigned(F.xxhash64(t, F.substring("signature", t * width + 1, F.lit(4 * forest.min_depth))), 33).cast("int"),
    )
    keys = classes.select("id", meets.alias("keys"))
    none = F.array().cast("array<int>").alias("keys")

    def candidates(rows: DataFrame, order: list[str], whole_regions: bool, spanning: bool) -> DataFrame:
        rows = rows.join(briefs, "id")
        rows = rows.withColumn("keys", none) if spanning else rows.join(keys, "id")
        rows = rows.repartition("region").sortWithinPartitions("region", *order).select(*columns)
        return rows.mapInArrow(lambda it: _pairs(it, forest, whole_regions, spanning), "a long, b long").distinct()

    linked = scratch.put(components(more, scratch), "linked")
    tried = more.limit(0)
    region = F.xxhash64("tree", "depth", F.expr("substring(path, 1, 4 * depth)")).alias("region")
    deep = _regions(shared, forest, scratch).select(region, "path", "tree", "id", F.lit(0).alias("side"))
    early = F.col("tree") < max(1, forest.trees // 8)
    for trees in (early, ~early):
        near = scratch.put(candidates(_labelled(deep.where(trees), linked), ["path", "id"], False, True).join(tried, ["a", "b"], "left_anti"), "near")
        linked = scratch.put(merged(linked, _confirmed(docs, near, forest, scratch), scratch), "linked")
        tried = tried.unionByName(near)
    crowded, small, left = _meetings(shared, linked, forest, scratch)
    joining = scratch.put(
        candidates(crowded.withColumnRenamed("part", "region"), ["id"], True, True).join(tried, ["a", "b"], "left_anti"), "joining"
    )
    if not joining.isEmpty():
        linked = scratch.put(merged(linked, _confirmed(docs, joining, forest, scratch), scratch), "linked")
        tried = tried.unionByName(joining)
        crowded, small, left = _meetings(shared, linked, forest, scratch)
    rest = crowded.unionByName(small).withColumnRenamed("part", "region")
    second = scratch.put(candidates(rest, ["id"], True, False).join(tried, ["a", "b"], "left_anti"), "second")
    linked = scratch.put(merged(linked, _confirmed(docs, second, forest, scratch), scratch), "linked")
    scratch.drop(shared, second)
    if left is None or left.isEmpty():
        return linked
    # What crowded regions leave goes through a deeper forest, signed anew from its texts.
    below = forest.deeper()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(left.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    signed = texts.mapInArrow(lambda it: _sketch(it, below), SKETCH_SCHEMA).select(F.col("doc_id").alias("id"), "fingerprint", "signature")
    own = classes.select("id", "fingerprint", "n_shingles", "brief").join(left, "id", "left_semi")
    signed = scratch.put(own.join(signed.dropDuplicates(["id", "fingerprint"]), ["id", "fingerprint"]), "signed")
    return grouped(docs, signed, linked.select(F.col("node").alias("a"), F.col("component").alias("b")), below, scratch)


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept`, one row per row of `docs` (`doc_id, text`).

    Null and empty texts, and texts without words, have no shingle and are linked with
    nothing. Rows that share a doc_id are one document. A row without a doc_id has no
    component and is kept. An empty table gives an empty table; other columns of `docs`
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = scratch.put(
        rows.mapInArrow(lambda it: _sketch(it, forest), SKETCH_SCHEMA),
        "sketches",
    )
    # The least id of each distinct set; partial aggregation collapses a hot set before the shuffle.
    classes = scratch.put(
        sketches.where("doc_id is not null and fingerprint is not null").groupBy("fingerprint")
        .agg(F.min(F.struct(F.col("doc_id").alias("id"), "n_shingles", "signature", "brief")).alias("_c")).select("fingerprint", "_c.*"),
        "classes",
    )
    # A document whose rows hold several sets links these.
    several = sketches.where("fingerprint is not null").select("fingerprint", F.col("doc_id").alias("b")).distinct()
    repeated = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("fingerprint").alias("_n")).where("_n > 1")
    several = several.join(repeated.select(F.col("doc_id").alias("b")), "b").join(classes.select("fingerprint", F.col("id").alias("a")), "fingerprint")
    found = scratch.put(grouped(docs, classes, several.select("a", "b").where("a <> b"), forest, scratch), "components")
    named = scratch.put(
        classes.select("fingerprint", "id").join(found, F.col("id") == F.col("node"), "left")
        .select("fingerprint", F.coalesce("component", "id").alias("component")), "named",
    )
    out = sketches.select("doc_id", "n_shingles", "fingerprint").join(named, "fingerprint", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
