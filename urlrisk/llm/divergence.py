"""How the sources of a language differ in their terms, by chunk factorization.

Documents are cut at white space into chunks, which are counted per document. Each
globally distinct chunk is cut into terms once; its counts are joined to its terms, and
distinct documents and occurrences are aggregated by term.

A task counts its documents in blocks. A block hands on one row per (lang, chunk): how
many documents have it, their numbers as long as they are fewer than a kept term needs,
and occurrences by source. Rows then meet twice, by chunk and by (lang, term), each time
sorted and merged as a stream, so no key needs memory of its own size. Tasks add up what
they can before either shuffle: a chunk that every document has is one row per block, a
term of very many chunks a few rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import slices, utf8

#: A term is a run of ASCII letters and characters beyond ASCII.
TERM = rb"[A-Za-z\x80-\xFF]+"
#: p is 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)).
UNIT, PRIOR = 1_000_000_000, 5


@dataclass(frozen=True)
class Settings:
    least_documents: int = 30
    top_terms: int = 50
    block_bytes: int = 12_000_000  #: text that a block gathers before its counts leave the worker
    held_terms: int = 100_000  #: terms that a task adds up before it hands them on
    tile_sources: int = 128  #: on a side of one tile of the pairwise sums
    tile_terms: int = 4096


def _blocks(batches: Iterator, most: int) -> Iterator:
    """Documents (text, lang, source_id) in blocks; a document is in one block."""
    import pyarrow as pa

    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, 256):
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _coded(column):
    """(distinct values, code of each row)"""
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _pairs(block):
    """(distinct chunks, chunk and document number of each pair, occurrences of the pair),
    by chunk and document."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts, documents, first = [], [], 0
    for text in block.column(0).chunks:
        split = pc.ascii_split_whitespace(text)
        parts.append(split.flatten())
        documents.append(np.repeat(np.arange(first, first + len(text), dtype=np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False)))
        first += len(text)
    chunks, code = _coded(pa.chunked_array(parts))
    pair, n = np.unique(code * np.int64(max(first, 1)) + np.concatenate(documents), return_counts=True)
    code, document = np.divmod(pair, max(first, 1))
    # Splitting leaves an empty piece where a text starts or ends with white space.
    filled = pc.binary_length(chunks).to_numpy(zero_copy_only=False)[code] > 0 if len(code) else np.zeros(0, bool)
    return chunks, code[filled], document[filled], n[filled]


def _packed(values, lengths):
    """Binary cells of `lengths` values each, from one flat array of 8-byte values."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(lengths)]) * 8
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


#: docs: document numbers, none for `least` documents or more; counts: (source_id, n) ...
_CHUNKS = "lang string, chunk string, documents long, docs binary, counts binary"


def _count_chunks(settings: Settings):
    least = settings.least_documents

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for block in _blocks(batches, settings.block_bytes):
            chunks, code, document, n = _pairs(block)
            langs, lang = _coded(block.column(1))
            sources, source = _coded(block.column(2))
            group = lang.astype(np.int64) * len(sources) + source
            key = code * (len(langs) * len(sources)) + group[document]
            order = np.argsort(key, kind="stable")
            key, document, n = key[order], document[order], n[order]
            entry = np.flatnonzero(np.diff(key, prepend=-1))  # starts of (chunk, lang, source)
            own = key // len(sources)
            row = np.flatnonzero(np.diff(own, prepend=-1))  # starts of (chunk, lang)
            if not len(row):
                continue
            documents = np.diff(row, append=len(key))
            counts = np.stack([sources.to_numpy(zero_copy_only=False)[key[entry] % len(sources)], np.add.reduceat(n, entry)], axis=1)
            few = documents < least
            docs = first + document[np.repeat(few, documents)]
            first += block.num_rows
            batch = pa.record_batch(
                [langs.take(pa.array(own[row] % len(langs))), chunks.take(pa.array(own[row] // len(langs))), pa.array(documents),
                 _packed(docs, np.where(few, documents, 0)), _packed(counts, 2 * np.diff(np.searchsorted(entry, row), append=len(entry)))],
                names=("lang", "chunk", "documents", "docs", "counts"),
            )
            yield from slices(batch, 20_000)

    return run


def _summed(counts: bytes, times: int = 1) -> bytes:
    """Packed (source_id, n) with one n per source, times `times`."""
    import numpy as np

    pairs = np.frombuffer(counts, np.int64).reshape(-1, 2)
    source, back = np.unique(pairs[:, 0], return_inverse=True)
    total = np.zeros(len(source), np.int64)
    np.add.at(total, back, pairs[:, 1] * times)
    return np.stack([source, total], axis=1).tobytes()


def _distinct(docs: bytes, least: int) -> bytes:
    """Packed distinct document numbers; `least` of them at most."""
    import numpy as np

    return np.unique(np.frombuffer(docs, np.int64))[:least].tobytes()


def _runs(batches: Iterator, least: int) -> Iterator:
    """Rows (key, key, most, surely, docs, counts), sorted by their keys, merged where the
    keys are equal: sums, maxima, cells strung together. Yields lists of columns. A run
    that goes on in the next batch is held back, and summed up when it gets long."""
    import numpy as np
    import pyarrow as pa

    def strung(cells, starts):
        ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
        ends = np.append(ends[starts], ends[-1])
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), cells.buffers()[2] or pa.py_buffer(b"")])

    held = None
    for whole in batches:
        for batch in slices(whole, 20_000):
            if not batch.num_rows:
                continue
            now = [c if held is None else pa.concat_arrays([h, c]) for h, c in zip(held or batch.columns, batch.columns, strict=True)]
            keys = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in now[:2]]
            starts = np.flatnonzero((np.diff(keys[0], prepend=-1) != 0) | (np.diff(keys[1], prepend=-1) != 0))
            most = np.add.reduceat(now[2].to_numpy(zero_copy_only=False), starts)
            surely = np.maximum.reduceat(now[3].to_numpy(zero_copy_only=False), starts)
            merged = [c.take(pa.array(starts)) for c in now[:2]] + [pa.array(most), pa.array(surely)] + [strung(c, starts) for c in now[4:]]
            if len(starts) > 1:
                yield [utf8(c.slice(0, len(starts) - 1)) for c in merged[:2]] + [c.slice(0, len(starts) - 1).to_pylist() for c in merged[2:]]
            held = [c.slice(len(starts) - 1) for c in merged]
            docs, counts = held[4][0].as_py(), held[5][0].as_py()
            if len(docs) > 64 * least or len(counts) > 1 << 16:
                held[4:] = [pa.array([_distinct(docs, least)], pa.binary()), pa.array([_summed(counts)], pa.binary())]
    if held is not None:
        yield [utf8(c) for c in held[:2]] + [c.to_pylist() for c in held[2:]]


#: most: sum of documents over the chunks of a term; surely: of its most frequent chunk.
_TERMS = "lang string, term string, most long, surely long, docs binary, counts binary"


def _cut_chunks(settings: Settings):
    """Rows (chunk, lang, documents, documents, docs, counts), sorted, to rows of _TERMS."""
    least = settings.least_documents

    def term_batch(table: dict):
        import pyarrow as pa

        columns = [[k[0] for k in table], [k[1] for k in table], *zip(*table.values(), strict=True)]
        kinds = pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.record_batch([made[0].cast(pa.string()), made[1].cast(pa.string()), *made[2:]], names=("lang", "term", "most", "surely", "docs", "counts"))

    def run(batches: Iterator) -> Iterator:
        import re
        from collections import Counter

        find, table, last, terms = re.compile(TERM).findall, {}, None, {}
        for columns in _runs(batches, least):
            for chunk, lang, documents, _, docs, counts in zip(*columns, strict=True):
                if chunk != last:
                    last, terms = chunk, Counter(find(chunk.lower()))  # bytes.lower() is A-Z only
                if documents >= least:
                    docs = b""  # enough are known; a document is in one block, so all differ
                for term, times in terms.items():
                    own = counts if times == 1 else _summed(counts, times)
                    had = table.get((lang, term))
                    if had is None:
                        table[lang, term] = documents, documents, docs, own
                    else:
                        both, own = had[2] + docs, had[3] + own
                        both = _distinct(both, least) if len(both) > 64 * least else both
                        own = _summed(own) if len(own) > 1 << 16 else own
                        table[lang, term] = had[0] + documents, max(had[1], documents), both, own
            if len(table) >= settings.held_terms:
                yield term_batch(table)
                table.clear()
        if table:
            yield term_batch(table)

    return run


def _sum_terms(least: int):
    """Rows of _TERMS, sorted by lang and term, to occurrences by source of kept terms."""

    def run(batches: Iterator) -> Iterator:
        import struct

        import pyarrow as pa

        for columns in _runs(batches, least):
            out = [], [], [], []
            for lang, term, most, surely, docs, counts in zip(*columns, strict=True):
                if most < least or surely < least and len(_distinct(docs, least)) < 8 * least:
                    continue
                sums = {}
                for source, n in struct.iter_unpack("=qq", counts):
                    sums[source] = sums.get(source, 0) + n
                for column, values in zip(out, ([lang] * len(sums), sums, [term] * len(sums), sums.values()), strict=True):
                    column.extend(values)
            text = lambda c: pa.array(c, pa.binary()).cast(pa.string())
            yield pa.record_batch([text(out[0]), pa.array(out[1], pa.int64()), text(out[2]), pa.array(out[3], pa.int64())], names=("lang", "source_id", "term", "n"))

    return run


def source_ids(sources: DataFrame) -> Column:
    """A 64-bit hash of the column `source` that differs for all of `sources`."""
    for seed in range(100):
        made = F.xxhash64(F.lit(seed), F.col("source"))
        n, ids = sources.agg(F.count("*"), F.count_distinct(made)).first()
        if n == ids:
            return made
    raise ValueError("no hash tells these sources apart")


def kept_terms(docs: DataFrame, settings: Settings) -> DataFrame:
    """`lang, source_id, term, n`: occurrences by source of the terms that at least
    `least_documents` documents of the language have. `docs` has `text, lang, source_id` without nulls."""
    chunks = docs.select("text", "lang", "source_id").mapInArrow(_count_chunks(settings), _CHUNKS)
    chunks = chunks.repartition("chunk").sortWithinPartitions("chunk", "lang")
    chunks = chunks.select("chunk", "lang", "documents", F.col("documents").alias("surely"), "docs", "counts")
    terms = chunks.mapInArrow(_cut_chunks(settings), _TERMS)
    terms = terms.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return terms.mapInArrow(_sum_terms(settings.least_documents), "lang string, source_id long, term string, n long")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    return (F.call_function("div", above, below) + 1).cast("long")


def _tile_sums(side: int):
    """Sums of |p - q| over the terms of one tile, for pairs a <> b of its sources. Rows
    with a null term carry a source's p of terms that it lacks."""

    def run(frame):
        import numpy as np
        import pandas as pd

        lang, ta, tb = frame["lang"].iloc[0], frame["ta"].iloc[0], frame["tb"].iloc[0]
        own = frame["term"].isna()
        base, rows = frame[own], frame[~own]
        numbers = np.sort(base["number"].to_numpy())
        codes, names = pd.factorize(rows["term"])
        p = np.repeat(base.set_index("number")["p"].loc[numbers].to_numpy(np.int64)[:, None], len(names), axis=1)
        p[np.searchsorted(numbers, rows["number"].to_numpy()), codes] = rows["p"].to_numpy(np.int64)
        left, right = np.flatnonzero(numbers // side == ta), np.flatnonzero(numbers // side == tb)
        out = []
        for i in left:
            total = np.abs(p[right] - p[i]).sum(1)
            out += [(lang, numbers[i], numbers[j], t, len(names)) for j, t in zip(right, total, strict=True) if ta != tb or j > i]
        return pd.DataFrame(out, columns=["lang", "a", "b", "part_sum", "part_terms"])

    return run


def pair_sums(groups: DataFrame, grid: DataFrame, settings: Settings) -> DataFrame:
    """`lang, a, b, value` for pairs of source numbers a < b of a language: the sum of
    |p - q| over all its kept terms. `groups`: `lang, number, v, p0` (p of a term that the
    source lacks), `grid`: `lang, number, term, v, p` of terms that it has. Sources and
    terms meet in tiles, so a task holds a bounded matrix however many there are."""
    side = settings.tile_sources
    tile = F.floor(F.col("number") / side)
    blocks = F.ceil(F.col("v") / settings.tile_terms)
    tiles = groups.groupBy("lang").agg((F.floor(F.max("number") / side) + 1).alias("tiles"))
    # A source's rows go to every pair of tiles that has its own tile.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    columns = ["lang", "number", "term", "p", "block"]
    has = grid.withColumn("block", F.pmod(F.xxhash64("term"), blocks)).select(*columns)
    lacks = groups.where("v > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    lacks = lacks.select("lang", "number", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "block")
    dealt = has.unionByName(lacks).join(tiles, "lang").select(*columns, other, tile.alias("own"))
    dealt = dealt.select(*columns, F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"))
    sums = dealt.groupBy("lang", "ta", "tb", "block").applyInPandas(
        _tile_sums(side), "lang string, a long, b long, part_sum long, part_terms long"
    )
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("part_sum").alias("s"), F.sum("part_terms").alias("t"))
    sides = [groups.select("lang", F.col("number").alias(x), F.col("p0").alias(f"p0_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab"]
    rest = (F.col("v_a") - F.col("t")) * F.abs(F.col("p0_a") - F.col("p0_b"))  # terms that no source of the tile has
    return sums.join(sides[0], ["lang", "a"]).join(sides[1], ["lang", "b"]).select("lang", "a", "b", (F.col("s") + rest).alias("value"))


def audit(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`lang, source, part, item, value, rank`: how each (lang, source) group of `docs`
    (`text, lang, source`) differs from the other sources of its language (part `pair`, all
    of them) and which terms it favours (part `term`, to rank `top_terms`).

    Null text, lang and source count as ''. Every row is a document, repeated rows too;
    empty texts and texts without a term add no count but make their group occur. A
    language without a kept term has pairs with value 0 and no terms. Ties go to the
    smaller item by UTF-8. Very long texts and chunks are one row each and are counted
    whole. Other columns are not read. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    clean = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    named = scratch.put(clean.select("lang", "source").distinct(), "sources")
    ids = source_ids(named.select("source").distinct())
    named = named.withColumn("source_id", ids)
    counts = scratch.put(kept_terms(clean.withColumn("source_id", ids), settings), "counts")
    kept = scratch.put(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n")), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source_id").agg(F.sum("n").alias("total"))
    groups = named.join(totals, ["lang", "source_id"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    p0 = F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    groups = scratch.put(groups.select("lang", "source", "source_id", "total", "v", "lang_total", number.alias("number"), p0.alias("p0")), "groups")
    grid = counts.join(kept, ["lang", "term"]).join(groups, ["lang", "source_id"])
    p = probability(F.col("n"), F.col("total"), F.col("v"))
    q = probability(F.col("all_n"), F.col("lang_total"), F.col("v"))
    grid = scratch.put(grid.select("lang", "source", "number", "term", "v", p.alias("p"), q.alias("q")), "grid")
    scratch.drop(counts, kept)

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    terms = grid.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = ranked(terms, "term").where(F.col("rank") <= settings.top_terms)
    sums = pair_sums(groups.select("lang", "number", "v", "p0"), grid.select("lang", "number", "term", "v", "p"), settings)
    name = groups.select("lang", "number", "source")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    both = both.join(name.toDF("lang", "a", "source"), ["lang", "a"]).join(name.toDF("lang", "b", "item"), ["lang", "b"])
    # The result has these pairs; languages without a kept term have them with value 0.
    bare = groups.where("v = 0").select("lang", "source")
    bare = bare.join(bare.toDF("lang", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = both.select("lang", "source", "item", "value").unionByName(bare.select("lang", "source", "item", "value"))
    return ranked(pairs, "pair").unionByName(terms)
