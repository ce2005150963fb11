"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters'
vectors: the first permuted twice, the second once (a cyclic shift each), multiplied by
the third. A text bundles (adds) its trigrams; a language prototype bundles the unit
vectors of its documents. A text's language is that of the prototype with the greatest
cosine to the text's vector.

Prototypes cover all learning rows: partial bundles per partition, added up by Spark.
What reaches the driver is one vector per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import add_columns, slices


@dataclass(frozen=True)
class Space:
    """Parameters. Trigrams are taken within blocks of `block` characters."""

    dimensions: int = 1024
    seed: int = 5
    block: int = 1 << 18
    documents: int = 48  #: texts multiplied at once


class Encoder:
    """Vectors of texts. Keeps the vectors of letters seen."""

    LETTERS = 4096  # beyond, the table starts anew (vectors do not depend on it)

    def __init__(self, space: Space):
        import numpy as np

        self.space = space
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self._reset()

    def _reset(self) -> None:
        import numpy as np

        self.places: dict[int, int] = {}
        self.tables = [np.zeros((0, self.space.dimensions), np.int8)] * 3

    def _places(self, letters):
        """Rows of letters in the tables."""
        import numpy as np

        if len(self.places) > self.LETTERS:
            self._reset()
        new = [int(c) for c in letters if int(c) not in self.places]
        if new:
            rows = np.stack([
                np.random.default_rng((self.space.seed, c)).integers(0, 2, self.space.dimensions, dtype=np.int8) * 2 - 1 for c in new
            ]).astype(np.int8)
            for c in new:
                self.places[c] = len(self.places)
            self.tables = [np.vstack([t, np.roll(rows, k, axis=1)]) for k, t in enumerate(self.tables)]
        return np.array([self.places[int(c)] for c in letters], np.int64)

    def trigrams(self, text: str | None):
        """Codes of all trigrams of a text: lower-cased letters, anything else a blank; runs
        of blanks count as one, and a blank stands at either end."""
        import numpy as np

        out = []
        for at in range(0, len(text or ""), self.space.block):
            c = np.frombuffer(text[at : at + self.space.block].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            c = np.concatenate([[0], np.where(self.is_letter[c], c, 0), [0]])
            c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
            if len(c) > 2:
                out.append((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: list):
        """A row per text; a zero row for a text without letters."""
        import numpy as np

        codes = [self.trigrams(t) for t in texts]
        every = np.concatenate(codes)
        if not len(every):
            return np.zeros((len(texts), self.space.dimensions), np.float32)
        grams, at = np.unique(every, return_inverse=True)
        row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        order = np.argsort(at)
        row, at = row[order], at[order]
        parts = [grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]
        letters = np.unique(np.concatenate(parts))
        rows = self._places(letters)
        first, second, third = (rows[np.searchsorted(letters, p)] for p in parts)
        out = np.zeros((len(texts), self.space.dimensions), np.float32)
        for a in range(0, len(grams), 4096):  # bounds memory where there are many trigrams
            s = slice(a, a + 4096)
            bound = self.tables[2][first[s]] * self.tables[1][second[s]] * self.tables[0][third[s]]
            lo, hi = np.searchsorted(at, (a, a + 4096))
            counts = np.bincount(row[lo:hi] * len(bound) + at[lo:hi] - a, minlength=len(texts) * len(bound))
            out += counts.reshape(len(texts), -1).astype(np.float32) @ bound.astype(np.float32)
        return out


def _unit(rows):
    import numpy as np

    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _bundle(batches: Iterator, space: Space) -> Iterator:
    import numpy as np
    import pyarrow as pa

    encoder, sums = Encoder(space), {}
    for whole in batches:
        for batch in slices(whole, space.documents):
            rows = _unit(encoder.encode(batch.column(1).to_pylist()))
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                part = rows[langs == lang].sum(0, dtype=np.float64)
                sums[lang] = sums.get(lang, 0) + part
    langs = sorted(sums)
    yield pa.record_batch([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.float64()))], names=("lang", "v"))


def prototypes(docs: DataFrame, learn: Column, space: Space = Space()) -> dict[str, list[float]]:
    """The vector of each language among the rows of `docs` (`text, lang`) where `learn`
    holds and lang is not null."""
    scratch = Scratch(docs.sparkSession, "language")
    rows = docs.where(learn & F.col("lang").isNotNull()).select("lang", "text")
    parts = scratch.put(rows.mapInArrow(lambda it: _bundle(it, space), "lang string, v array<double>"), "bundles")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    found = {r.lang: list(r.v) for r in whole.collect()}
    scratch.drop(parts)
    return {x: found[x] for x in sorted(found)}


def identify(docs: DataFrame, profiles: dict[str, list[float]], space: Space = Space(), carry: list[str] | None = None) -> DataFrame:
    """Columns of `docs` (or those in `carry`) with `lang_pred` and `score` (the cosine, 0 to 1).

    `und` with score 0 for a null text, one without a letter, or without any profile. Equal
    cosines: the language first by code point. Repeated rows stay; columns named like an
    added one are replaced; an empty table gives an empty table.
    """
    tools: dict = {}  # filled once per worker task

    def compute(column):
        import numpy as np

        if not tools:
            matrix = np.array(list(profiles.values()), np.float64).reshape(len(profiles), space.dimensions)
            tools.update(encoder=Encoder(space), langs=list(profiles), matrix=_unit(matrix))
        rows = tools["encoder"].encode(column.to_pylist()).astype(np.float64)
        known = np.abs(rows).sum(1) > 0
        if not profiles:
            return ["und"] * len(rows), np.zeros(len(rows))
        cosine = _unit(rows) @ tools["matrix"].T
        best = cosine.argmax(1)
        names = [tools["langs"][b] if k else "und" for b, k in zip(best, known, strict=True)]
        return names, np.where(known, np.clip(cosine.max(1), 0, 1), 0.0)

    return add_columns(docs, "text", "lang_pred string, score double", compute, carry, space.documents)
