"""Does a string contain any word of a list: the small-list form."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this many words a chain of `contains` is faster than one pattern.
CHAIN_LIMIT = 64


def without_redundant(words) -> list[str]:
    """Drop words that contain another word of the list: they cannot add a match."""
    kept: list[str] = []
    for w in sorted(set(words), key=lambda w: (len(w), w)):
        if w and not any(k in w for k in kept):
            kept.append(w)
    return sorted(kept)


def prefix_pattern(words) -> str:
    """One alternation that shares common prefixes, so each position of the text
    is tried once per first character instead of once per word."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w == "":
            return ""
        by_first.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + prefix_pattern(rest) for c, rest in by_first.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def contains_any(text: Column, words) -> Column:
    """True when `text` contains at least one of `words` as a substring."""
    words = without_redundant(words)
    if not words:
        return F.lit(False)
    if len(words) <= CHAIN_LIMIT:
        return functools.reduce(
            lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]
        )
    return text.rlike(prefix_pattern(words))


def flag(condition: Column) -> Column:
    """1.0 / 0.0; unknown counts as 0."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
