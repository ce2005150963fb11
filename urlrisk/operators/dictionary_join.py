"""Substring match against a large dictionary, as an equi-join.

Testing every text against every word would be rows x words. Instead each
distinct text is cut into its substrings of the lengths that occur in the
dictionary, and these are joined with the dictionary on equality, so the work
grows with the texts and not with the list.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urlparts import add_url_parts

SALTS = 32


def matching_texts(texts: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Distinct values of `column` that contain some word of `words.value`."""
    words = words.select(F.lower("value").alias("_word")).where("_word <> ''").distinct()
    # Distinct word lengths: at most the length of the longest word, one value.
    lengths = words.agg(F.collect_set(F.length("_word")).alias("_lengths"))
    distinct = texts.select(F.col(column).alias("_text")).where("_text <> ''").distinct()
    with_lengths = distinct.withColumn("_lengths", lengths.scalar())
    starts = lambda n: F.sequence(F.lit(1), F.length("_text") - n + 1)
    pieces = F.flatten(
        F.transform(
            F.filter("_lengths", lambda n: n <= F.length("_text")),
            lambda n: F.transform(starts(n), lambda i: F.substr("_text", i, n)),
        )
    )
    exploded = with_lengths.select("_text", F.explode(F.array_distinct(pieces)).alias("_word"))
    return exploded.join(words, "_word", "left_semi").select("_text").distinct()


#: Dictionary -> what it is compared with, and its bit in a mask. Host and query words may
#: stand anywhere in the text; a TLD and a port are compared as a whole.
LISTS: dict[str, tuple[str, int]] = {
    "free_hosting": ("host", 0), "sorted_url": ("host", 1), "brand_keyword": ("host", 2),
    "suspicious_tld": ("tld", 3), "non_standard_port": ("port", 4), "auto_download_params": ("query", 5),
}


def _word_masks(tables: dict[str, DataFrame]) -> DataFrame:
    """`_kind, _word, _mask`: every distinct word with the bits of the lists that have it."""
    parts = []
    for name, words in tables.items():
        kind, bit = LISTS[name]
        parts.append(words.select(F.lit(kind).alias("_kind"), F.lower("value").alias("_word"), F.lit(1 << bit).alias("_mask")))
    words = functools.reduce(lambda x, y: x.unionByName(y), parts).where("_word <> ''")
    return words.groupBy("_kind", "_word").agg(F.bit_or("_mask").alias("_mask"))


def _text_masks(texts: DataFrame, words: DataFrame) -> DataFrame:
    """`_key, _mask` of the rows `_key, _kind, _text` of `texts` in which a word is found:
    one join for all lists."""
    lengths = words.groupBy("_kind").agg(F.collect_set(F.length("_word")).alias("_lengths"))  # four rows at most
    inside = F.col("_kind").isin("host", "query")
    with_lengths = texts.where("_text <> ''").join(F.broadcast(lengths), "_kind")
    # First a row per length, so that no row holds all substrings of a long text.
    sized = with_lengths.select("_key", "_kind", "_text", F.explode("_lengths").alias("_n")).where(
        (inside & (F.col("_n") <= F.length("_text"))) | (F.col("_n") == F.length("_text"))
    )
    starts = F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1)
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substr("_text", i, F.col("_n"))))
    exploded = sized.select("_key", "_kind", F.explode(pieces).alias("_word"))
    return exploded.join(words, ["_kind", "_word"]).groupBy("_key").agg(F.bit_or("_mask").alias("_mask"))


def _with_mask(df: DataFrame, column: str, masks: DataFrame, mask: str, spread_by: str) -> DataFrame:
    """Append the mask of `column`. One host can hold a large share of all rows, so the join
    back is salted by `spread_by` (the whole URL): a matched text is repeated per salt, and
    the rows of one text spread over the salts."""
    hits = masks.select(
        F.col("_key").alias("_hit"), F.col("_mask").alias(mask), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_hit_salt")
    )
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    joined = salted.join(hits, (salted[column] == hits["_hit"]) & (salted["_salt"] == hits["_hit_salt"]), "left")
    return joined.drop("_hit", "_hit_salt", "_salt")


def add_list_masks(df: DataFrame, url: str, tables: dict[str, DataFrame], prefix: str) -> DataFrame:
    """Append `<prefix>host_mask` and `<prefix>query_mask`: which dictionaries of `tables`,
    of any size, the URL's host (with its TLD and port) and query match; null for none.

    Every distinct host and query is matched once against all lists, and the masks join
    back to rows that hold nothing else yet.
    """
    parts = add_url_parts(df, url, "_m_")
    rows = parts.select(*df.columns, F.col("_m_netloc").alias("_m_host"), F.col("_m_query").alias("_m_text"))
    words = _word_masks(tables)
    host, of = F.col("_key"), {LISTS[name][0] for name in tables}
    port = F.when(F.contains(host, F.lit(":")), F.substring_index(host, ":", -1)).otherwise("")
    kinds = {"host": F.lower(host), "tld": F.lower(F.substring_index(host, ".", -1)), "port": port}
    if of & set(kinds):
        asked = F.explode(F.array(*[F.struct(F.lit(k).alias("_kind"), c.alias("_text")) for k, c in kinds.items() if k in of])).alias("_a")
        hosts = rows.select(F.col("_m_host").alias("_key")).distinct().select("_key", asked).select("_key", "_a.*")
        rows = _with_mask(rows, "_m_host", _text_masks(hosts, words), f"{prefix}host_mask", url)
    if "query" in of:
        queries = rows.select(F.col("_m_text").alias("_key")).distinct()
        queries = queries.select("_key", F.lit("query").alias("_kind"), F.lower("_key").alias("_text"))
        rows = _with_mask(rows, "_m_text", _text_masks(queries, words), f"{prefix}query_mask", url)
    return rows.drop("_m_host", "_m_text")
