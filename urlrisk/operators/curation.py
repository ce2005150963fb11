"""Curation of labelled URL tables: one schema, conflicts, duplicates, checks.

Duplicates are settled with aggregates (min, min_by), not with windows: partial
aggregation collapses a hot URL before the shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES, DEFAULT_CLASS, LABEL_ALIASES, URL_ALIASES
from ..functions.labels import normalize_label


def first_alias(columns, aliases) -> str | None:
    """First alias, in alias order, that is a column."""
    return next((a for a in aliases if a in columns), None)


def standardize(
    df: DataFrame,
    url_aliases=URL_ALIASES,
    label_aliases=LABEL_ALIASES,
    class_values=None,
    default_class: str = DEFAULT_CLASS,
    keep=(),
) -> DataFrame:
    """Project any labelled table to (url, label, *keep)."""
    url = first_alias(df.columns, url_aliases)
    if url is None:
        raise ValueError(f"No URL column found. Expected one of: {list(url_aliases)}")
    label = first_alias(df.columns, label_aliases)
    value = (
        F.lit(default_class)
        if label is None
        else normalize_label(F.col(label), class_values, default_class)
    )
    return df.select(F.col(url).cast("string").alias("url"), value.alias("label"), *keep)


def merge(frames) -> DataFrame:
    """Bag union of standardised tables."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def conflicts(df: DataFrame) -> DataFrame:
    """URLs that carry more than one label, with the number of labels."""
    return (
        df.where("url IS NOT NULL")
        .groupBy("url", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("url")
        .agg(F.count("*").alias("labels"), F.sum("n").alias("n_rows"))
        .where("labels > 1")
    )


def remove_conflicts(df: DataFrame) -> DataFrame:
    """All rows whose URL has one label only; rows without URL stay.

    The other columns are kept, so this needs a join; the right side has one row
    per URL, and adaptive execution splits the left partition of a hot URL. Use
    `settle` when one row per URL is enough: it needs no join.
    """
    bad = df.where("url IS NOT NULL").groupBy("url").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")
    ).where("lo <> hi").select("url")
    return df.join(bad, "url", "left_anti")


def dedup_min_label(df: DataFrame) -> DataFrame:
    """One row per URL, the smallest label."""
    return df.groupBy("url").agg(F.min("label").alias("label"))


def settle(df: DataFrame) -> DataFrame:
    """Conflict removal and deduplication in one aggregation, one shuffle.

    Rows without URL collapse to one row with the smallest label.
    """
    return (
        df.groupBy("url")
        .agg(F.min("label").alias("label"), F.max("label").alias("_hi"))
        .where("url IS NULL OR label = _hi")
        .select("url", "label")
    )


def merged(frames) -> DataFrame:
    """Union, conflict removal, deduplication, order by label (then URL)."""
    return settle(merge(frames)).orderBy("label", "url")


def dedup_first_seen(df: DataFrame, order, keys=("url",)) -> DataFrame:
    """Keep the first row of each key in `order` (column or list of columns)."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    others = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    picked = df.groupBy(*keys).agg(row)
    return picked.select(*keys, "_row.*").select(*df.columns)


def validation_issues(df: DataFrame, classes=CLASSES, class_values=None) -> DataFrame:
    """One row per finding: issue, item, n. Empty means valid.

    issue is `missing_column`, `null_values` or `invalid_label`; every offending
    column or label has its own row, so nothing is gathered in one place.
    """
    spark = df.sparkSession
    missing = []
    if "url" not in df.columns:
        missing.append(("missing_column", "url", 0))
    if "label" not in df.columns and "type" not in df.columns:
        missing.append(("missing_column", "label", 0))
    found = spark.createDataFrame(missing, "issue string, item string, n long")

    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    nulls = nulls.unpivot([], df.columns, "item", "n").where("n > 0")
    found = found.unionByName(nulls.select(F.lit("null_values").alias("issue"), "item", "n"))
    if "label" in df.columns:
        label = normalize_label(F.col("label"), class_values)
        bad = df.select(label.alias("item")).where(~F.col("item").isin(*classes))
        found = found.unionByName(
            bad.groupBy("item").agg(F.count("*").alias("n")).select(
                F.lit("invalid_label").alias("issue"), "item", "n"
            )
        )
    return found


def validate(df: DataFrame, classes=CLASSES) -> tuple[bool, DataFrame]:
    """(ok, findings): the findings are a table, since wrong labels may be many."""
    found = validation_issues(df, classes)
    return found.isEmpty(), found


def preprocess(df: DataFrame, order=None, classes=CLASSES, class_values=None) -> DataFrame:
    """First row per URL, no NULL URL, normalised label, known classes only."""
    if "label" not in df.columns and "type" in df.columns:
        df = df.withColumn("label", F.col("type"))
    df = df.where("url IS NOT NULL")
    if order is not None:
        df = dedup_first_seen(df, order)
    else:
        df = dedup_min_label(df.select("url", "label"))
    label = normalize_label(F.col("label"), class_values)
    return df.withColumn("label", label).where(F.col("label").isin(*classes))


def dataset_profile(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per dataset: total, class counts, both classes present, smaller class."""
    benign = F.count_if(F.col("label") == "benign")
    malicious = F.count_if(F.col("label") == "malicious")
    return df.groupBy(dataset).agg(
        F.count("*").alias("total"),
        benign.alias("benign"),
        malicious.alias("malicious"),
        ((benign > 0) & (malicious > 0)).alias("has_both_classes"),
        F.least(benign, malicious).alias("min_class"),
    )


def benign_pool(df: DataFrame, dataset: str = "dataset", order=None) -> DataFrame:
    """Benign URLs of all two-class datasets, one row per URL (no order implied).

    Whether a dataset has both classes comes from a per-dataset aggregate.
    """
    both = dataset_profile(df, dataset).where("has_both_classes").select(dataset)
    benign = df.where(F.col("label") == "benign").join(both, dataset, "left_semi")
    if order is None:
        return benign.select("url", "label").distinct()
    return dedup_first_seen(benign, order).select("url", "label")
