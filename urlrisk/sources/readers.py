"""Labelled datasets and URL lists as DataFrames.

Every labelled reader adds provenance: src_file, src_block (start of the input
split) and src_row (position within the split), which together give the arrival
order that first-seen deduplication needs.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TEST_URL_ALIASES
from ..operators.curation import first_alias, merge, standardize
from .paths import exists, list_files

log = logging.getLogger(__name__)

ORDER = ("src_file", "src_block", "src_row")


def sniff_header(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """(separator, column names): comma, unless that gives a single column."""
    options = {"header": True, "inferSchema": False, "escape": '"'}
    for sep in (",", ";"):
        columns = spark.read.options(sep=sep, **options).csv(path).columns
        if len(columns) > 1:
            return sep, columns
    return ",", spark.read.options(sep=",", **options).csv(path).columns


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One CSV file, all columns as text. Lines with too many fields are skipped,
    short lines are filled with NULL. Without `multi_line` the file is splittable."""
    sep, columns = sniff_header(spark, path)
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in columns]
        + [T.StructField("_extra", T.StringType())]
    )
    df = (
        spark.read.schema(schema)
        .options(header=True, sep=sep, escape='"', multiLine=multi_line, mode="PERMISSIVE")
        .csv(path)
    )
    return df.where("_extra IS NULL").select(
        *[F.col(f"`{c}`") for c in columns],
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
    )


def expand(spark: SparkSession, root: str, names) -> list[str]:
    """Dataset names to paths below `root`; `dataset/raw` or `raw` means every CSV
    there. Files that do not exist are skipped with a warning."""
    paths = []
    for name in names:
        if name in ("dataset/raw", "raw"):
            paths.extend(p for p in list_files(spark, root) if p.endswith(".csv"))
            continue
        path = name if "/" in name and exists(spark, name) else f"{root.rstrip('/')}/{name}"
        if exists(spark, path):
            paths.append(path)
        else:
            log.warning("%s does not exist and is left out", path)
    return paths


def read_labelled(spark: SparkSession, root: str, names, multi_line: bool = False) -> DataFrame:
    """Union of the named files, standardised to url, label and provenance."""
    paths = expand(spark, root, names)
    if not paths:
        raise ValueError("No valid datasets loaded")
    return merge([standardize(read_csv(spark, p, multi_line), keep=ORDER) for p in paths])


def merged_dataset(spark: SparkSession, root: str, names, out: str, reuse: bool = False) -> DataFrame:
    """Merged, conflict-free, deduplicated table, written as Parquet at `out`.

    reuse: return what is stored at `out`, if anything, without reading `names`.
    """
    from ..operators.curation import merged

    if not (reuse and exists(spark, out)):
        merged([read_labelled(spark, root, names)]).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text file, one URL per line, trimmed, blank lines dropped."""
    url = F.trim(F.col("value"), F.lit(" \t\r\n\x0b\x0c"))
    return spark.read.text(path).select(url.alias("url")).where("url <> ''")


def split_urls(text: Column) -> Column:
    """Comma-separated URLs as an array, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda u: F.trim(u)), lambda u: u != "")


def read_test_urls(spark: SparkSession, path: str) -> DataFrame:
    """URL column of a test CSV: the first known name, else the first column."""
    df = read_csv(spark, path)
    names = [c for c in df.columns if c not in ORDER]
    column = first_alias(names, TEST_URL_ALIASES) or names[0]
    return df.select(F.col(f"`{column}`").alias("url"), *ORDER).where("url IS NOT NULL")


def unique_urls(df: DataFrame, order=ORDER) -> DataFrame:
    """One row per URL, keeping the first one's order columns."""
    from ..operators.curation import dedup_first_seen

    return dedup_first_seen(df, list(order))
