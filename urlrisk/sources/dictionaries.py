"""Dictionary tables (id, value, description): loading and migration."""

from __future__ import annotations

import dataclasses
import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.wordlists import Dictionaries
from ..operators.curation import dedup_first_seen
from .paths import exists

log = logging.getLogger(__name__)

# Above this many values a list is not inlined but matched by a join.
INLINE_LIMIT = 2_000

# Dictionary -> store columns for value and description.
STORE_COLUMNS: dict[str, dict[str, tuple[str, ...]]] = {
    "auto_download_params": {"value": ("params",)},
    "brand_keyword": {"value": ("name",)},
    "free_hosting": {"value": ("AdresDomeny",)},
    "non_standard_port": {"value": ("dest_port",), "description": ("metadata_comment",)},
    "sorted_url": {"value": ("hosting",)},
    "suspicious_tld": {"value": ("url_domain",)},
}


def dictionary_values(df: DataFrame, strip_wildcard: bool = False) -> DataFrame:
    """Distinct non-blank values, trimmed and lower case; `*.` prefixes go for TLDs."""
    value = F.trim(F.col("value").cast("string"), F.lit(" \t\r\n\x0b\x0c"))
    if strip_wildcard:
        value = F.regexp_replace(value, r"\A[*.]+", "")
    return df.select(F.lower(value).alias("value")).where("value <> ''").distinct()


def load_dictionaries(spark: SparkSession, root: str) -> Dictionaries:
    """Dictionaries from `<root>/<name>.csv`; a missing or unreadable file leaves the
    default list. A list of any size is taken: a large one stays a table."""
    chosen = {}
    for field in dataclasses.fields(Dictionaries):
        path = f"{root.rstrip('/')}/{field.name}.csv"
        if not exists(spark, path):
            continue
        df = spark.read.options(header=True, escape='"').csv(path)
        if "value" not in df.columns:
            log.warning("No value column in %s; using the default list", path)
            continue
        values = dictionary_values(df, strip_wildcard=field.name == "suspicious_tld")
        rows = values.limit(INLINE_LIMIT + 1).collect()
        chosen[field.name] = tuple(sorted(r["value"] for r in rows)) if len(rows) <= INLINE_LIMIT else values
    return Dictionaries(**chosen)


def migrate(
    df: DataFrame, value_columns, description_columns=(), block: Column | str = "src_block",
    position: Column | str = "src_row",
) -> DataFrame:
    """Store table to dictionary table (id, value, description).

    The value is the first non-NULL of the value columns, trimmed; blank ones go,
    the first of equal values stays; ids count from 0 in (block, position) order.
    Ids come from counts per block plus the rank within one block (an input
    split), so no task has to see the whole table.
    """
    have = lambda names: [F.col(f"`{c}`").cast("string") for c in names if c in df.columns]
    values, descriptions = have(value_columns), have(description_columns)
    if not values:
        raise ValueError(f"the table has none of the value columns {list(value_columns)}")
    block = F.col(block) if isinstance(block, str) else block
    position = F.col(position) if isinstance(position, str) else position
    rows = df.select(
        F.trim(F.coalesce(*values), F.lit(" \t\r\n\x0b\x0c")).alias("value"),
        F.coalesce(*descriptions, F.lit("")).alias("description"),
        block.alias("_block"),
        position.alias("_pos"),
    ).where("value <> ''")
    first = dedup_first_seen(rows, ["_block", "_pos"], keys=["value"])
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = first.groupBy("_block").agg(F.count("*").alias("_n"))  # one row per split
    offsets = per_block.select("_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("_pos"))
    return (
        first.withColumn("_rank", rank)
        .join(offsets, "_block")
        .select((F.col("_before") + F.col("_rank") - 1).cast("bigint").alias("id"), "value", "description")
    )


def migrate_store(spark: SparkSession, store: str, out: str, mapping=None) -> DataFrame:
    """Migrate every mapped store file that exists; report: dictionary, status, n.

    Lines starting with # are comments; the separator is a tab when the header
    line has one, else a comma.
    """
    report = []
    for name, columns in (mapping or STORE_COLUMNS).items():
        path = f"{store.rstrip('/')}/{name}.csv"
        if not exists(spark, path):
            log.warning("dictionary %s: there is no %s", name, path)
            continue
        header = spark.read.text(path).where("NOT startswith(value, '#')").first()
        sep = "\t" if header and "\t" in header["value"] else ","
        df = spark.read.options(header=True, sep=sep, comment="#", escape='"').csv(path)
        df = df.select("*", F.col("_metadata.file_block_start").alias("src_block"),
                       F.monotonically_increasing_id().alias("src_row"))
        if not any(c in df.columns for c in columns["value"]):
            log.warning("dictionary %s: its file has none of the value columns", name)
            report.append((name, "skipped", 0))
            continue
        target = f"{out.rstrip('/')}/{name}.csv"
        done = migrate(df, columns["value"], columns.get("description", ()))
        done.orderBy("id").write.mode("overwrite").options(header=True, escape='"').csv(target)
        report.append((name, "migrated", spark.read.options(header=True).csv(target).count()))
    return spark.createDataFrame(report, "dictionary string, status string, n long")
