"""Scan-result feeds: JSON documents with a `results` array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CLASS

SCHEMA = (
    "results array<struct<api_id:string,"
    "page:struct<asn:string,country:string,ip:string,url:string>,result:string,"
    "stats:struct<data_length:double,requests:double,uniq_countries:double,uniq_ips:double>,"
    "task:struct<time:string,url:string,uuid:string,visibility:string>,"
    "verdicts:struct<malicious:boolean>>>"
)


def scans_to_labelled(scans: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """url, label, month from a DataFrame with a `results` column.

    url is the task's, else the page's; a scan without verdict is malicious;
    scans without URL are dropped. since/until: months `yyyy-MM`, both included.
    """
    scan = scans.select(F.explode("results").alias("s")).select("s.*")
    verdict = F.col("verdicts.malicious")
    out = scan.select(
        F.coalesce("task.url", "page.url").alias("url"),
        F.when(verdict.isNull(), DEFAULT_CLASS)
        .otherwise(F.when(verdict, "malicious").otherwise("benign"))
        .alias("label"),
        F.substring("task.time", 1, 7).alias("month"),
    ).where("url <> ''")
    if since:
        out = out.where(F.col("month") >= since)
    if until:
        out = out.where(F.col("month") <= until)
    return out


def read_scan_feed(spark: SparkSession, path: str, multi_line: bool = True, **months) -> DataFrame:
    """Feed files as (url, label, month). Use multi_line=False for one document per
    line, which lets Spark split large files."""
    raw = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)
    return scans_to_labelled(raw, **months)


def parse_scan_feed(text: DataFrame, column: str, **months) -> DataFrame:
    """The same for documents held in a text column."""
    parsed = text.select(F.from_json(column, SCHEMA).alias("d")).select("d.results")
    return scans_to_labelled(parsed, **months)
