"""Datasets packed as .zip, .tar, .tar.gz, .tgz or .gz archives of CSV files.

One archive is one dataset. An archive is a compressed stream, so the unit of
parallelism is the archive; inside a task members are decoded as streams and
emitted in batches, never held whole as rows.
"""

from __future__ import annotations

import csv
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CLASS, LABEL_ALIASES, URL_ALIASES
from ..functions.labels import normalize_label

# Archive endings; the first that fits is cut off the name.
ENDINGS = (".zip", ".tar.gz", ".tgz", ".tar", ".gz")
BATCH = 10_000
SCHEMA = "archive string, member string, src_row long, url string, raw_label string, has_label boolean"


def dataset_name(file_name: Column) -> Column:
    """File name without its archive ending."""
    pattern = "(?:" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + r")\z"
    return F.regexp_replace(file_name, pattern, "")


def clean_name(file_name: Column) -> Column:
    """Dataset name as an identifier: other characters become one underscore,
    none at the ends, lower case."""
    name = F.regexp_replace(dataset_name(file_name), "[^a-zA-Z0-9_]", "_")
    return F.lower(F.trim(F.regexp_replace(name, "_+", "_"), F.lit("_")))


def _members(path: str, content: bytes):
    """(member name, binary stream) of every CSV in the archive."""
    data, name = io.BytesIO(content), path.rsplit("/", 1)[-1]
    if name.endswith(".zip"):
        with zipfile.ZipFile(data) as z:
            for info in z.infolist():
                if info.filename.endswith(".csv"):
                    with z.open(info) as f:
                        yield info.filename, f
    elif name.endswith((".tar.gz", ".tgz", ".tar")):
        with tarfile.open(fileobj=data, mode="r:*") as t:
            for info in t:
                if info.isfile() and info.name.endswith(".csv"):
                    yield info.name, t.extractfile(info)
    elif name.endswith(".csv.gz"):
        with gzip.open(data) as f:
            yield name[: -len(".gz")], f


def _records(stream):
    """(row number, url, raw label, label column exists) of one CSV member."""
    csv.field_size_limit(2**31 - 1)  # a long URL is data
    text = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="")
    header_line = text.readline()
    sep = "," if len(next(csv.reader([header_line]), [])) > 1 else ";"
    header = next(csv.reader([header_line], delimiter=sep), [])
    where = {name.strip("﻿"): i for i, name in reversed(list(enumerate(header)))}
    url = next((where[a] for a in URL_ALIASES if a in where), None)
    if url is None:
        return
    label = next((where[a] for a in LABEL_ALIASES if a in where), None)
    for n, row in enumerate(csv.reader(text, delimiter=sep)):
        if not row or len(row) > len(header):
            continue
        get = lambda i: row[i] if i is not None and i < len(row) and row[i] != "" else None  # noqa: B023,E731
        yield n, get(url), get(label), label is not None


def _read_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["archive", "member", "src_row", "url", "raw_label", "has_label"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for member, stream in _members(path, content):
                rows = []
                for record in _records(stream):
                    rows.append((path, member, *record))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)


def read_archives(spark: SparkSession, store: str) -> DataFrame:
    """All archives below `store`: dataset, clean_name, url, label, provenance."""
    files = spark.read.format("binaryFile").load(store)
    name = F.substring_index("path", "/", -1)
    packed = files.where(name.rlike(r"\.(?:zip|tar\.gz|tgz|tar|gz)\z")).select("path", "content")
    rows = packed.mapInPandas(_read_archives, SCHEMA)
    file_name = F.substring_index("archive", "/", -1)
    label = F.when(F.col("has_label"), normalize_label(F.col("raw_label"))).otherwise(DEFAULT_CLASS)
    return rows.select(
        dataset_name(file_name).alias("dataset"),
        clean_name(file_name).alias("clean_name"),
        "url",
        label.alias("label"),
        F.concat_ws("/", "archive", "member").alias("src_file"),
        F.lit(0).cast("bigint").alias("src_block"),
        "src_row",
    )


def unpack_archives(spark: SparkSession, store: str, out: str) -> DataFrame:
    """Write all archives as one Parquet table partitioned by dataset and return
    the report: dataset, members, n_rows."""
    read_archives(spark, store).write.mode("overwrite").partitionBy("clean_name").parquet(out)
    done = spark.read.parquet(out)
    return done.groupBy("dataset", "clean_name").agg(
        F.count_distinct("src_file").alias("members"), F.count("*").alias("n_rows")
    )
