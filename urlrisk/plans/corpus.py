"""A labelled URL corpus derived from the `events` and `pages` tables.

One row per event: the event picks a page (event_id modulo the number of pages)
and one of twelve URL shapes (clean, secure, numeric host with port, redirect
query, throw-away domain, deep sub-domains, shortener, user info and port,
punycode, no scheme, non-ASCII, bad brackets). Labels are as dirty as raw feeds:
padded words, numbers, words and NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table that was read in fewer pieces than there are cores, since
    the work per row is heavy. A large input already has more and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def url_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, k (shape), url, label."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url")))
    events = spread(table(spark, sf_dir, "events").select("event_id", "event_type"))
    n_pages = table(spark, sf_dir, "pages").agg(F.count("*")).scalar()
    picked = events.select(
        "event_id",
        "event_type",
        F.pmod(F.col("event_id"), n_pages).alias("page_id"),
        (F.col("event_id") % 12).alias("k"),
    )
    number, kind, page = F.col("event_id").cast("string"), F.col("event_type"), F.col("page_url")
    text = F.lit
    shapes = {
        0: page,
        1: F.replace(page, text("http://"), text("https://")),
        2: F.concat(text("http://192.168."), (F.col("event_id") % 200).cast("string"),
                    text(".7:8080/dl/setup"), number, text(".exe")),
        3: F.concat(page, text("/?redirect=http%3A%2F%2Fbit.ly%2F"), number, text("&file=a.apk")),
        4: F.concat(text("xk7qz9wv3mtr"), number, text(".tk/login")),
        5: F.concat(text("http://paypal-secure.a.b.c.d.e.example.top//"), kind, text("/index.js")),
        6: F.concat(text("http://bit.ly/"), kind),
        7: F.concat(text("http://user:pw@Example.com:4444/a/b;v="), number, text("?x=1#frag")),
        8: F.concat(text("http://xn--80ak6aa92e.com/"), F.md5(page), text("?q="), kind,
                    text("&q=2&blank=&noeq&s=a+b%20c")),
        9: F.concat(text("example.com/go?to=http://"), kind, text(".000webhost.com/")),
        10: F.concat(text("https://bücher-"), (F.col("event_id") % 50).cast("string"),
                     text(".example/😀/é")),
        11: F.concat(text("bad[.]com/"), number, text("/x.scr")),
    }
    url = F.when(F.col("k") == 0, shapes[0])
    for k in range(1, 12):
        url = url.when(F.col("k") == k, shapes[k])
    label = (
        F.when(kind == "error", "Phishing ")
        .when(kind == "purchase", "1")
        .when(kind == "signup", "0")
        .when(kind == "click", "benign")
    )
    return picked.join(pages, "page_id").select(
        F.col("event_id").alias("row_id"), "k", url.alias("url"), label.alias("label")
    )
