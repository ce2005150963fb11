"""URL filter: rules on a host (with its subdomains) and a path prefix.

Each distinct (host, path) is expanded into expressions, one per host suffix and
path prefix that ends at a slash, of the numbers of labels and slashes that rules have.
Expressions meet the rules in an equi-join on the
first 32 bits of their SHA-256; the full digest and the rule's whole path confirm a
hit, and the longest rule wins. Only hits go back to the pages.

Distinct URLs are formed before the join, so a host that holds a third of all pages
costs its distinct URLs; what skew remains is in plain shuffle joins, which adaptive
execution splits. No join is told to broadcast: Spark does it where its own size check
allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm.texts import ascii_lower, without

RULE_SCHEMA = "rule_host string, rule_path string, verdict string"

#: Hex digits of the digest that the join key has.
PREFIX_DIGITS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an absolute URL; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict) rows."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _expanded(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (host, path) with an expression `_e` for each shape that a rule has: the
    host's last labels and the path up to a slash, as many as the rule has. Each is as long
    as the URL at most, so the work grows with its length, not with the square."""
    shape = F.struct((_count(F.col("rule_host"), ".") + 1).alias("labels"), _count(F.col("_anchor"), "/").alias("slashes"))
    shapes = rules.agg(F.collect_set(shape))  # one row: the distinct shapes of the rules
    rows = urls.select("host", "path", F.explode(shapes.scalar()).alias("_s")).select("host", "path", "_s.*")
    rows = rows.where((_count(F.col("host"), ".") + 1 >= F.col("labels")) & (_count(F.col("path"), "/") >= F.col("slashes")))
    up_to = lambda text, mark, n: F.call_function("substring_index", text, F.lit(mark), n)
    prefix = F.when(F.col("slashes") > 0, F.concat(up_to(F.col("path"), "/", F.col("slashes")), F.lit("/"))).otherwise("")
    return rows.select("host", "path", F.concat(up_to(F.col("host"), ".", -F.col("labels")), prefix).alias("_e"))


def _keyed(df: DataFrame, expression: Column) -> DataFrame:
    digest = F.sha2(expression, 256)
    return df.withColumn("_digest", digest).withColumn("_key", F.substring("_digest", 1, PREFIX_DIGITS))


def decisions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct (host, path) that any rule fits: `host, path,
    rule, verdict`. Longest rule first (host and path together), then the longer host,
    then block before allow."""
    rules = rules.where("rule_host is not null and verdict is not null").select(
        ascii_lower(F.col("rule_host")).alias("rule_host"),
        F.coalesce("rule_path", F.lit("")).alias("rule_path"), "verdict",
    ).distinct()
    anchor = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0)  # up to the last slash
    rules = rules.withColumn("_anchor", anchor)
    keyed_rules = _keyed(rules, F.concat("rule_host", "_anchor")).drop("_anchor")
    keyed_urls = _keyed(_expanded(urls.select("host", "path").distinct(), rules), F.col("_e")).drop("_e")
    hits = keyed_urls.join(keyed_rules, ["_key"]).where(
        (keyed_urls["_digest"] == keyed_rules["_digest"]) & F.col("path").startswith(F.col("rule_path"))
    )
    best = F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"),
        F.length("rule_host").alias("host_length"), "verdict",
        F.concat("rule_host", "rule_path").alias("rule"),
    ))
    return hits.groupBy("host", "path").agg(best.alias("_b")).select("host", "path", "_b.rule", "_b.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with `host, path, rule, verdict`; the default verdict where no rule fits.

    A null URL, or one without `://`, has an empty host and path and meets only rules
    for an empty host. Repeated rows are judged alike and all stay. An empty table gives
    an empty table. A very long URL costs its length times the number of shapes of the
    rules. Input columns named like an added one are replaced. Rules without a
    host or a verdict are ignored, a null rule path counts as empty.
    """
    host, path = split_url(F.col(url))
    split = pages.select("*", host.alias("_host"), path.alias("_path"))
    found = decisions(split.select(F.col("_host").alias("host"), F.col("_path").alias("path")), rules)
    found = found.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "rule", "verdict")
    kept = without(split, "host", "path", "rule", "verdict")
    joined = kept.join(found, ["_host", "_path"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept.columns if c not in ("_host", "_path")],
        F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
