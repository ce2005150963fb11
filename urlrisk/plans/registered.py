"""Named queries over the driver tables, and their SQL twins.

Every query is a function (spark, sf_dir) -> DataFrame over whole tables; `SQL`
holds the equivalent text for those that SQL can express.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import catalog
from ..functions import textstats as ts
from ..functions import wordlists as wl
from ..functions.labels import CLASS_VALUES, normalize_label
from ..functions.urlparts import add_url_parts, query_fields
from ..operators import curation as cu
from ..operators import logistic_search
from ..operators import metrics as me
from ..operators import models as mo
from ..operators import sampling as sa
from ..operators import scoring as sc
from ..operators import selection as se
from ..operators.dictionary_join import matching_texts
from ..operators.features import add_features
from ..operators.imbalance import imbalance_profile
from ..operators.smote import smote
from ..sources import registry as rg
from ..sources.archives import clean_name, dataset_name
from ..sources.dictionaries import migrate
from ..sources.paths import shared_dir, stored
from ..sources.readers import split_urls, unique_urls
from ..sources.scan_feed import parse_scan_feed
from ..streaming import workers as wk
from . import feature_sql as fs
from . import train as tr
from .corpus import table, url_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 42
ENTROPIES = ("url_entropy", "domain_entropy", "path_entropy", "query_entropy")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- features

DIGITS, LETTERS, SPECIALS = r"[\p{Nd}]", r"[\p{L}]", r"[^\p{L}\p{N}]"


def _rounded(df: DataFrame) -> DataFrame:
    """Entropies to 9 places: engines add the terms in different orders."""
    return df.withColumns({c: F.round(c, 9) for c in ENTROPIES if c in df.columns})


def _group(names):
    cols = ", ".join(["row_id", *names])
    return f"WITH {fs.with_features(names)}\nSELECT {cols} FROM feats"


def _unweighted(spark, sf_dir, groups):
    df = add_features(url_corpus(spark, sf_dir), groups=groups, apply_weights=False, keep_validity=False)
    return _rounded(df.select("row_id", *catalog.feature_names(groups)))


@query(
    f"WITH {fs.CORPUS},\n{fs.PARTS}\nSELECT row_id, scheme, host AS netloc, path, params, query, fragment, "
    "valid AS is_valid_url FROM parts"
)
def url_parts(spark, sf_dir):
    return add_url_parts(url_corpus(spark, sf_dir)).select(
        "row_id", "scheme", "netloc", "path", "params", "query", "fragment", "is_valid_url"
    )


@query(
    f"WITH {fs.CORPUS},\n{fs.PARTS},\n{fs.MEASURES}\nSELECT row_id, u.f.k AS field, u.f.v AS value "
    "FROM (SELECT row_id, unnest(fields) AS f FROM m2) u"
)
def query_parameters(spark, sf_dir):
    parts = add_url_parts(url_corpus(spark, sf_dir))
    f = parts.select("row_id", F.explode(query_fields(F.col("query"))).alias("f"))
    return f.select("row_id", F.col("f.k").alias("field"), F.col("f.v").alias("value"))


@query(_group(catalog.feature_names(["url_level"])))
def feat_url(spark, sf_dir):
    return _unweighted(spark, sf_dir, ["url_level"])


@query(_group(catalog.feature_names(["url_level_thresholds"])))
def feat_url_thresholds(spark, sf_dir):
    return _unweighted(spark, sf_dir, ["url_level_thresholds"])


@query(_group(catalog.feature_names(["domain_level"])))
def feat_domain(spark, sf_dir):
    return _unweighted(spark, sf_dir, ["domain_level"])


@query(_group(catalog.feature_names(["path_level"])))
def feat_path(spark, sf_dir):
    return _unweighted(spark, sf_dir, ["path_level"])


@query(_group(catalog.feature_names(["query_level"])))
def feat_query(spark, sf_dir):
    return _unweighted(spark, sf_dir, ["query_level"])


@query(_group(catalog.feature_names(["pattern_features"])))
def feat_pattern(spark, sf_dir):
    return _unweighted(spark, sf_dir, ["pattern_features"])


OPTIONAL = ["structural_ratios", "suspicious_keywords", "extended"]


@query(_group(catalog.feature_names(OPTIONAL)))
def feat_optional(spark, sf_dir):
    return _unweighted(spark, sf_dir, OPTIONAL)


_ALL = ", ".join(catalog.FEATURES)


@query(
    f"WITH {fs.with_features(factors=catalog.default_weights())}\n"
    f"SELECT row_id, url, label, valid AS is_valid_url, {_ALL} FROM feats"
)
def feat_weighted(spark, sf_dir):
    """All 73 features with emphasis weights: the training projection."""
    return _rounded(add_features(url_corpus(spark, sf_dir))).drop("k")


_SOFT = {n: w * (1.2 if n in catalog.EMPHASIS["malicious"][1] else 1.0)
         for n, w in catalog.default_weights().items()}
_SOFT_NAMES = list(catalog.EMPHASIS["malicious"][1])


@query(
    f"WITH {fs.with_features(_SOFT_NAMES, _SOFT)}\nSELECT row_id, "
    + ", ".join(f"round({n}, 9) AS {n}" for n in _SOFT_NAMES) + " FROM feats"
)
def feat_soft_emphasis(spark, sf_dir):
    df = add_features(url_corpus(spark, sf_dir), soft_class="malicious")
    return df.select("row_id", *[F.round(n, 9).alias(n) for n in _SOFT_NAMES])


@query(
    f"WITH {fs.with_features(['url_entropy', 'url_length', 'http_token'])}\n"
    "SELECT k, count(*) AS n, round(avg(url_entropy), 6) AS avg_entropy, max(url_length) AS max_length, "
    "sum(http_token) AS n_http FROM feats GROUP BY k"
)
def feat_by_shape(spark, sf_dir):
    df = add_features(url_corpus(spark, sf_dir), apply_weights=False)
    return df.groupBy("k").agg(
        F.count("*").alias("n"), F.round(F.avg("url_entropy"), 6).alias("avg_entropy"),
        F.max("url_length").alias("max_length"), F.sum("http_token").alias("n_http"),
    )


@query(
    "SELECT doc_id, length(text) AS n, "
    + f"{fs.digits('text')} AS digits, {fs.letters('text')} AS letters, "
    + f"{fs.run('text', DIGITS)} AS run_digit, {fs.run('text', LETTERS)} AS run_letter, "
    + f"{fs.run('text', SPECIALS)} AS run_special, round({fs.entropy('text')}, 9) AS entropy "
    + "FROM documents"
)
def text_statistics(spark, sf_dir):
    """The character statistics over whole documents."""
    s = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(s).alias("n"), ts.digit_count(s).alias("digits"),
        ts.letter_count(s).alias("letters"), ts.longest_digit_run(s).alias("run_digit"),
        ts.longest_letter_run(s).alias("run_letter"), ts.longest_special_run(s).alias("run_special"),
        F.round(ts.entropy(s), 9).alias("entropy"),
    )


@query(
    f"WITH {fs.with_features(['url_length'])}, groups(feature, feature_group) AS (VALUES "
    + ", ".join(f"('{n}', '{g}')" for g, ms in catalog.GROUPS.items() for n, _ in ms)
    + "), wide AS (SELECT "
    + ", ".join(f"({fs.EXPRESSIONS[n]})::DOUBLE AS {n}" for n in catalog.FEATURES)
    + " FROM m2 WHERE valid), long AS (UNPIVOT wide ON COLUMNS(*) INTO NAME feature VALUE v)\n"
    "SELECT feature_group, count(DISTINCT long.feature) AS n_features, count(*) FILTER (WHERE v <> 0) AS n_nonzero "
    "FROM long JOIN groups USING (feature) GROUP BY feature_group"
)
def catalog_summary(spark, sf_dir):
    """Features per group, and how many values of the corpus are not zero."""
    df = add_features(url_corpus(spark, sf_dir)).where("is_valid_url")
    counts = df.agg(*[F.count_if(F.col(f) != 0).alias(f) for f in catalog.FEATURES])
    long = counts.unpivot([], catalog.FEATURES, "feature", "n")
    return long.join(catalog.catalog_table(spark), "feature").groupBy("feature_group").agg(
        F.count("*").alias("n_features"), F.sum("n").alias("n_nonzero")
    )


_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#.]*)', 1)"


@query(
    f"WITH {fs.CORPUS},\n{fs.PARTS},\nwords AS (SELECT DISTINCT {_HOST} AS w FROM pages WHERE {_HOST} <> '')\n"
    "SELECT DISTINCT lower(host) AS host FROM parts WHERE EXISTS "
    "(SELECT 1 FROM words WHERE contains(lower(parts.host), words.w))"
)
def dictionary_hosts(spark, sf_dir):
    """Hosts that contain a word of a large dictionary (here: labels of page hosts)."""
    label = F.regexp_extract("url", r"^[a-z]+://([^/?#.]*)", 1)
    words = table(spark, sf_dir, "pages").select(label.alias("value")).where("value <> ''")
    hosts = add_url_parts(url_corpus(spark, sf_dir)).select(F.lower("netloc").alias("host"))
    return matching_texts(hosts, "host", words).select(F.col("_text").alias("host"))


@query(
    f"WITH {fs.CORPUS},\n{fs.PARTS},\nwords AS (SELECT DISTINCT {_HOST} AS w FROM pages WHERE {_HOST} <> '')\n"
    "SELECT row_id, (CASE WHEN valid AND EXISTS (SELECT 1 FROM words WHERE contains(lower(parts.host), words.w)) "
    "THEN 1.0 ELSE 0.0 END)::DOUBLE AS free_hosting_domain_flag FROM parts"
)
def dictionary_flags(spark, sf_dir):
    """The dictionary flag per row when the dictionary is a table."""
    label = F.regexp_extract("url", r"^[a-z]+://([^/?#.]*)", 1)
    words = table(spark, sf_dir, "pages").select(label.alias("value")).where("value <> ''")
    d = wl.Dictionaries(free_hosting=words)
    df = add_features(url_corpus(spark, sf_dir), groups=["domain_level"], dictionaries=d)
    return df.select("row_id", "free_hosting_domain_flag")


@query(
    f"WITH {fs.CORPUS},\n{fs.PARTS},\nwords AS (SELECT DISTINCT {_HOST} AS w FROM pages WHERE {_HOST} <> ''),\n"
    "tlds AS (SELECT DISTINCT 'top' || (page_id % 3)::VARCHAR AS w FROM pages UNION SELECT 'com' UNION SELECT DISTINCT split_part(url, '.', -1) FROM pages), "
    "ports AS (SELECT DISTINCT (page_id * 2)::VARCHAR AS w FROM pages UNION SELECT '4444'), "
    "kinds AS (SELECT DISTINCT event_type AS w FROM events)\n"
    "SELECT row_id, (CASE WHEN valid AND EXISTS (SELECT 1 FROM words WHERE contains(lower(host), w)) THEN 1.0 ELSE 0.0 END)::DOUBLE AS brand_keyword_flag, "
    "(CASE WHEN valid AND lower(split_part(host, '.', -1)) IN (SELECT lower(w) FROM tlds) THEN 1.0 ELSE 0.0 END)::DOUBLE AS tld_suspicious_flag, "
    "(CASE WHEN valid AND contains(host, ':') AND split_part(host, ':', -1) IN (SELECT w FROM ports) THEN 1.0 ELSE 0.0 END)::DOUBLE AS non_standard_port_flag, "
    "(CASE WHEN valid AND EXISTS (SELECT 1 FROM kinds WHERE contains(lower(query), w)) THEN 1.0 ELSE 0.0 END)::DOUBLE AS auto_download_param_flag FROM parts"
)
def dictionary_lists(spark, sf_dir):
    """The flags of four dictionaries that are tables, matched in one join."""
    pages = table(spark, sf_dir, "pages")
    one = lambda w: spark.createDataFrame([(w,)], "value string")
    d = wl.Dictionaries(
        brand_keyword=pages.select(F.regexp_extract("url", r"^[a-z]+://([^/?#.]*)", 1).alias("value")).where("value <> ''"),
        suspicious_tld=pages.select(F.concat(F.lit("top"), (F.col("page_id") % 3).cast("string")).alias("value")).unionByName(one("com"))
        .unionByName(pages.select(F.substring_index("url", ".", -1).alias("value"))),
        non_standard_port=pages.select((F.col("page_id") * 2).cast("string").alias("value")).unionByName(one("4444")),
        auto_download_params=table(spark, sf_dir, "events").select(F.col("event_type").alias("value")),
    )
    df = add_features(url_corpus(spark, sf_dir), dictionaries=d, apply_weights=False)
    return df.select("row_id", "brand_keyword_flag", "tld_suspicious_flag", "non_standard_port_flag", "auto_download_param_flag")


# ---------------------------------------------------------------- curation

_VALUES = ", ".join(f"('{v}', '{c}')" for c, vs in CLASS_VALUES.items() for v in vs)


def _normal(raw: str) -> str:
    key = (
        f"(CASE WHEN regexp_full_match(lower(trim({raw})), '[+-]?[0-9]+(\\.[0-9]*)?') THEN "
        f"CAST(CAST(split_part(lower(trim({raw})), '.', 1) AS BIGINT) AS VARCHAR) ELSE lower(trim({raw})) END)"
    )
    cases = " ".join(f"WHEN '{v}' THEN '{c}'" for c, vs in CLASS_VALUES.items() for v in vs)
    return f"(CASE WHEN {raw} IS NULL THEN 'malicious' ELSE CASE {key} {cases} ELSE {key} END END)"


# Rows of several datasets: two event types are single-class feeds, the rest mixes.
_DATASET = (
    "CASE WHEN l.label IS NULL THEN 'view_feed' WHEN l.label = 'Phishing ' THEN 'error_feed' "
    "ELSE 'mix' || CAST(k % 3 AS VARCHAR) END"
)
_LABELLED = (
    f"{fs.CORPUS},\nlabelled AS (SELECT row_id, k, url, {_normal('label')} AS label, {_DATASET} AS dataset "
    "FROM corpus l)"
)
_SETTLED = (
    f"{_LABELLED},\nsettled AS (SELECT url, min(label) AS label FROM labelled GROUP BY url "
    "HAVING min(label) = max(label))"
)


def labelled_corpus(spark, sf_dir) -> DataFrame:
    raw = F.col("label")
    dataset = (
        F.when(raw.isNull(), "view_feed").when(raw == "Phishing ", "error_feed")
        .otherwise(F.concat(F.lit("mix"), (F.col("k") % 3).cast("string")))
    )
    return url_corpus(spark, sf_dir).select(
        "row_id", "k", "url", normalize_label(raw).alias("label"), dataset.alias("dataset")
    )


def settled_corpus(spark, sf_dir) -> DataFrame:
    return cu.settle(labelled_corpus(spark, sf_dir).select("url", "label"))


_RAW = "(CASE WHEN event_id % 7 = 0 THEN CAST(value AS VARCHAR) ELSE event_type END)"


@query(
    "WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN ' Safe ' "
    "WHEN 'purchase' THEN CAST(event_id % 5 AS VARCHAR) || '.0' WHEN 'error' THEN 'TRUE' "
    f"ELSE event_type END AS raw FROM events)\nSELECT event_id, {_normal('raw')} AS label FROM r"
)
def label_normalize(spark, sf_dir):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", F.lit(None)).when(kind == "signup", " Safe ")
        .when(kind == "purchase", F.concat((F.col("event_id") % 5).cast("string"), F.lit(".0")))
        .when(kind == "error", "TRUE").otherwise(kind)
    )
    return table(spark, sf_dir, "events").select("event_id", normalize_label(raw).alias("label"))


@query(
    f"SELECT props AS url, {_normal('event_type')} AS label FROM events UNION ALL "
    "SELECT url, 'malicious' FROM pages"
)
def alias_projection(spark, sf_dir):
    """Two sources with different column names brought to (url, label) and merged."""
    first = table(spark, sf_dir, "events").select(
        F.col("props").alias("input"), F.col("event_type").alias("type"), "value"
    )
    second = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("target"))
    return cu.merge([cu.standardize(first), cu.standardize(second)])


@query(f"WITH {_LABELLED}\nSELECT url, count(DISTINCT label) AS labels, count(*) AS n_rows FROM labelled "
       "GROUP BY url HAVING count(DISTINCT label) > 1")
def label_conflicts(spark, sf_dir):
    return cu.conflicts(labelled_corpus(spark, sf_dir))


@query(f"WITH {_LABELLED}\nSELECT row_id, url, label FROM labelled WHERE url NOT IN (SELECT url FROM labelled "
       "GROUP BY url HAVING count(DISTINCT label) > 1)")
def conflict_removal(spark, sf_dir):
    return cu.remove_conflicts(labelled_corpus(spark, sf_dir)).select("row_id", "url", "label")


@query(f"WITH {_LABELLED}\nSELECT url, min(label) AS label FROM labelled GROUP BY url")
def dedup_min(spark, sf_dir):
    return cu.dedup_min_label(labelled_corpus(spark, sf_dir))


@query(f"WITH {_LABELLED}\nSELECT row_id, url, label FROM labelled "
       "QUALIFY row_number() OVER (PARTITION BY url ORDER BY row_id) = 1")
def dedup_first(spark, sf_dir):
    return cu.dedup_first_seen(labelled_corpus(spark, sf_dir), "row_id").select("row_id", "url", "label")


@query(f"WITH {_SETTLED}\nSELECT url, label FROM settled ORDER BY label, url")
def merged_dataset(spark, sf_dir):
    return cu.merged([labelled_corpus(spark, sf_dir).select("url", "label")])


@query(
    "WITH r AS (SELECT url, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'normal' ELSE event_type END AS label "
    "FROM events LEFT JOIN pages ON event_id = page_id)\n"
    "SELECT 'null_values' AS issue, 'url' AS item, count(*) AS n FROM r WHERE url IS NULL HAVING count(*) > 0 "
    "UNION ALL SELECT 'null_values', 'label', count(*) FROM r WHERE label IS NULL HAVING count(*) > 0 "
    f"UNION ALL SELECT 'invalid_label', l, count(*) FROM (SELECT {_normal('label')} AS l FROM r) "
    "WHERE l NOT IN ('benign', 'malicious') GROUP BY l"
)
def validate_issues(spark, sf_dir):
    kind = F.col("event_type")
    label = F.when(kind == "click", "normal").when(kind != "view", kind)
    events = table(spark, sf_dir, "events").select("event_id", label.alias("label"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), "url")
    return cu.validation_issues(events.join(pages, "event_id", "left").select("url", "label"))


@query(
    f"WITH {fs.CORPUS},\nf AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY url ORDER BY row_id) = 1)\n"
    f"SELECT row_id, url, {_normal('label')} AS label FROM f WHERE {_normal('label')} IN ('benign', 'malicious')"
)
def preprocess(spark, sf_dir):
    return cu.preprocess(url_corpus(spark, sf_dir).drop("k"), order="row_id")


@query(f"WITH {_LABELLED}\nSELECT dataset, count(*) AS total, count(*) FILTER (WHERE label = 'benign') AS benign, "
       "count(*) FILTER (WHERE label = 'malicious') AS malicious, "
       "count(*) FILTER (WHERE label = 'benign') > 0 AND count(*) FILTER (WHERE label = 'malicious') > 0 AS has_both_classes, "
       "least(count(*) FILTER (WHERE label = 'benign'), count(*) FILTER (WHERE label = 'malicious')) AS min_class "
       "FROM labelled GROUP BY dataset")
def dataset_profile(spark, sf_dir):
    return cu.dataset_profile(labelled_corpus(spark, sf_dir))


# One row per (dataset, url), first seen; the input of the per-dataset operators.
_DATASETS = (
    f"{_LABELLED},\nds AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY dataset, url ORDER BY row_id) = 1),\n"
    "prof AS (SELECT dataset, count(*) AS total, count(*) FILTER (WHERE label = 'benign') AS b, "
    "count(*) FILTER (WHERE label = 'malicious') AS m FROM ds GROUP BY dataset),\n"
    "pool AS (SELECT DISTINCT url, label FROM ds JOIN prof USING (dataset) WHERE b > 0 AND m > 0 AND label = 'benign')"
)


def dataset_rows(spark, sf_dir) -> DataFrame:
    return cu.dedup_first_seen(labelled_corpus(spark, sf_dir), "row_id", ["dataset", "url"])


@query(f"WITH {_DATASETS}\nSELECT url, label FROM pool")
def benign_pool(spark, sf_dir):
    return cu.benign_pool(dataset_rows(spark, sf_dir))


@query("SELECT url, min(page_id) AS first_row FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, url FROM pages) "
       "GROUP BY url")
def unique_url_list(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("first_row"))
    twice = pages.unionByName(pages.withColumn("first_row", F.col("first_row") + 1000000))
    return unique_urls(twice, ["first_row"])


@query("SELECT page_id, trim(u) AS url FROM (SELECT page_id, unnest(string_split(url || ' , ,' || url || '/x,', ',')) AS u FROM pages) "
       "WHERE trim(u) <> ''")
def url_list_split(spark, sf_dir):
    text = F.concat("url", F.lit(" , ,"), "url", F.lit("/x,"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(split_urls(text)).alias("url"))


# ---------------------------------------------------------------- sampling

_KEY = "md5(concat('42|', url))"


def _profile_row(source: str, label: str, frm: str) -> str:
    return (
        f"SELECT '{source}' AS source, sum(n)::BIGINT AS total_samples, min(n) AS min_samples, max(n) AS max_samples, "
        f"max(n) / min(n) AS imbalance_ratio FROM (SELECT {label} AS l, count(*) AS n FROM {frm} GROUP BY 1)"
    )


_PROFILES = (
    ("orders", "o_orderstatus"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"),
    ("labels", "quality"), ("labels", "toxic"), ("events", "event_type"), ("documents", "lang"),
    ("customer", "c_mktsegment"),
)


@query(
    "WITH p AS (" + " UNION ALL ".join(_profile_row(f"{t}.{c}", c, t) for t, c in _PROFILES) + "), "
    "s AS (SELECT *, CASE WHEN imbalance_ratio < 2 THEN 'balanced' WHEN imbalance_ratio < 5 THEN 'mild' "
    "WHEN imbalance_ratio < 10 THEN 'moderate' WHEN imbalance_ratio < 20 THEN 'severe' ELSE 'extreme' END AS severity FROM p)\n"
    "SELECT source, total_samples, min_samples, max_samples, round(imbalance_ratio, 6) AS imbalance_ratio, severity, "
    "CASE WHEN severity = 'balanced' THEN 'none' WHEN min_samples < 6 THEN 'oversampling' "
    "WHEN severity = 'mild' THEN CASE WHEN total_samples < 1000 THEN 'oversampling' ELSE 'smote' END "
    "WHEN severity IN ('moderate', 'severe') THEN CASE WHEN min_samples < 50 THEN 'oversampling' ELSE 'smote' END "
    "WHEN max_samples > 10000 THEN 'undersampling' ELSE 'smote' END AS balancing_method FROM s"
)
def imbalance(spark, sf_dir):
    """Profile, severity and method for eight label columns."""
    frames = []
    for name, column in _PROFILES:
        labels = table(spark, sf_dir, name).select(F.col(column).cast("string").alias("label"))
        frames.append(imbalance_profile(labels).select(
            F.lit(f"{name}.{column}").alias("source"), "total_samples", "min_samples", "max_samples",
            F.round("imbalance_ratio", 6).alias("imbalance_ratio"), "severity", "balancing_method",
        ))
    return cu.merge(frames)


@query(f"WITH {_SETTLED}, c AS (SELECT label, count(*) AS n FROM settled GROUP BY label)\n"
       "SELECT label, n, n::DOUBLE / sum(n) OVER () AS share FROM c")
def class_shares(spark, sf_dir):
    p = imbalance_profile(settled_corpus(spark, sf_dir))
    return p.select(F.explode("class_distribution").alias("label", "share"), "class_counts").select(
        "label", F.col("class_counts")[F.col("label")].alias("n"), "share"
    )


@query(f"WITH {_SETTLED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY}) AS rn FROM settled), "
       "lo AS (SELECT min(n) AS q FROM (SELECT count(*) AS n FROM settled GROUP BY label))\n"
       "SELECT url, label FROM r CROSS JOIN lo WHERE rn <= q")
def undersample(spark, sf_dir):
    return sa.undersample(stored(settled_corpus(spark, sf_dir), "settled"), SEED)


@query(
    f"WITH {_SETTLED}, c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS hi FROM settled GROUP BY label), "
    f"r AS (SELECT url, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY}) - 1 AS idx FROM settled), "
    "d AS (SELECT label, n, unnest(range(hi - n)) AS i FROM c), "
    "p AS (SELECT label, CAST('0x' || substr(md5(concat('42|', label, '|', i)), 1, 15) AS BIGINT) % n AS idx FROM d), "
    "pc AS (SELECT label, idx, count(*) AS copies FROM p GROUP BY ALL)\n"
    "SELECT url, label, 0::BIGINT AS copy_no FROM settled UNION ALL "
    "SELECT url, label, unnest(range(1, copies + 1)) FROM r JOIN pc USING (label, idx)"
)
def oversample(spark, sf_dir):
    return sa.oversample(stored(settled_corpus(spark, sf_dir), "settled"), SEED)


@query(f"WITH {_DATASETS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY {_KEY}) AS rn FROM ds)\n"
       "SELECT dataset, url, label FROM r JOIN prof USING (dataset) WHERE rn <= least(b, m)")
def equal_per_class(spark, sf_dir):
    rows = stored(dataset_rows(spark, sf_dir).select("dataset", "url", "label"), "datasets")
    return sa.equal_per_class(rows, SEED)


@query(f"WITH {_DATASETS}, r AS (SELECT *, row_number() OVER (ORDER BY {_KEY}) AS rn FROM pool), "
       "single AS (SELECT * FROM prof WHERE b = 0 OR m = 0)\n"
       "SELECT dataset, url, label, FALSE AS from_pool FROM ds JOIN single USING (dataset) UNION ALL "
       "SELECT dataset, url, label, TRUE FROM r JOIN single ON rn <= total")
def single_class_fill(spark, sf_dir):
    rows = stored(dataset_rows(spark, sf_dir).select("dataset", "url", "label"), "datasets")
    return sa.fill_single_class(rows, cu.benign_pool(rows), SEED)


_QUOTAS = (
    "c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM settled GROUP BY label), "
    "t AS (SELECT *, total - CAST(ceil(0.3::DOUBLE * total::DOUBLE) AS BIGINT) AS n_train FROM c), "
    "e AS (SELECT *, n::DOUBLE * n_train::DOUBLE / total::DOUBLE AS x FROM t), "
    "q AS (SELECT *, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, label) <= "
    "n_train - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM e)"
)


@query(f"WITH {_SETTLED}, {_QUOTAS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY}) AS rn FROM settled)\n"
       "SELECT r.url, r.label, rn > quota AS is_test FROM r JOIN q USING (label)")
def stratified_split(spark, sf_dir):
    return sa.stratified_split(stored(settled_corpus(spark, sf_dir), "settled"), SEED)


@query(f"WITH {_SETTLED}, {_QUOTAS}\nSELECT label, quota::BIGINT AS train, (n - quota)::BIGINT AS test FROM q")
def split_sizes(spark, sf_dir):
    rows = sa.stratified_split(stored(settled_corpus(spark, sf_dir), "settled"), SEED)
    return rows.groupBy("label").agg(
        F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")
    )


#: From `settled` to `folded` (url, label, fold).
_FOLDS = (
    "c AS (SELECT label, count(*) AS n, sum(count(*)) OVER (ORDER BY label) - count(*) AS o FROM settled GROUP BY label), "
    "s AS (SELECT label, i, CAST(floor((o + n - 1 - i)::DOUBLE / 5) - floor((o - 1 - i)::DOUBLE / 5) AS BIGINT) AS size "
    "FROM c, range(5) AS g(i)), "
    "e AS (SELECT label, i, sum(size) OVER (PARTITION BY label ORDER BY i) AS hi, sum(size) OVER (PARTITION BY label ORDER BY i) - size AS lo FROM s), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY}) AS rn FROM settled), "
    "folded AS (SELECT r.url, r.label, e.i::INTEGER AS fold FROM r JOIN e ON r.label = e.label AND rn > lo AND rn <= hi)"
)


@query(f"WITH {_SETTLED}, {_FOLDS}\nSELECT * FROM folded")
def stratified_folds(spark, sf_dir):
    return sa.stratified_folds(stored(settled_corpus(spark, sf_dir), "settled"), SEED)


_RARE = "CASE WHEN l_returnflag = 'R' THEN 'rare' ELSE 'common' END"


@query(
    f"WITH {_SETTLED}, c AS (SELECT label, count(*) AS n FROM settled GROUP BY label)\n"
    "SELECT label, max(n) OVER () AS total, max(n) OVER () - n AS synthetic FROM c"
)
def smote_balance(spark, sf_dir):
    """Class sizes after SMOTE on the weighted features."""
    featured = stored(add_features(settled_corpus(spark, sf_dir)).drop("is_valid_url"), "features")
    return smote(featured, SEED).groupBy("label").agg(
        F.count("*").alias("total"), F.count_if(F.col("url").isNull()).alias("synthetic")
    )


@query()
def smote_embeddings(spark, sf_dir):
    """Synthetic vectors for every embedding label, up to the largest one."""
    vectors = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(len(vectors.select("embedding").first()[0]))]
    rows = vectors.select(
        F.col("vec_id").cast("string").alias("url"), F.col("label").cast("string").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    out = smote(stored(rows, "vectors"), SEED, features=names)
    return out.select("row_key", "label", *[F.round(n, 6).alias(n) for n in names])


# ---------------------------------------------------------------- metrics

_RULES = {
    "by_host": "ip_address_flag + tld_suspicious_flag + shortening_service_flag + port_in_url_flag > 0",
    "by_text": "high_entropy > 0 AND digit_ratio > 0.1",
    "by_path": "executable_extension_flag + double_slash_redirecting + redirect_parameter_flag > 0",
}
_RULE_FEATURES = sorted({
    "ip_address_flag", "tld_suspicious_flag", "shortening_service_flag", "port_in_url_flag", "high_entropy",
    "digit_ratio", "executable_extension_flag", "double_slash_redirecting", "redirect_parameter_flag",
})


def _rule_rows() -> str:
    sql = [
        f"SELECT '{r}' AS algorithm, {_normal('label')} AS label, CASE WHEN {c} THEN 'malicious' ELSE 'benign' END AS prediction FROM feats"
        for r, c in _RULES.items()
    ]
    return (
        f"{fs.with_features(_RULE_FEATURES)},\npred AS ({' UNION ALL '.join(sql)}),\n"
        "cells AS (SELECT algorithm, label, prediction, count(*) AS n FROM pred GROUP BY ALL),\n"
        "cls AS (SELECT algorithm, c AS class, sum(CASE WHEN label = c THEN n ELSE 0 END) AS support, "
        "sum(CASE WHEN prediction = c THEN n ELSE 0 END) AS predicted, "
        "sum(CASE WHEN label = c AND prediction = c THEN n ELSE 0 END) AS hit "
        "FROM cells CROSS JOIN (VALUES ('benign'), ('malicious')) AS v(c) GROUP BY ALL),\n"
        "pr AS (SELECT *, CASE WHEN predicted > 0 THEN hit::DOUBLE / predicted ELSE 0 END AS p, "
        "CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS r FROM cls),\n"
        "f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),\n"
        "w AS (SELECT algorithm, sum(hit)::DOUBLE / sum(support) AS accuracy, sum(p * support) / sum(support) AS precision, "
        "sum(r * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1, sum(support)::BIGINT AS support, "
        "avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf FROM f GROUP BY algorithm)"
    )


def rule_counts(spark, sf_dir) -> DataFrame:
    """(algorithm, label, prediction, n) of three hand-written rules: one pass."""
    df = add_features(url_corpus(spark, sf_dir), apply_weights=False)
    verdicts = F.array(*[
        F.struct(F.lit(r).alias("algorithm"),
                 F.when(F.expr(c), "malicious").otherwise("benign").alias("prediction"))
        for r, c in _RULES.items()
    ])
    rows = df.select(normalize_label(F.col("label")).alias("label"), F.explode(verdicts).alias("v"))
    return me.label_prediction_counts(rows.select("label", "v.*"), by=["algorithm"])


_R = lambda c, n=None: f"round({c}, 9) AS {n or c}"


@query(f"WITH {_rule_rows()}\nSELECT algorithm, label, sum(CASE WHEN prediction = 'benign' THEN n ELSE 0 END)::BIGINT AS pred_benign, "
       "sum(CASE WHEN prediction = 'malicious' THEN n ELSE 0 END)::BIGINT AS pred_malicious FROM cells GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return me.confusion_matrix(rule_counts(spark, sf_dir), ["benign", "malicious"], ["algorithm"])


@query(f"WITH {_rule_rows()}\nSELECT algorithm, {_R('accuracy')}, {_R('precision')}, {_R('recall')}, {_R('f1')} FROM w")
def weighted_metrics(spark, sf_dir):
    w = me.weighted_metrics(rule_counts(spark, sf_dir), ["algorithm"])
    return w.select("algorithm", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(
    f"WITH {_rule_rows()}\nSELECT algorithm, class, {_R('p', 'precision')}, {_R('r', 'recall')}, {_R('f1')}, support::BIGINT AS support FROM f "
    f"UNION ALL SELECT algorithm, 'accuracy', {_R('accuracy', 'a')}, {_R('accuracy', 'b')}, {_R('accuracy', 'c')}, support FROM w "
    f"UNION ALL SELECT algorithm, 'macro avg', {_R('mp')}, {_R('mr')}, {_R('mf')}, support FROM w "
    f"UNION ALL SELECT algorithm, 'weighted avg', {_R('precision', 'a')}, {_R('recall', 'b')}, {_R('f1', 'c')}, support FROM w"
)
def classification_report(spark, sf_dir):
    r = me.classification_report(rule_counts(spark, sf_dir), ["algorithm"])
    return r.select("algorithm", "class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_rule_rows()}\nSELECT algorithm, {_R('accuracy')}, {_R('f1')} FROM w ORDER BY w.f1 DESC, algorithm LIMIT 1")
def champion(spark, sf_dir):
    best = me.champion(me.weighted_metrics(rule_counts(spark, sf_dir), ["algorithm"]))
    return best.select("algorithm", F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


# ---------------------------------------------------------------- models


@query(f"WITH {_SETTLED}\nSELECT url, label, CASE label WHEN 'benign' THEN 0.0 ELSE 1.0 END::DOUBLE AS label_index FROM settled")
def label_encode(spark, sf_dir):
    rows = settled_corpus(spark, sf_dir)
    return mo.label_indexer(rows.select("label")).transform(rows)


_NUM = [n for g in catalog.GROUPS.values() for n, kind in g if kind == "numeric"]


@query(
    f"WITH {fs.with_features(_NUM)}, long AS (UNPIVOT (SELECT {', '.join(_NUM)} FROM feats) ON COLUMNS(*) INTO NAME feature VALUE v)\n"
    "SELECT feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM long GROUP BY feature"
)
def scaler_statistics(spark, sf_dir):
    """Mean and deviation per numeric feature: what the scaler is fitted with."""
    df = add_features(url_corpus(spark, sf_dir), apply_weights=False)
    row = df.agg(
        F.map_from_arrays(F.array(*map(F.lit, _NUM)), F.array(*[F.struct(
            F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std")) for n in _NUM])).alias("m")
    )
    return row.select(F.explode("m").alias("feature", "s")).select("feature", "s.mean", "s.std")


def _feature_rows(spark, sf_dir) -> DataFrame:
    return stored(add_features(settled_corpus(spark, sf_dir)).drop("is_valid_url"), "features")


#: Comparison and cross-validation tables of the searches this session has run.
_SEARCHES: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _search(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The full search: default Settings, so every algorithm, all candidates and folds.
    Both of its tables are stored, so that one search serves both queries of a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _SEARCHES:
        settings = Settings()
        rows, _, _ = tr.prepare(_feature_rows(spark, sf_dir), settings)
        found = tr.train_and_compare(stored(rows, "rows"), settings)["results"]
        failed = {a: r["error"] for a, r in found.items() if "error" in r}
        if failed:  # a table without them would look like the whole comparison
            raise ValueError(f"Algorithms failed to train: {failed}")
        tables = [r["cv_results"].select(F.lit(name).alias("algorithm"), "*") for name, r in found.items()]
        candidates = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
        _SEARCHES[key] = stored(tr.comparison_table(spark, found), "compared"), stored(candidates, "candidates")
    return _SEARCHES[key]


@query()
def train_compare(spark, sf_dir):
    """Tune, fit and compare all algorithms; comparison table."""
    return _search(spark, sf_dir)[0]


@query()
def cv_candidates(spark, sf_dir):
    """Cross-validation tables of all algorithms: split scores, mean, std, rank, times."""
    return _search(spark, sf_dir)[1]


@query(
    f"WITH {fs.with_features(_NUM)},\n"
    f"lab AS (SELECT url, {_normal('label')} AS label FROM feats),\n"
    "settled AS (SELECT url, min(label) AS label FROM lab GROUP BY url HAVING min(label) = max(label)),\n"
    f"one AS (SELECT DISTINCT url, {', '.join(_NUM)} FROM feats),\n{_FOLDS},\n"
    f"x AS (SELECT folded.fold AS own, {', '.join(_NUM)} FROM folded JOIN one USING (url)),\n"
    f"long AS (UNPIVOT x ON {', '.join(_NUM)} INTO NAME feature VALUE v)\n"
    "SELECT i::INTEGER AS fold, feature, count(*) AS n, round(avg(v), 6) AS mean, "
    "CASE WHEN max(v) = min(v) THEN 0.0 ELSE round(stddev_samp(v), 6) END AS std FROM long, range(5) AS g(i) WHERE own <> i GROUP BY i, feature"
)
def fold_scaling(spark, sf_dir):
    """What the scaler of each fold's fits holds: moments of all other folds, merged."""
    rows = add_features(settled_corpus(spark, sf_dir), apply_weights=False)
    folded = stored(sa.stratified_folds(stored(rows, "featured"), SEED), "folded")
    scales = logistic_search.training_scales(logistic_search.fold_moments(folded, _NUM))
    found = [(int(k), name, int(n), round(float(mu), 6), round(1 / float(f), 6) if f else 0.0)
             for k, (n, mean, factor) in scales.items() for name, mu, f in zip(_NUM, mean, factor)]
    return spark.createDataFrame(found, "fold int, feature string, n long, mean double, std double")


def _quick_model(spark, sf_dir):
    rows = _feature_rows(spark, sf_dir)
    indexer = mo.label_indexer(rows.select("label"))
    model = mo.pipeline("decision_tree", {"maxDepth": 5}, SEED).fit(indexer.transform(rows))
    return model, list(indexer.labels)


@query()
def feature_importance(spark, sf_dir):
    model, _ = _quick_model(spark, sf_dir)
    return spark.createDataFrame(mo.feature_importance(model), "feature string, importance double")


@query()
def score_urls(spark, sf_dir):
    """Score the whole corpus with a tree fitted on it."""
    model, classes = _quick_model(spark, sf_dir)
    scored = sc.score(url_corpus(spark, sf_dir), model, classes, model_id="quick")
    return scored.select("row_id", "status", "error", "class", "is_malicious", F.round("confidence", 6).alias("confidence"),
                         "suggested_desc", "model_id")


# ---------------------------------------------------------------- scoring

# A scored table whose class and confidence come from features, so SQL can follow.
_SCORED = (
    f"{fs.with_features(['ip_address_flag', 'tld_suspicious_flag', 'letter_ratio', 'digit_ratio'])},\n"
    "sc AS (SELECT row_id, k, url, CASE WHEN valid THEN 'success' ELSE 'failed' END AS status, "
    "CASE WHEN NOT valid THEN 'Malformed authority in URL' END AS error, "
    "CASE WHEN valid THEN CASE WHEN ip_address_flag + tld_suspicious_flag > 0 THEN 'malicious' "
    "WHEN k = 3 THEN 'redirect' WHEN k = 6 THEN 'spam' WHEN k = 7 THEN 'phishing' WHEN k = 8 THEN 'malware' "
    "ELSE 'benign' END END AS class, CASE WHEN valid THEN round(letter_ratio, 6) END AS confidence FROM feats)"
)
_PCT = "printf('%.2f%%', confidence * 100)"


def scored_corpus(spark, sf_dir) -> DataFrame:
    df = add_features(url_corpus(spark, sf_dir), apply_weights=False)
    k, url, valid = F.col("k"), F.col("url"), F.col("is_valid_url")
    verdict = F.when(F.col("ip_address_flag") + F.col("tld_suspicious_flag") > 0, "malicious")
    for shape, name in ((3, "redirect"), (6, "spam"), (7, "phishing"), (8, "malware")):
        verdict = verdict.when(k == shape, name)
    df = df.select(
        "row_id", "k", "url", sc.url_status(url, valid).alias("status"), sc.url_error(url, valid).alias("error"),
        verdict.otherwise("benign").alias("class"), F.round("letter_ratio", 6).alias("confidence"),
        F.create_map(F.lit("benign"), F.col("letter_ratio")).alias("probabilities"),
    )
    return sc.result_columns(df, "rules")


@query(
    f"WITH {_SCORED}\nSELECT row_id, url, status, error, class, class <> 'benign' AS is_malicious, confidence, "
    "CASE class WHEN 'benign' THEN CASE WHEN confidence > 0.9 THEN 'This URL appears to be safe with high confidence.' "
    "WHEN confidence > 0.7 THEN 'This URL appears to be safe, but exercise caution.' "
    "ELSE 'This URL may be safe, but confidence is low. Verify before accessing.' END "
    f"WHEN 'phishing' THEN concat('Warning: This URL is likely a phishing attempt (confidence: ', {_PCT}, '). Do not enter personal information or credentials.') "
    f"WHEN 'malware' THEN concat('Danger: This URL may contain malware (confidence: ', {_PCT}, '). Avoid accessing this link.') "
    f"WHEN 'redirect' THEN concat('Caution: This URL appears to be a redirect (confidence: ', {_PCT}, '). It may lead to malicious content.') "
    f"WHEN 'spam' THEN concat('This URL is likely spam (confidence: ', {_PCT}, '). It may be unwanted or misleading content.') "
    f"WHEN 'malicious' THEN concat('This URL has been classified as malicious with ', {_PCT}, ' confidence.') END AS suggested_desc FROM sc"
)
def advice_text(spark, sf_dir):
    return scored_corpus(spark, sf_dir).select(
        "row_id", "url", "status", "error", "class", "is_malicious", "confidence", "suggested_desc"
    )


_SUMMARY = (
    f"WITH {_SCORED}\nSELECT k, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS successful, "
    "count(*) FILTER (WHERE status <> 'success') AS failed, "
    "round(count(*) FILTER (WHERE status = 'success')::DOUBLE / count(*) * 100, 2) AS success_rate, "
    "CASE WHEN count(*) FILTER (WHERE status <> 'success') = 0 THEN 'success' "
    "WHEN count(*) FILTER (WHERE status = 'success') > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM sc GROUP BY k"
)


@query(_SUMMARY)
def batch_summary(spark, sf_dir):
    return sc.batch_summary(scored_corpus(spark, sf_dir), by=["k"])


@query(_SUMMARY)
def score_summary(spark, sf_dir):
    """Counts of a scored corpus; they do not depend on the model."""
    model, classes = _quick_model(spark, sf_dir)
    scored = sc.score(url_corpus(spark, sf_dir), model, classes)
    return sc.batch_summary(scored, by=["k"])


@query(f"WITH {_SCORED}, c AS (SELECT class, count(*) AS n FROM sc WHERE status = 'success' GROUP BY class)\n"
       "SELECT class, n, round(n::DOUBLE / sum(n) OVER () * 100, 1) AS percent FROM c")
def class_distribution(spark, sf_dir):
    return sc.class_distribution(scored_corpus(spark, sf_dir))


@query(
    f"WITH {fs.with_features(_NUM)}, top AS (SELECT * FROM feats WHERE valid ORDER BY length(url) DESC, row_id LIMIT 5), "
    f"num AS (SELECT row_number() OVER (ORDER BY url_length DESC, row_id) AS no, {', '.join(_NUM)} FROM top), "
    f"long AS (UNPIVOT num ON {', '.join(_NUM)} INTO NAME feature VALUE v)\n"
    "SELECT feature, " + ", ".join(f"max(CASE WHEN no = {i} THEN v END) AS url_{i}" for i in range(1, 6))
    + " FROM long GROUP BY feature"
)
def url_compare(spark, sf_dir):
    """Numeric features of the five longest valid URLs side by side."""
    df = add_features(url_corpus(spark, sf_dir), apply_weights=False).where("is_valid_url")
    top = df.orderBy(F.desc("url_length"), "row_id").limit(5)
    five = F.sort_array(F.collect_list(F.struct(
        (-F.col("url_length")).alias("o"), "row_id", F.struct(*_NUM).alias("f"))))
    numbered = top.agg(five.alias("rows")).select(F.posexplode("rows").alias("no", "r"))
    wide = _rounded(numbered.select((F.col("no") + 1).alias("no"), "r.f.*"))
    return sc.compare_urls(wide, "no", [1, 2, 3, 4, 5], _NUM)


# ---------------------------------------------------------------- sources

_FILE = "concat(split_part(url, '/', 3), ' - ', page_id, CASE page_id % 5 WHEN 0 THEN '.zip' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.tgz' WHEN 3 THEN '.tar' ELSE '.csv.gz' END)"
_CUT = f"regexp_replace({_FILE}, '(\\.zip|\\.tar\\.gz|\\.tgz|\\.tar|\\.gz)$', '')"


@query(f"SELECT page_id, {_CUT} AS dataset, lower(trim(regexp_replace(regexp_replace({_CUT}, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) "
       "AS clean_name FROM pages")
def archive_names(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, (".zip", ".tar.gz", ".tgz", ".tar", ".csv.gz"))),
                          (F.col("page_id") % 5 + 1).cast("int"))
    host = F.split_part("url", F.lit("/"), F.lit(3))
    name = F.concat(host, F.lit(" - "), F.col("page_id").cast("string"), ending)
    return table(spark, sf_dir, "pages").select(
        "page_id", dataset_name(name).alias("dataset"), clean_name(name).alias("clean_name")
    )


@query(
    f"WITH {fs.CORPUS}\nSELECT CASE WHEN c.k % 3 = 0 THEN c.url ELSE p.url END AS url, "
    "CASE e.event_type WHEN 'click' THEN 'benign' ELSE 'malicious' END AS label, strftime(e.ts, '%Y-%m') AS month "
    "FROM corpus c JOIN events e ON c.row_id = e.event_id LEFT JOIN pages p ON c.row_id = p.page_id "
    "WHERE (c.k % 3 = 0 OR p.url IS NOT NULL) AND strftime(e.ts, '%Y-%m') >= '2024-01'"
)
def scan_feed(spark, sf_dir):
    """Scan documents (made of corpus, events and pages) parsed back to rows."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "event_type"
    )
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.col("url").alias("page_url"))
    rows = url_corpus(spark, sf_dir).join(events, "row_id").join(pages, "row_id", "left")
    kind = F.col("event_type")
    scan = F.struct(
        F.struct(F.col("page_url").alias("url")).alias("page"),
        F.struct("time", F.when(F.col("k") % 3 == 0, F.col("url")).alias("url")).alias("task"),
        F.when(kind != "view", F.struct((kind != "click").alias("malicious"))).alias("verdicts"),
    )
    docs = rows.select(F.to_json(F.struct(F.array(scan).alias("results"))).alias("doc"))
    return parse_scan_feed(docs, "doc", since="2024-01")


@query(
    "WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '  ' ELSE ' w' || (user_id % 97)::VARCHAR || ' ' END AS a, "
    "event_type || (user_id % 31)::VARCHAR AS b, CASE WHEN event_type <> 'view' THEN event_type END AS d FROM events), "
    "v AS (SELECT event_id, trim(coalesce(a, b)) AS value, coalesce(d, '') AS description FROM r WHERE trim(coalesce(a, b)) <> ''), "
    "f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY value ORDER BY event_id) = 1)\n"
    "SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, value, description FROM f"
)
def dictionary_migrate(spark, sf_dir):
    n, user = F.col("event_id"), F.col("user_id")
    a = F.when(n % 3 == 0, F.lit(None)).when(n % 7 == 0, "  ").otherwise(
        F.concat(F.lit(" w"), (user % 97).cast("string"), F.lit(" ")))
    raw = table(spark, sf_dir, "events").select(
        "event_id", a.alias("a"), F.concat("event_type", (user % 31).cast("string")).alias("b"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("d"),
    )
    return migrate(raw, ["a", "b"], ["d"], block=F.expr("event_id div 1000"), position="event_id")


_MODELS = (
    "models AS (SELECT user_id % 50 AS service_conf_id, 'run_' || event_id AS run_id, 'model_' || event_type AS name, event_type AS algorithm, "
    "event_id AS version, CASE WHEN event_id % 4 = 0 THEN 'champion' END AS alias, value / 1000 AS accuracy, value / 2000 AS recall, "
    "value / 3000 AS precision, value / 4000 AS f1, ts AS updated_at FROM events)"
)


def model_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("service_conf_id"),
        F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"),
        F.concat(F.lit("model_"), "event_type").alias("name"), F.col("event_type").alias("algorithm"),
        F.col("event_id").alias("version"), F.when(F.col("event_id") % 4 == 0, "champion").alias("alias"),
        (F.col("value") / 1000).alias("accuracy"), (F.col("value") / 2000).alias("recall"),
        (F.col("value") / 3000).alias("precision"), (F.col("value") / 4000).alias("f1"),
        F.col("ts").alias("updated_at"),
    )


@query(f"WITH {_MODELS}\nSELECT service_conf_id, run_id, name, version FROM models "
       "QUALIFY row_number() OVER (PARTITION BY service_conf_id ORDER BY updated_at DESC, version DESC) = 1")
def registry_current(spark, sf_dir):
    return rg.current_models(model_rows(spark, sf_dir)).select("service_conf_id", "run_id", "name", "version")


@query(f"WITH {_MODELS}\nSELECT name, alias, run_id, version FROM models WHERE alias IS NOT NULL "
       "QUALIFY row_number() OVER (PARTITION BY name, alias ORDER BY version DESC) = 1")
def registry_aliases(spark, sf_dir):
    return rg.aliased_models(model_rows(spark, sf_dir)).select("name", "alias", "run_id", "version")


@query(
    f"WITH {_SCORED[:_SCORED.rindex('sc AS')]}{_MODELS}, {_SCORED[_SCORED.rindex('sc AS'):]}, "
    "u AS (SELECT row_id, url, confidence, 'run_' || (row_id * 3) AS model_id, CASE WHEN row_id % 2 = 0 THEN row_id % 10 END AS user_id "
    "FROM sc WHERE status = 'success')\n"
    "SELECT user_id, url, model_id, round(coalesce(accuracy, confidence), 9) AS accuracy_score, round(coalesce(recall, 0), 9) AS recall_score, "
    "round(coalesce(precision, 0), 9) AS precision_score, round(coalesce(f1, 0), 9) AS f1_score "
    "FROM u LEFT JOIN models ON model_id = run_id WHERE user_id IS NOT NULL"
)
def prediction_log(spark, sf_dir):
    scored = scored_corpus(spark, sf_dir).withColumns({
        "model_id": F.concat(F.lit("run_"), (F.col("row_id") * 3).cast("string")),
        "user_id": F.when(F.col("row_id") % 2 == 0, F.col("row_id") % 10),
    })
    log = rg.prediction_log(scored, model_rows(spark, sf_dir)).drop("suggested_desc")
    return log.withColumns({c: F.round(c, 9) for c in log.columns if c.endswith("_score")})


@query(
    f"WITH {_SETTLED}, c AS (SELECT label, count(*) AS n, min(count(*)) OVER () AS lo FROM settled GROUP BY label)\n"
    "SELECT 'r1' AS run_id, 'original_class_count_' || label AS key, n::DOUBLE AS value FROM c "
    "UNION ALL SELECT 'r1', 'balanced_class_count_' || label, lo::DOUBLE FROM c "
    "UNION ALL SELECT 'r1', 'original_dataset_size', sum(n)::DOUBLE FROM c UNION ALL SELECT 'r1', 'balanced_dataset_size', sum(lo)::DOUBLE FROM c "
    "UNION ALL SELECT 'r1', 'original_imbalance_ratio', max(n) / min(n) FROM c UNION ALL SELECT 'r1', 'balanced_imbalance_ratio', 1.0::DOUBLE"
)
def run_metrics(spark, sf_dir):
    before = stored(settled_corpus(spark, sf_dir), "settled")
    return rg.dataset_metrics("r1", before, sa.undersample(before, SEED))


# ---------------------------------------------------------------- queue


def job_lines(spark, sf_dir) -> DataFrame:
    """One message per event: single URLs, URL lists, an empty list, broken text."""
    corpus = url_corpus(spark, sf_dir)
    n = F.col("row_id")
    job = F.struct(
        F.concat(F.lit("job_"), n.cast("string")).alias("job_id"),
        F.when(n % 5 != 1, F.col("url")).alias("url"),
        F.when(n % 5 == 1, F.array("url", F.lit("http://b.example/x"), F.lit(""))).when(
            n % 5 == 2, F.array().cast("array<string>")).alias("urls"),
        (n % 7).alias("user_id"),
    )
    text = F.when(n % 11 == 0, F.concat(F.lit("{broken "), n.cast("string"))).otherwise(F.to_json(job))
    return corpus.select("row_id", text.alias("value"))


_JOBS = (
    "jobs AS (SELECT row_id, url, CASE WHEN row_id % 11 = 0 THEN md5(concat('{broken ', row_id)) ELSE 'job_' || row_id END AS job_id, "
    "CASE WHEN row_id % 11 = 0 THEN 'Malformed job message' END AS bad, row_id % 5 = 1 AS many, row_id % 5 = 2 AS none FROM corpus)"
)


@query(
    f"WITH {fs.CORPUS}, {_JOBS}, t AS (SELECT job_id, url, many FROM jobs WHERE bad IS NULL AND NOT none "
    "UNION ALL SELECT job_id, 'http://b.example/x', many FROM jobs WHERE bad IS NULL AND many "
    "UNION ALL SELECT job_id, '', many FROM jobs WHERE bad IS NULL AND many), "
    "s AS (SELECT job_id, many, url <> '' AND NOT (contains(url, '[') AND NOT contains(url, '://')) AS ok FROM t), "
    "g AS (SELECT job_id, many, count(*) AS total, count(*) FILTER (WHERE ok) AS successful FROM s GROUP BY ALL)\n"
    "SELECT job_id, CASE WHEN many OR successful > 0 THEN 'success' ELSE 'failed' END AS status, total, successful, "
    "total - successful AS failed FROM g"
)
def job_results(spark, sf_dir):
    """Messages parsed, exploded, judged and grouped back to job results."""
    jobs = wk.parse_jobs(job_lines(spark, sf_dir).select("value")).where("bad IS NULL")
    urls = wk.job_urls(jobs)
    parts = add_url_parts(urls, "url", "_")
    judged = parts.withColumn("status", sc.url_status(F.col("url"), F.col("_is_valid_url")))
    return wk.job_results(judged).select("job_id", "status", "total", "successful", "failed")


@query(
    f"WITH {fs.CORPUS}, {_JOBS}\nSELECT CASE WHEN row_id % 4 = 0 THEN 'training' ELSE 'prediction' END AS queue, count(*) AS job_count "
    "FROM jobs WHERE row_id % 3 <> 0 GROUP BY 1"
)
def queue_depth(spark, sf_dir):
    jobs = job_lines(spark, sf_dir).withColumn("j", F.col("row_id"))
    parsed = wk.parse_jobs(jobs.select("value")).select("value", "job_id")
    parsed = parsed.join(jobs, "value").withColumn(
        "queue", F.when(F.col("j") % 4 == 0, "training").otherwise("prediction"))
    return wk.queue_depth(parsed, parsed.where("j % 3 = 0"))


def scratch(spark, name: str) -> str:
    """A new folder in the cluster's shared folder; a local one only if unset."""
    import uuid

    root = shared_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query()
def stream_scoring(spark, sf_dir):
    """The prediction worker over all messages of the corpus: results per URL."""
    from ..sources.artifacts import save_model

    root = scratch(spark, "stream")
    model, classes = _quick_model(spark, sf_dir)
    save_model(model, spark, f"{root}/models", "quick", "decision_tree", classes)
    job_lines(spark, sf_dir).select("value").write.text(f"{root}/{wk.PREDICTION_QUEUE}")
    wk.prediction_worker(spark, root, root, default_model="quick").awaitTermination()
    done = spark.read.parquet(f"{root}/{wk.RESULT_QUEUE}/predictions")
    return done.select("job_id", "url", "status", "class", F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- selection


@query(
    f"WITH {fs.with_features(_NUM)}, long AS (UNPIVOT (SELECT {', '.join(_NUM)} FROM feats) ON COLUMNS(*) INTO NAME feature VALUE v)\n"
    "SELECT feature, round(var_pop(v), 4) AS variance FROM long GROUP BY feature"
)
def feature_variance(spark, sf_dir):
    df = add_features(url_corpus(spark, sf_dir), apply_weights=False)
    return se.variances(df, _NUM).withColumn("variance", F.round("variance", 4))


_FLAGS = [n for g in catalog.GROUPS.values() for n, kind in g if kind == "binary"]


@query(
    f"WITH {fs.with_features(_FLAGS)}, x AS (SELECT {_normal('label')} AS y, {', '.join(_FLAGS)} FROM feats), "
    f"long AS (UNPIVOT x ON {', '.join(_FLAGS)} INTO NAME feature VALUE v), "
    "c AS (SELECT feature, v, y, count(*)::DOUBLE AS n FROM long GROUP BY ALL), "
    "t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, v) AS nb, "
    "sum(n) OVER (PARTITION BY feature, y) AS nl FROM c)\n"
    "SELECT feature, round(sum(n / t * ln(n * t / (nb * nl))), 9) + 0.0 AS mi FROM t GROUP BY feature"
)
def flag_information(spark, sf_dir):
    """Mutual information of every flag with the label."""
    df = add_features(url_corpus(spark, sf_dir), apply_weights=False)
    mi = se.flag_information(df.select(normalize_label(F.col("label")).alias("label"), *_FLAGS), _FLAGS)
    return mi.withColumn("mi", F.round("mi", 9) + F.lit(0.0))


_PLAIN = ", ".join(f"round({f}, 9)::DOUBLE AS {f}" if f in ENTROPIES else f"{f}::DOUBLE AS {f}" for f in catalog.FEATURES)


def _plain_features(spark, sf_dir) -> DataFrame:
    df = add_features(url_corpus(spark, sf_dir), apply_weights=False)
    return _rounded(df).withColumn("label", normalize_label(F.col("label")))


@query(
    f"WITH {fs.with_features(catalog.FEATURES)}, x AS (SELECT {_normal('label')} AS y, {_PLAIN} FROM feats), "
    "long AS (UNPIVOT x ON COLUMNS(* EXCLUDE y) INTO NAME feature VALUE v), "
    "placed AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS i, count(*) OVER (PARTITION BY feature) AS n FROM long), "
    "cuts AS (SELECT feature, list(v) AS cuts FROM placed, range(1, 10) ks(k) WHERE i = (k * n + 9) // 10 GROUP BY feature), "
    "c AS (SELECT feature, len(list_filter(cuts, lambda c: c < v)) AS bin, y, count(*)::DOUBLE AS n FROM long JOIN cuts USING (feature) GROUP BY ALL), "
    "t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, "
    "sum(n) OVER (PARTITION BY feature, y) AS nl FROM c)\n"
    "SELECT feature, round(sum(n / t * ln(n * t / (nb * nl))), 9) + 0.0 AS mi FROM t GROUP BY feature"
)
def feature_information(spark, sf_dir):
    """Mutual information of all features, in ten bins by exact quantiles."""
    mi = se.mutual_information(_plain_features(spark, sf_dir))
    return mi.withColumn("mi", F.round("mi", 9) + F.lit(0.0))


_PAIRS = ", ".join(
    f"{{'feature_a': '{a}', 'feature_b': '{b}', 'r': CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN round(corr({a}, {b}), 6) + 0.0 END}}"
    for i, a in enumerate(catalog.FEATURES) for b in catalog.FEATURES[i + 1 :]
)


@query(
    f"WITH {fs.with_features(catalog.FEATURES)}, x AS MATERIALIZED (SELECT {_PLAIN} FROM feats), p AS (SELECT unnest([{_PAIRS}]) AS p FROM x)\n"
    "SELECT p.feature_a AS feature_a, p.feature_b AS feature_b, p.r AS r FROM p"
)
def feature_correlation(spark, sf_dir):
    """Correlation of each two features."""
    return se.correlations(stored(_plain_features(spark, sf_dir), "features")).withColumn("r", F.round("r", 6) + F.lit(0.0))


# ---------------------------------------------------------------- flagship


@query(
    f"WITH {fs.with_features(catalog.FEATURES, catalog.default_weights())},\n"
    f"lab AS (SELECT url, {_normal('label')} AS label FROM feats),\n"
    "kept AS (SELECT url, min(label) AS label FROM lab GROUP BY url HAVING min(label) = max(label)),\n"
    f"one AS (SELECT DISTINCT url, {_ALL} FROM feats),\n"
    f"x AS (SELECT kept.label, {_ALL} FROM kept JOIN one USING (url)),\n"
    f"long AS (UNPIVOT x ON {_ALL} INTO NAME feature VALUE v)\n"
    "SELECT feature, count(*) FILTER (WHERE label = 'benign') AS n_benign, count(*) FILTER (WHERE label = 'malicious') AS n_malicious, "
    "round(avg(v) FILTER (WHERE label = 'benign'), 6) AS mean_benign, round(avg(v) FILTER (WHERE label = 'malicious'), 6) AS mean_malicious "
    "FROM long GROUP BY feature"
)
def class_profile(spark, sf_dir):
    """Flagship: corpus, curation, all features, class means per feature."""
    df = add_features(settled_corpus(spark, sf_dir))
    label = F.col("label")
    stats = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.round(F.avg(F.when(label == "benign", F.col(f))), 6).alias("mean_benign"),
            F.round(F.avg(F.when(label == "malicious", F.col(f))), 6).alias("mean_malicious"),
        )
        for f in catalog.FEATURES
    ])
    row = df.agg(F.count_if(label == "benign").alias("n_benign"), F.count_if(label == "malicious").alias("n_malicious"), stats.alias("s"))
    return row.select(F.explode("s").alias("s"), "n_benign", "n_malicious").select(
        "s.feature", "n_benign", "n_malicious", "s.mean_benign", "s.mean_malicious"
    )
