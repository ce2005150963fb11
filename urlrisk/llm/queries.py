"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm import bisector, chat, divergence, language, line_rules, mixing, near_dedup, packing, quality, topk, toxicity, url_filter, warc
from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import fold

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Both texts of conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, min_payload=0, scratch=scratch)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(_table(spark, sf_dir, "documents"), capacity=2048)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), near_dedup.Forest(words=4, percent=80))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return _predictions(toxicity.score(docs, model, ["doc_id"]), 5, 0, 0.5)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language.prototypes(docs, fold(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return language.identify(docs, profiles, carry=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return _predictions(toxicity.score(docs, model, ["doc_id"]), 5, 0, 0.3)


def _predictions(scored: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, weights=(1, 2, 3), share=1.0, most=3).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.clean_lines(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector.cluster(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, t, role, CONTROL_TEXT) for t, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_warc_revisits, op3_best_fit_packing, op4_near_duplicates, op5_toxicity, op6_language,
        op7_quality, op8_top_k, op9_source_mix, op10_line_rules, op11_bisector_clusters, op12_source_divergence,
        op13_chat_format,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
rests AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT row_number() OVER () AS i, page_id,
         coalesce({_ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rests),
best AS (
  SELECT i, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY i ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS k
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (i)"""


_OP2_SQL = """
WITH heads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
  SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest
  FROM heads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM named)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM firsts"""

_OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4
      THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id),
named AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id))
SELECT *, component_id = doc_id AS kept FROM named"""

_OP8_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


def _op10_sql() -> str:
    rules = line_rules.LineRules()
    menu = ", ".join("'" + x.decode() + "'" for x in sorted(line_rules.MENU))
    phrases = " OR ".join(f"contains(low, '{x.decode()}')" for x in line_rules.BOILERPLATE)
    between = ", ".join("'" + x.decode() + "'" for x in sorted(line_rules.SEPARATORS))
    bullets = ", ".join("'" + x.decode() + "'" for x in sorted(line_rules.BULLETS & line_rules.SEPARATORS))
    marks = line_rules.MARKS.decode().replace("'", "''")
    twice = "|".join("[" + ("\\" + x if x in "^]\\-[" else x) + "]{2}" for x in line_rules.MARKS.decode()).replace("'", "''")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
cut AS (SELECT i, string_split(text, chr(10)) AS parts FROM docs),
lines AS (SELECT i, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS k FROM cut),
split AS (SELECT i, k, line, {_WORDS.format("line")} AS w FROM lines),
texts AS (
  SELECT i, k, line, len(w) AS n, length(array_to_string(w, '')) AS chars, {_ASCII_LOWER.format("array_to_string(w, ' ')")} AS low,
         len(list_filter(w, lambda x: list_contains([{between}], x))) - (len(w) > 1 AND w[1] IN ({bullets}))::BIGINT AS separators,
         len(list_filter(w, lambda x: regexp_matches(x, '([#*$%&|<>][#*$%&|<>]|{twice})$'))) AS marked,
         length(line) - length(translate(line, '{marks}', '')) AS marks
  FROM split WHERE len(w) > 0),
judged AS (
  SELECT i, chars, row_number() OVER (PARTITION BY i, line ORDER BY k) > 1 AS again,
         (n >= 3 AND separators >= {rules.separator_share} * n) OR trim(low, '.:!>|') IN ({menu})
         OR (n <= {rules.boilerplate_words} AND ({phrases})) OR (n >= 3 AND marked > {rules.symbol_share} * n)
         OR (chars >= {rules.mark_chars} AND marks > {rules.mark_share} * chars) AS fails
  FROM texts),
by_lines AS (
  SELECT i, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY i),
windows AS (
  SELECT i, unnest(range(1, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2])) AS s
  FROM docs WHERE len(w) >= 3),
twice AS (SELECT i, pos FROM (SELECT i, pos, count(*) OVER (PARTITION BY i, s) AS c FROM windows) WHERE c > 1),
repeats AS (
  SELECT i, count(DISTINCT p) AS n_repeat_words FROM (SELECT i, unnest([pos, pos + 1, pos + 2]) AS p FROM twice) GROUP BY i),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM docs LEFT JOIN by_lines USING (i) LEFT JOIN repeats USING (i))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {rules.max_lost} * word_chars AS kept
FROM counts"""


def _op11_sql() -> str:
    s = bisector.Settings()

    def nearest(c: str) -> str:
        away = f"list_sum(list_transform(range(1, {s.dims + 1}), lambda j: (r.v[j] - c.v[j]) * (r.v[j] - c.v[j])))::BIGINT"
        return f"SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r.i, c.c, {away} AS d FROM r, {c} c) GROUP BY i"

    steps = []
    for n in range(s.rounds):
        steps.append(f"""
a{n} AS ({nearest(f"c{n}")}),
m{n} AS (
  SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY j) AS v FROM (
    SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM (SELECT c, unnest(range(1, {s.dims + 1})) AS j, unnest(v) AS x FROM a{n} JOIN r USING (i)) GROUP BY c, j) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m{n}.v, p.v) AS v FROM c0 JOIN c{n} p USING (c) LEFT JOIN m{n} USING (c))""")
    return f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({s.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {s.dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{s.seed}:' || vec_id), v) - 1 AS c, v FROM r
  QUALIFY row_number() OVER (ORDER BY sha256('{s.seed}:' || vec_id), v) <= {s.clusters}),{",".join(steps)},
last AS ({nearest(f"c{s.rounds}")})
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{s.rounds}.v, ',')) AS centroid_sha256
FROM last JOIN r USING (i) JOIN c{s.rounds} USING (c)"""


def _op12_sql() -> str:
    s = divergence.Settings()
    unit, prior = divergence.UNIT, divergence.PRIOR
    p = f"(1 + ({unit}::HUGEINT * ({{}} + {prior})) // ({{}} + {prior} * v))::BIGINT"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (
  SELECT d, lang, source, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= {s.least_documents}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM terms GROUP BY lang, source, term),
grps AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, all_n, v, lang_total, (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source))::HUGEINT AS total
  FROM grps JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)),
ps AS (SELECT lang, source, term, n, {p.format("n", "total")} AS p, {p.format("all_n", "lang_total")} AS q FROM grid),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS f
  FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM ps WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {s.top_terms}"""


def _op13_sql() -> str:
    escape = "{}"
    for control in ("\\", *chat.CONTROLS):
        into = control * 2 if control == "\\" else control[0] + "\\" + control[1:]
        escape = f"replace({escape}, '{control}', '{into}')"
    marks = len(chat.BEGIN) + len(chat.MIDDLE) + len(chat.END)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length({escape.format("role")}) + length({escape.format("text")}) + {marks} AS chars FROM turns),
running AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM running GROUP BY conv_id"""


#: Tokenization (3), trained models (5, 6, 7) and hashed draws (9) are beyond SQL; tests
#: hold them against brute force or held-out labels.
SQL: dict[str, str] = {
    "op1_url_filter": _op1_sql(),
    "op2_warc_revisits": _OP2_SQL,
    "op4_near_duplicates": _OP4_SQL,
    "op8_top_k": _OP8_SQL,
    "op10_line_rules": _op10_sql(),
    "op11_bisector_clusters": _op11_sql(),
    "op12_source_divergence": _op12_sql(),
    "op13_chat_format": _op13_sql(),
}
