"""The URL feature projection.

``add_features`` is a chain of narrow projections; nothing shuffles unless a
dictionary is too large to inline. Expensive values (parts, entropies, runs) are
computed once in their own step and reused by the flags, and Catalyst prunes
what the requested groups do not need.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import textstats as ts
from ..functions.matching import contains_any, flag
from ..functions.urlparts import add_url_parts, longest_field, query_fields, rebuilt_url
from ..functions.wordlists import (
    EXECUTABLE_EXTENSIONS,
    REDIRECT_PARAMS,
    SUSPICIOUS_EXTENSIONS,
    SUSPICIOUS_KEYWORDS,
    Dictionaries,
    homograph_class,
)
from .dictionary_join import LISTS, add_list_masks

P = "_u_"  # prefix of working columns


def _w(name: str) -> Column:
    return F.col(P + name)


def _ends_with_any(text: Column, endings) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.endswith(text, F.lit(e)) for e in endings])


def _working_columns(df: DataFrame, url: str) -> DataFrame:
    """Parts, tokens, counts, entropies and runs that the features share.

    Two steps. The first is small enough for one generated method that the JVM
    compiles. The second holds higher-order functions, which keeps it out of
    whole-stage code; Spark then splits it into many small methods. Fusing all
    of it into one method would pass the JVM's size limit for compilation and
    run interpreted, several times slower.
    """
    df = df.withColumn(P + "url", F.coalesce(F.col(url), F.lit("")))
    df = add_url_parts(df, url, P)
    u, host, path, query = _w("url"), _w("netloc"), _w("path"), _w("query")
    df = df.withColumns(
        {
            P + "full": F.lower(rebuilt_url(P)),
            P + "lower_host": F.lower(host),
            P + "lower_query": F.lower(query),
            P + "host_tokens": F.split(host, r"\."),
            P + "label": F.substring_index(host, ".", 1),
            P + "path_tokens": F.array_remove(F.split(path, "/"), ""),
            P + "n": F.length(u),
            P + "host_n": F.length(host),
            P + "path_n": F.length(path),
            P + "query_n": F.length(query),
        }
    )
    label, tokens = _w("label"), _w("path_tokens")
    long_label = F.length(label) >= 8
    return df.withColumns(
        {
            P + "digits": ts.digit_count(u),
            P + "letters": ts.letter_count(u),
            P + "host_digits": ts.digit_count(host),
            P + "path_digits": ts.digit_count(path),
            P + "query_digits": ts.digit_count(query),
            P + "label_letters": ts.letter_count(F.lower(label)),
            P + "run_digit": ts.longest_digit_run(u),
            P + "run_letter": ts.longest_letter_run(u),
            P + "run_special": ts.longest_special_run(u),
            P + "entropy": ts.entropy(u),
            P + "host_entropy": ts.entropy(host),
            P + "path_entropy": ts.entropy(path),
            P + "query_entropy": ts.entropy(query),
            P + "label_entropy": F.when(long_label, ts.settled(ts.entropy(label))).otherwise(0.0),
            P + "host_longest": ts.longest(_w("host_tokens")),
            P + "path_longest": ts.longest(tokens),
            P + "path_count": F.size(tokens),
            P + "filename": F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit("")),
            P + "fields": F.when(F.contains(query, F.lit("=")), query_fields(query)).otherwise(
                F.array().cast("array<struct<k:string,v:string>>")
            ),
        }
    )


def _url_level(d: Dictionaries) -> dict[str, Column]:
    u, n, digits, letters = _w("url"), _w("n"), _w("digits"), _w("letters")
    special = n - digits - letters
    h = ts.settled(_w("entropy"))
    runs = _w("run_digit") + _w("run_letter") + _w("run_special")
    return {
        "http_token": flag(F.startswith(u, F.lit("http://"))),
        "url_length": n,
        "dot_count": ts.count_of(u, "."),
        "hyphen_count": ts.count_of(u, "-"),
        "slash_count": ts.count_of(u, "/"),
        "at_symbol_count": ts.count_of(u, "@"),
        "percent_count": ts.count_of(u, "%"),
        "special_char_count": special,
        "digit_ratio": ts.ratio(digits, n),
        "letter_ratio": ts.ratio(letters, n),
        "special_char_ratio": ts.ratio(special, n),
        "longest_digit_sequence": _w("run_digit"),
        "longest_letter_sequence": _w("run_letter"),
        "longest_special_sequence": _w("run_special"),
        "character_continuity_rate": ts.ratio(runs, n),
        "url_entropy": _w("entropy"),
        "low_entropy": flag(h < 3.0),
        "high_entropy": flag(h > 4.0),
        "long_url_length": flag(n > 100),
        "high_digit_ratio": flag(ts.ratio(digits, n) > 0.3),
        "low_special_char_ratio": flag(ts.ratio(special, n) < 0.05),
    }


def _domain_level(d: Dictionaries) -> dict[str, Column]:
    host, lower, n = _w("netloc"), _w("lower_host"), _w("host_n")
    tokens = F.size(_w("host_tokens"))
    subdomains = F.greatest(F.lit(0), tokens - 2)
    is_ip = host.rlike(r"\A(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}\z")
    label, lower_label = _w("label"), F.lower(_w("label"))
    label_letters = _w("label_letters")
    vowels = F.length(F.regexp_replace(lower_label, "[^aeiou]+", ""))
    vowel_share = vowels / label_letters
    h = _w("label_entropy")
    return {
        "domain_length": n,
        "domain_token_count": tokens,
        "subdomain_count": subdomains,
        "digit_ratio_domain": ts.ratio(_w("host_digits"), n),
        "hyphen_count_domain": ts.count_of(host, "-"),
        "longest_domain_token": _w("host_longest"),
        "avg_domain_token_length": (n - ts.count_of(host, ".")).cast("double") / tokens,
        "domain_entropy": _w("host_entropy"),
        "ip_address_flag": flag(is_ip),
        "multiple_subdomain_flag": flag(subdomains > 1),
        "brand_keyword_flag": _listed(d, "brand_keyword", lambda words: contains_any(lower, words)),
        "port_in_url_flag": flag(F.contains(host, F.lit(":")) & ~is_ip),
        "https_in_domain": flag(F.contains(lower, F.lit("https"))),
        "tld_suspicious_flag": _listed(
            d, "suspicious_tld", lambda words: F.lower(F.substring_index(host, ".", -1)).isin(*words)
        ),
        "shortening_service_flag": _listed(d, "sorted_url", lambda words: contains_any(lower, words)),
        "double_slash_redirecting": flag(F.contains(_w("path"), F.lit("//"))),
        "punycode_domain_flag": flag(F.contains(host, F.lit("xn--"))),
        "unicode_domain_flag": flag(~ts.is_ascii(host)),
        "homograph_suspicious_flag": flag(~ts.is_ascii(host) & host.rlike(homograph_class())),
        "excessive_subdomain_depth": F.greatest(F.lit(0), subdomains - 4),
        "random_string_domain_flag": flag((F.length(label) >= 8) & (h > 3.5)),
        "free_hosting_domain_flag": _listed(d, "free_hosting", lambda words: contains_any(lower, words)),
        "dga_domain_flag": flag(
            (F.length(label) >= 10)
            & (h > 3.8)
            & (label_letters > vowels)
            & ((vowel_share < 0.2) | (vowel_share > 0.6))
        ),
        "non_standard_port_flag": _listed(
            d, "non_standard_port", lambda words: F.contains(host, F.lit(":")) & F.substring_index(host, ":", -1).isin(*words)
        ),
        "high_domain_entropy": flag(ts.settled(_w("host_entropy")) > 3.8),
    }


def _listed(d: Dictionaries, name: str, inline) -> Column:
    """Inline match for a list of words; the bit of the joined mask for a table."""
    words = getattr(d, name)
    if not isinstance(words, DataFrame):
        return flag(inline(words))
    kind, bit = LISTS[name]
    mask = _w("query_mask" if kind == "query" else "host_mask")
    return flag(mask.bitwiseAND(F.lit(1 << bit)) != 0)


def _path_level(d: Dictionaries) -> dict[str, Column]:
    path, n, count, name = _w("path"), _w("path_n"), _w("path_count"), _w("filename")
    return {
        "path_length": n,
        "path_token_count": count,
        "digit_ratio_path": ts.ratio(_w("path_digits"), n),
        "dot_count_path": ts.count_of(path, "."),
        "longest_path_token": _w("path_longest"),
        "avg_path_token_length": ts.ratio(n - ts.count_of(path, "/"), count),
        "path_entropy": _w("path_entropy"),
        "filename_length": F.length(name),
        "suspicious_extension_flag": flag(_ends_with_any(name, SUSPICIOUS_EXTENSIONS)),
        "executable_extension_flag": flag(_ends_with_any(name, EXECUTABLE_EXTENSIONS)),
        "suspicious_js_extension_flag": flag(
            F.endswith(path, F.lit(".js")) | F.contains(_w("full"), F.lit("javascript:"))
        ),
    }


def _query_level(d: Dictionaries) -> dict[str, Column]:
    query, lower, n, full = _w("query"), _w("lower_query"), _w("query_n"), _w("full")
    fields = _w("fields")
    some = F.size(fields) > 0
    keys = F.array_distinct(F.transform(fields, lambda f: f["k"]))
    key_count = F.when(some, F.size(keys)).otherwise(0)
    total = F.aggregate(keys, F.lit(0), lambda a, k: a + F.length(k)) + F.aggregate(
        fields, F.lit(0), lambda a, f: a + F.length(f["v"])
    )
    return {
        "query_length": n,
        "parameter_count": key_count,
        "digit_ratio_query": ts.ratio(_w("query_digits"), n),
        "equal_count_query": ts.count_of(query, "="),
        "ampersand_count_query": ts.count_of(query, "&"),
        "avg_parameter_length": F.when(some, total.cast("double") / F.size(keys)).otherwise(0.0),
        "max_parameter_length": F.when(some, longest_field(fields)).otherwise(0),
        "query_entropy": _w("query_entropy"),
        "encoded_url_flag": flag(F.contains(query, F.lit("%"))),
        "redirect_parameter_flag": flag(contains_any(lower, REDIRECT_PARAMS)),
        "script_in_url_flag": flag(F.contains(full, F.lit("script"))),
        "auto_download_param_flag": _listed(d, "auto_download_params", lambda words: contains_any(lower, words)),
        "base64_in_url_flag": flag(full.rlike(r"[\p{Alnum}+/]{20}")),
    }


def _pattern_level(d: Dictionaries) -> dict[str, Column]:
    u = _w("url")
    return {
        "mixed_token_flag": flag(u.rlike(r"\p{Alpha}\p{Nd}|\p{Digit}\p{Alpha}")),
        "hex_encoding_flag": flag(u.rlike(r"%\p{XDigit}{2}")),
        "obfuscation_pattern_flag": flag(u.rlike(r"\p{Alnum}{20}")),
    }


def _optional(d: Dictionaries) -> dict[str, Column]:
    u, n, host, path = _w("url"), _w("n"), _w("netloc"), _w("path")
    shortest = lambda tokens: F.coalesce(
        F.array_min(F.transform(tokens, F.length)), F.lit(0)
    )
    fields = _w("fields")
    # The structural ratios divide by the length of the URL with its scheme.
    full_n = F.when(F.contains(u, F.lit("://")), n).otherwise(n + 7)
    return {
        "domain_url_ratio": ts.ratio(_w("host_n"), full_n),
        "path_url_ratio": ts.ratio(_w("path_n"), full_n),
        "suspicious_keywords_flag": flag(contains_any(F.lower(u), SUSPICIOUS_KEYWORDS)),
        "underscore_count": ts.count_of(u, "_"),
        "question_mark_count": ts.count_of(u, "?"),
        "equal_count": ts.count_of(u, "="),
        "ampersand_count": ts.count_of(u, "&"),
        "hashtag_count": ts.count_of(u, "#"),
        "digit_count": _w("digits"),
        "letter_count": _w("letters"),
        "tld_length": F.length(F.substring_index(host, ".", -1)),
        "digit_count_domain": _w("host_digits"),
        "dot_count_domain": ts.count_of(host, "."),
        "special_char_domain": _w("host_n") - _w("host_digits") - ts.letter_count(host),
        "max_domain_token_length": _w("host_longest"),
        "min_domain_token_length": shortest(_w("host_tokens")),
        "slash_count_path": ts.count_of(path, "/"),
        "digit_count_path": _w("path_digits"),
        "hyphen_count_path": ts.count_of(path, "-"),
        "max_path_token_length": _w("path_longest"),
        "min_path_token_length": shortest(_w("path_tokens")),
        "digit_count_query": _w("query_digits"),
        "min_parameter_length": F.when(
            F.size(fields) > 0, longest_field(fields, shortest=True)
        ).otherwise(0),
        "query_url_ratio": ts.ratio(_w("query_n"), full_n),
        "repeated_character_flag": ts.repeated_character_flag(u),
    }


_LEVELS = (
    (_url_level, ("url_level", "url_level_thresholds")),
    (_domain_level, ("domain_level",)),
    (_path_level, ("path_level",)),
    (_query_level, ("query_level",)),
    (_pattern_level, ("pattern_features",)),
    (_optional, tuple(catalog.OPTIONAL_GROUPS)),
)


_LIST_FLAGS = {
    "free_hosting": "free_hosting_domain_flag", "sorted_url": "shortening_service_flag", "brand_keyword": "brand_keyword_flag",
    "suspicious_tld": "tld_suspicious_flag", "non_standard_port": "non_standard_port_flag", "auto_download_params": "auto_download_param_flag",
}


def add_features(
    df: DataFrame,
    url: str = "url",
    groups=None,
    disabled=(),
    weights: dict[str, float] | None = None,
    apply_weights: bool = True,
    soft_class: str | None = None,
    dictionaries: Dictionaries | None = None,
    zero_invalid: bool = True,
    keep_validity: bool = True,
) -> DataFrame:
    """Append the features of the enabled groups as DOUBLE columns.

    weights: overrides of the default emphasis weights (feature -> factor).
    soft_class: also multiply that class's emphasised features by 1.2.
    zero_invalid: an URL whose authority is malformed gets 0 everywhere, as in
    training; otherwise its values are NULL and ``is_valid_url`` tells why.
    """
    d = dictionaries or Dictionaries()
    names = catalog.feature_names(groups, disabled)
    carried = df.columns
    # Large lists are matched first, while rows are narrow.
    large = {n: getattr(d, n) for n, feature in _LIST_FLAGS.items() if feature in names and isinstance(getattr(d, n), DataFrame)}
    work = _working_columns(add_list_masks(df, url, large, P) if large else df, url)

    exprs: dict[str, Column] = {}
    for level, of_groups in _LEVELS:
        if any(name in names for g in of_groups for name, _ in catalog.ALL_GROUPS[g]):
            exprs.update(level(d))
    catalog.check_declared(exprs)

    factors = {**(catalog.default_weights() if apply_weights else {}), **(weights or {})}
    if soft_class in catalog.EMPHASIS:
        for name in catalog.EMPHASIS[soft_class][1]:
            factors[name] = factors.get(name, 1.0) * catalog.SOFT_EMPHASIS

    def finished(name: str) -> Column:
        value = exprs[name].cast("double")
        if factors.get(name, 1.0) != 1.0:
            value = value * F.lit(float(factors[name]))
        when_valid = F.when(_w("is_valid_url"), value)
        return (when_valid.otherwise(F.lit(0.0)) if zero_invalid else when_valid).alias(name)

    validity = [_w("is_valid_url").alias("is_valid_url")] if keep_validity else []
    return work.select(*carried, *validity, *[finished(n) for n in names])
