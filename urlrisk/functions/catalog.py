"""The feature catalog: names, groups, types and emphasis weights, in fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Group -> (feature, type). Order is the column order of every
# feature table.
GROUPS: dict[str, tuple[tuple[str, str], ...]] = {
    "url_level": (
        ("http_token", "binary"),
        ("url_length", "numeric"),
        ("dot_count", "numeric"),
        ("hyphen_count", "numeric"),
        ("slash_count", "numeric"),
        ("at_symbol_count", "numeric"),
        ("percent_count", "numeric"),
        ("special_char_count", "numeric"),
        ("digit_ratio", "ratio"),
        ("letter_ratio", "ratio"),
        ("special_char_ratio", "ratio"),
        ("longest_digit_sequence", "numeric"),
        ("longest_letter_sequence", "numeric"),
        ("longest_special_sequence", "numeric"),
        ("character_continuity_rate", "ratio"),
        ("url_entropy", "numeric"),
    ),
    "url_level_thresholds": (
        ("low_entropy", "binary"),
        ("high_entropy", "binary"),
        ("long_url_length", "binary"),
        ("high_digit_ratio", "binary"),
        ("low_special_char_ratio", "binary"),
    ),
    "domain_level": (
        ("domain_length", "numeric"),
        ("domain_token_count", "numeric"),
        ("subdomain_count", "numeric"),
        ("digit_ratio_domain", "ratio"),
        ("hyphen_count_domain", "numeric"),
        ("longest_domain_token", "numeric"),
        ("avg_domain_token_length", "numeric"),
        ("domain_entropy", "numeric"),
        ("ip_address_flag", "binary"),
        ("multiple_subdomain_flag", "binary"),
        ("brand_keyword_flag", "binary"),
        ("port_in_url_flag", "binary"),
        ("https_in_domain", "binary"),
        ("tld_suspicious_flag", "binary"),
        ("shortening_service_flag", "binary"),
        ("double_slash_redirecting", "binary"),
        ("punycode_domain_flag", "binary"),
        ("unicode_domain_flag", "binary"),
        ("homograph_suspicious_flag", "binary"),
        ("excessive_subdomain_depth", "numeric"),
        ("random_string_domain_flag", "binary"),
        ("free_hosting_domain_flag", "binary"),
        ("dga_domain_flag", "binary"),
        ("non_standard_port_flag", "binary"),
        ("high_domain_entropy", "binary"),
    ),
    "path_level": (
        ("path_length", "numeric"),
        ("path_token_count", "numeric"),
        ("digit_ratio_path", "ratio"),
        ("dot_count_path", "numeric"),
        ("longest_path_token", "numeric"),
        ("avg_path_token_length", "numeric"),
        ("path_entropy", "numeric"),
        ("filename_length", "numeric"),
        ("suspicious_extension_flag", "binary"),
        ("executable_extension_flag", "binary"),
        ("suspicious_js_extension_flag", "binary"),
    ),
    "query_level": (
        ("query_length", "numeric"),
        ("parameter_count", "numeric"),
        ("digit_ratio_query", "ratio"),
        ("equal_count_query", "numeric"),
        ("ampersand_count_query", "numeric"),
        ("avg_parameter_length", "numeric"),
        ("max_parameter_length", "numeric"),
        ("query_entropy", "numeric"),
        ("encoded_url_flag", "binary"),
        ("redirect_parameter_flag", "binary"),
        ("script_in_url_flag", "binary"),
        ("auto_download_param_flag", "binary"),
        ("base64_in_url_flag", "binary"),
    ),
    "pattern_features": (
        ("mixed_token_flag", "binary"),
        ("hex_encoding_flag", "binary"),
        ("obfuscation_pattern_flag", "binary"),
    ),
}

# Further groups that are computed only when asked for by name.
OPTIONAL_GROUPS: dict[str, tuple[tuple[str, str], ...]] = {
    "structural_ratios": (
        ("domain_url_ratio", "ratio"),
        ("path_url_ratio", "ratio"),
    ),
    "suspicious_keywords": (("suspicious_keywords_flag", "binary"),),
    "extended": (
        ("underscore_count", "numeric"),
        ("question_mark_count", "numeric"),
        ("equal_count", "numeric"),
        ("ampersand_count", "numeric"),
        ("hashtag_count", "numeric"),
        ("digit_count", "numeric"),
        ("letter_count", "numeric"),
        ("tld_length", "numeric"),
        ("digit_count_domain", "numeric"),
        ("dot_count_domain", "numeric"),
        ("special_char_domain", "numeric"),
        ("max_domain_token_length", "numeric"),
        ("min_domain_token_length", "numeric"),
        ("slash_count_path", "numeric"),
        ("digit_count_path", "numeric"),
        ("hyphen_count_path", "numeric"),
        ("max_path_token_length", "numeric"),
        ("min_path_token_length", "numeric"),
        ("digit_count_query", "numeric"),
        ("min_parameter_length", "numeric"),
        ("query_url_ratio", "ratio"),
        ("repeated_character_flag", "binary"),
    ),
}

# Emphasis per class; a feature in both takes the larger weight.
EMPHASIS: dict[str, tuple[float, tuple[str, ...]]] = {
    "benign": (1.5, ("low_entropy", "low_special_char_ratio")),
    "malicious": (
        2.0,
        (
            "http_token",
            "ip_address_flag",
            "executable_extension_flag",
            "high_domain_entropy",
            "high_digit_ratio",
            "hex_encoding_flag",
            "multiple_subdomain_flag",
            "hyphen_count_domain",
            "at_symbol_count",
            "encoded_url_flag",
            "redirect_parameter_flag",
            "long_url_length",
            "port_in_url_flag",
            "shortening_service_flag",
            "tld_suspicious_flag",
            "punycode_domain_flag",
            "dga_domain_flag",
            "base64_in_url_flag",
            "script_in_url_flag",
        ),
    ),
}
# Fixed value: multiplier of the optional per-class soft emphasis.
SOFT_EMPHASIS = 1.2

ALL_GROUPS = {**GROUPS, **OPTIONAL_GROUPS}
FEATURES = [name for members in GROUPS.values() for name, _ in members]


def feature_names(groups=None, disabled=()) -> list[str]:
    """Features of the enabled groups in catalog order (default: the 73)."""
    enabled = list(GROUPS) if groups is None else list(groups)
    unknown = [g for g in [*enabled, *disabled] if g not in ALL_GROUPS]
    if unknown:
        raise ValueError(f"Unknown feature group(s): {', '.join(unknown)}")
    return [
        name
        for group, members in ALL_GROUPS.items()
        if group in enabled and group not in disabled
        for name, _ in members
    ]


def default_weights() -> dict[str, float]:
    weights: dict[str, float] = {}
    for weight, names in EMPHASIS.values():
        for name in names:
            weights[name] = max(weight, weights.get(name, weight))
    return weights


def check_declared(produced) -> None:
    """Raise when a produced feature is not in the catalog."""
    declared = {name for members in ALL_GROUPS.values() for name, _ in members}
    undeclared = [name for name in produced if name not in declared]
    if undeclared:
        raise ValueError(f"Features missing from the catalog: {', '.join(undeclared)}")


def catalog_table(spark: SparkSession, include_optional: bool = False) -> DataFrame:
    """One row per feature: position, feature, group, type, weight."""
    weights = default_weights()
    groups = ALL_GROUPS if include_optional else GROUPS
    rows = [
        (name, group, kind, weights.get(name, 1.0))
        for group, members in groups.items()
        for name, kind in members
    ]
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "position int, feature string, feature_group string, type string, weight double",
    )
