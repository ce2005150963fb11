"""The feature definitions in plain Python on urllib.parse: the test oracle."""

import math
import re
from itertools import groupby
from urllib.parse import parse_qs, urlparse

from urlrisk.functions import wordlists as wl


def entropy(text):
    n = len(text)
    return -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text)) if n else 0.0


def longest_run(text, kind):
    return max((len(list(g)) for k, g in groupby(text, kind) if k), default=0)


def share(part, whole):
    return part / whole if whole else 0.0


def digits(text):
    return sum(map(str.isdigit, text))


def special(c):
    return not c.isalnum()


def contains(text, words):
    return any(w in text for w in words)


def url_features(url):
    """Unweighted features; raises ValueError for a malformed authority."""
    parts = urlparse(url if "://" in url else "http://" + url)
    host, path, query = parts.netloc, parts.path, parts.query
    full = parts.geturl().lower()
    n, d, a = len(url), digits(url), sum(map(str.isalpha, url))
    runs = [longest_run(url, k) for k in (str.isdigit, str.isalpha, special)]
    h, hh = entropy(url), entropy(host)
    tokens = host.split(".")
    label = tokens[0]
    is_ip = bool(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", host))
    vowels = sum(c in "aeiou" for c in label.lower())
    letters = sum(c.isalpha() for c in label.lower())
    segments = [s for s in path.split("/") if s]
    name = segments[-1] if segments else ""
    fields = parse_qs(query)
    sizes = [len(k) + sum(map(len, v)) for k, v in fields.items()]
    eps = 1e-12
    out = {
        "http_token": url.startswith("http://"),
        "url_length": n,
        "dot_count": url.count("."),
        "hyphen_count": url.count("-"),
        "slash_count": url.count("/"),
        "at_symbol_count": url.count("@"),
        "percent_count": url.count("%"),
        "special_char_count": n - d - a,
        "digit_ratio": share(d, n),
        "letter_ratio": share(a, n),
        "special_char_ratio": share(n - d - a, n),
        "longest_digit_sequence": runs[0],
        "longest_letter_sequence": runs[1],
        "longest_special_sequence": runs[2],
        "character_continuity_rate": share(sum(runs), n),
        "url_entropy": h,
        "low_entropy": h < 3.0 - eps,
        "high_entropy": h > 4.0 + eps,
        "long_url_length": n > 100,
        "high_digit_ratio": share(d, n) > 0.3,
        "low_special_char_ratio": share(n - d - a, n) < 0.05,
        "domain_length": len(host),
        "domain_token_count": len(tokens),
        "subdomain_count": max(0, len(tokens) - 2),
        "digit_ratio_domain": share(digits(host), len(host)),
        "hyphen_count_domain": host.count("-"),
        "longest_domain_token": max(map(len, tokens)),
        "avg_domain_token_length": sum(map(len, tokens)) / len(tokens),
        "domain_entropy": hh,
        "ip_address_flag": is_ip,
        "multiple_subdomain_flag": len(tokens) > 3,
        "brand_keyword_flag": contains(host.lower(), wl.BRAND_KEYWORDS),
        "port_in_url_flag": ":" in host and not is_ip,
        "https_in_domain": "https" in host.lower(),
        "tld_suspicious_flag": tokens[-1].lower() in wl.SUSPICIOUS_TLDS,
        "shortening_service_flag": contains(host.lower(), wl.URL_SHORTENERS),
        "double_slash_redirecting": "//" in path,
        "punycode_domain_flag": "xn--" in host,
        "unicode_domain_flag": not host.isascii(),
        "homograph_suspicious_flag": any(c.lower() in wl.LOOKALIKES + wl.GREEK for c in host),
        "excessive_subdomain_depth": max(0, len(tokens) - 6),
        "random_string_domain_flag": len(label) >= 8 and entropy(label) > 3.5 + eps,
        "free_hosting_domain_flag": contains(host.lower(), wl.FREE_HOSTS),
        "dga_domain_flag": len(label) >= 10
        and letters > vowels
        and entropy(label) > 3.8 + eps
        and not 0.2 <= vowels / letters <= 0.6,
        "non_standard_port_flag": ":" in host
        and host.rsplit(":", 1)[1] in wl.NON_STANDARD_PORTS,
        "high_domain_entropy": hh > 3.8 + eps,
        "path_length": len(path),
        "path_token_count": len(segments),
        "digit_ratio_path": share(digits(path), len(path)),
        "dot_count_path": path.count("."),
        "longest_path_token": max(map(len, segments), default=0),
        "avg_path_token_length": share(sum(map(len, segments)), len(segments)),
        "path_entropy": entropy(path),
        "filename_length": len(name),
        "suspicious_extension_flag": name.endswith(wl.SUSPICIOUS_EXTENSIONS),
        "executable_extension_flag": name.endswith(wl.EXECUTABLE_EXTENSIONS),
        "suspicious_js_extension_flag": path.endswith(".js") or "javascript:" in full,
        "query_length": len(query),
        "parameter_count": len(fields),
        "digit_ratio_query": share(digits(query), len(query)),
        "equal_count_query": query.count("="),
        "ampersand_count_query": query.count("&"),
        "avg_parameter_length": share(sum(sizes), len(sizes)),
        "max_parameter_length": max(sizes, default=0),
        "query_entropy": entropy(query),
        "encoded_url_flag": "%" in query,
        "redirect_parameter_flag": contains(query.lower(), wl.REDIRECT_PARAMS),
        "script_in_url_flag": "script" in full,
        "auto_download_param_flag": contains(query.lower(), wl.AUTO_DOWNLOAD_PARAMS),
        "base64_in_url_flag": bool(re.search(r"[A-Za-z0-9+/]{20,}", full)),
        "mixed_token_flag": bool(re.search(r"[a-zA-Z]\d|[0-9][a-zA-Z]", url)),
        "hex_encoding_flag": bool(re.search(r"%[0-9a-fA-F]{2}", url)),
        "obfuscation_pattern_flag": bool(re.search(r"[a-zA-Z0-9]{20,}", url)),
    }
    return {k: float(v) for k, v in out.items()}
