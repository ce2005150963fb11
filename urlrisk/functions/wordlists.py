"""Word lists used by the dictionary flags.

The defaults below apply when no dictionary table is given; real lists are read
with ``urlrisk.sources.dictionaries`` and passed in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Default dictionaries.
BRAND_KEYWORDS = (
    "paypal", "amazon", "google", "facebook", "microsoft", "apple",
    "bank", "secure", "login", "account", "verify", "update",
)
SUSPICIOUS_TLDS = ("tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click", "link")
FREE_HOSTS = ("000webhost", "freenom", "freehosting", "byethost", "awardspace", "x10hosting")
NON_STANDARD_PORTS = ("4444", "1337", "8080", "8888", "3000", "5000", "7000", "9000")
URL_SHORTENERS = (
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "adf.ly",
)
AUTO_DOWNLOAD_PARAMS = ("download=", "file=", "get=", "attachment=")

# Lists that are part of the feature definitions.
REDIRECT_PARAMS = (
    "url=", "redirect=", "next=", "return=", "goto=", "redirect_url=", "return_url=",
    "next_url=", "goto_url=", "dest=", "destination=", "target=", "rurl=", "ru=", "back=",
    "callback=", "continue=", "link=", "path=", "ref=", "referrer=", "site=", "to=", "uri=",
    "u=", "redirecturl=",
)
SUSPICIOUS_EXTENSIONS = (".exe", ".bat", ".cmd", ".scr", ".vbs", ".js", ".jar", ".apk", ".sh")
EXECUTABLE_EXTENSIONS = (".exe", ".bat", ".cmd", ".scr")
SUSPICIOUS_KEYWORDS = (
    "admin", "login", "verify", "update", "secure", "account", "confirm", "password", "signin",
)
# Cyrillic and phonetic look-alikes, and Greek letters.
LOOKALIKES = "авсԁеһіјӏорԛѕԝхуᴢ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"


def homograph_class() -> str:
    """Pattern class of all characters whose lower-case form is a look-alike
    (the ohm sign U+2126 and the theta symbol U+03F4 lower to Greek letters)."""
    chars = LOOKALIKES + GREEK
    return "[" + "".join(sorted(set(chars) | set(chars.upper()) | {"\u2126", "\u03f4"})) + "]"


@dataclass(frozen=True)
class Dictionaries:
    """The six dictionaries. A tuple is matched inline; any list may be a DataFrame with a
    ``value`` column when it is large."""

    brand_keyword: tuple[str, ...] | DataFrame = BRAND_KEYWORDS
    suspicious_tld: tuple[str, ...] | DataFrame = SUSPICIOUS_TLDS
    free_hosting: tuple[str, ...] | DataFrame = FREE_HOSTS
    non_standard_port: tuple[str, ...] | DataFrame = NON_STANDARD_PORTS
    sorted_url: tuple[str, ...] | DataFrame = URL_SHORTENERS
    auto_download_params: tuple[str, ...] | DataFrame = AUTO_DOWNLOAD_PARAMS
