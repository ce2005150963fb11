"""Label normalisation: raw label text to a class name."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_CLASS

# Class -> raw labels (numbers and booleans as text, lower case).
CLASS_VALUES: dict[str, tuple[str, ...]] = {
    "benign": ("0", "benign", "legitimate", "normal", "good", "safe", "false"),
    "malicious": (
        "1", "2", "3", "malicious", "malware", "phishing", "defacement", "redirect", "spam",
        "true", "malware_download",
    ),
}


def label_map(class_values=None) -> dict[str, str]:
    """Raw label -> class, both lower case."""
    return {
        str(raw).lower(): name.lower()
        for name, raws in (class_values or CLASS_VALUES).items()
        for raw in raws
    }


def normalize_label(raw: Column, class_values=None, default: str = DEFAULT_CLASS) -> Column:
    """NULL -> default class; numeric text -> its integer part; otherwise trimmed
    lower case; then mapped to a class, unknown labels pass through."""
    text = F.lower(F.trim(raw.cast("string"), F.lit(" \t\r\n\x0b\x0c")))
    number = F.regexp_extract(text, r"\A([+-]?[0-9]+)(?:\.[0-9]*)?\z", 1)
    key = F.when(number != "", F.coalesce(number.try_cast("bigint").cast("string"), text)).otherwise(text)
    pairs = label_map(class_values)
    mapping = F.create_map(*[F.lit(x) for x in itertools.chain(*pairs.items())])
    return F.when(raw.isNull(), F.lit(default)).otherwise(
        F.coalesce(F.try_element_at(mapping, key), key)
    )
