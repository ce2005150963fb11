"""Advice text for a scored URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts; {pct} is the confidence in percent with two decimals.
BENIGN_HIGH = "This URL appears to be safe with high confidence."
BENIGN_MEDIUM = "This URL appears to be safe, but exercise caution."
BENIGN_LOW = "This URL may be safe, but confidence is low. Verify before accessing."
PER_CLASS = {
    "phishing": "Warning: This URL is likely a phishing attempt (confidence: {pct}). "
    "Do not enter personal information or credentials.",
    "malware": "Danger: This URL may contain malware (confidence: {pct}). Avoid accessing this link.",
    "redirect": "Caution: This URL appears to be a redirect (confidence: {pct}). "
    "It may lead to malicious content.",
    "spam": "This URL is likely spam (confidence: {pct}). It may be unwanted or misleading content.",
}


def advice(predicted: Column, confidence: Column) -> Column:
    percent = F.format_string("%.2f%%", confidence * 100)

    def filled(text: str) -> Column:
        before, after = text.split("{pct}")
        return F.concat(F.lit(before), percent, F.lit(after))

    text = F.when(
        predicted == "benign",
        F.when(confidence > 0.9, BENIGN_HIGH).when(confidence > 0.7, BENIGN_MEDIUM).otherwise(BENIGN_LOW),
    )
    for name, template in PER_CLASS.items():
        text = text.when(predicted == name, filled(template))
    return text.otherwise(
        F.concat(
            F.lit("This URL has been classified as "), predicted, F.lit(" with "), percent,
            F.lit(" confidence."),
        )
    )
