"""Line-first cleaning: rules judge single lines, then documents that lost too much go.

A line fails as navigation (separators between most of its words, or a menu phrase
alone), as boilerplate (a known phrase in a short line), or on punctuation (nearly all its
characters are marks, or most of its words end in a run of marks). A bullet at the start
of a line is no separator. Failed lines are removed. A document is rejected if it fails
the base rules (too short, or mostly repeated word triples) or if the lines that went
held more than half of its word characters.

One narrow pass over whole texts; memory is that of one text at a time.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import DataFrame

from urlrisk.llm.texts import add_columns, utf8

OUT_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, lost_chars long, kept boolean, clean_text string"
)

SYMBOLS = b"#*$%&|<>"
MARKS = string.punctuation.encode()
BULLETS = {b"-", b"*", "•".encode(), "·".encode(), "–".encode()}
SEPARATORS = {b"|", b">", b"<", b"&", b"*", b"#", b"-", "»".encode(), "·".encode(), "•".encode()}
MENU = {b"home", b"next", b"previous", b"login", b"log in", b"sign in", b"sign up", b"menu", b"search", b"share", b"read more",
        b"back to top", b"skip to content"}
BOILERPLATE = (b"all rights reserved", b"cookie policy", b"accept cookies", b"privacy policy", b"terms of service",
               b"enable javascript", b"lorem ipsum", b"click here to subscribe")


@dataclass(frozen=True)
class LineRules:
    """Parameters. Shares are of a line's words, or of a text's word characters."""

    separator_share: float = 0.3
    symbol_share: float = 0.5
    mark_share: float = 0.75
    mark_chars: int = 5  #: shorter lines, such as closing brackets, are not judged by marks
    boilerplate_words: int = 25
    max_lost: float = 0.5
    min_words: int = 50
    max_repeat: float = 0.5


def line_fails(line: bytes, words: list[bytes], rules: LineRules) -> bool:
    """Whether a line with words breaks a rule."""
    n = len(words)
    bullet = n > 1 and words[0] in BULLETS
    separators = sum(w in SEPARATORS for w in words) - (bullet and words[0] in SEPARATORS)
    if n >= 3 and separators >= rules.separator_share * n:
        return True
    lower = b" ".join(words).lower()
    if lower.strip(b".:!>|") in MENU:
        return True
    if n <= rules.boilerplate_words and any(x in lower for x in BOILERPLATE):
        return True
    # Words that end in two symbols, or in the same mark twice.
    marked = sum(len(w) > 1 and (w[-1] == w[-2] and w[-1] in MARKS or w[-1] in SYMBOLS and w[-2] in SYMBOLS) for w in words)
    if n >= 3 and marked > rules.symbol_share * n:
        return True
    marks = len(line) - len(line.translate(None, MARKS))
    if marks <= rules.mark_share * rules.mark_chars:
        return False
    chars = _chars(words)
    return chars >= rules.mark_chars and marks > rules.mark_share * chars


def _chars(words: list[bytes]) -> int:
    return len(b"".join(words).decode())


def _repeat_words(words: list[bytes]) -> int:
    """Words within windows of three that occur twice or more, the first included."""
    import numpy as np

    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    base = len(number)
    pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * base + ids[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def judge_text(text: bytes | None, rules: LineRules) -> tuple:
    """One row of OUT_SCHEMA."""
    if text is None:
        return 0, 0, 0, 0, 0, True, 0, False, None
    words = text.split()
    n, chars = len(words), _chars(words)
    seen: set[bytes] = set()
    kept_lines, lost, duplicates = [], 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            duplicates += line in seen
            seen.add(line)
            if line_fails(line, own, rules):
                lost += _chars(own)
                continue
        kept_lines.append(line)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeat = _repeat_words(words)
    base_failed = n < rules.min_words or repeat > rules.max_repeat * n
    kept = not base_failed and lost <= rules.max_lost * chars
    clean = text if not lost else b"\n".join(kept_lines)
    return n, chars, symbols, duplicates, repeat, base_failed, lost, kept, clean.decode()


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), carry: list[str] | None = None) -> DataFrame:
    """Columns of `docs` (or those in `carry`) with the counts of a text, `base_failed`,
    `lost_chars` (word characters of removed lines), `kept` and `clean_text`.

    Null and empty texts have no words: base_failed, not kept. Lines without words never
    fail. Repeated rows are judged alike and stay. Columns named like an added one are
    replaced; an empty table gives an empty table.
    """
    def compute(column):
        return zip(*[judge_text(t, rules) for t in utf8(column)], strict=True)

    return add_columns(docs, text, OUT_SCHEMA, compute, carry)
