r"""Character statistics of a string as built-in column expressions.

Counts are in code points. A character is a *digit* when it has a Unicode digit
value (decimal digits and the superscript/circled forms below), a *letter* when
it is in category L, and *special* when it is neither letter nor number.
Strings that are pure ASCII (byte length = length) take the cheaper ASCII
patterns; the result is the same. The ASCII patterns use the named classes
(``\p{Alpha}``, ``\p{Alnum}``): one table lookup per character, where a union of
ranges such as ``[^A-Za-z]`` costs several calls and is many times slower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points with a digit value outside category Nd.
EXTRA_DIGITS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}"
    r"\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}"
    r"\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
DIGIT = rf"[\p{{Nd}}{EXTRA_DIGITS}]"
NOT_DIGIT = rf"[^\p{{Nd}}{EXTRA_DIGITS}]"


def is_ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def _by_script(s: Column, ascii_value: Column, any_value: Column) -> Column:
    return F.when(is_ascii(s), ascii_value).otherwise(any_value)


def count_of(s: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def digit_count(s: Column) -> Column:
    return _by_script(
        s,
        F.length(F.regexp_replace(s, r"\P{Digit}+", "")),
        F.length(F.regexp_replace(F.regexp_replace(s, r"\P{N}+", ""), NOT_DIGIT + "+", "")),
    )


def letter_count(s: Column) -> Column:
    return _by_script(
        s,
        F.length(F.regexp_replace(s, r"\P{Alpha}+", "")),
        F.length(F.regexp_replace(s, r"\P{L}+", "")),
    )


def longest(parts: Column) -> Column:
    """Length of the longest string of an array, 0 for an empty array."""
    return F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0))


def _longest_run(s: Column, ascii_class: str, any_class: str) -> Column:
    return _by_script(
        s,
        longest(F.regexp_extract_all(s, F.lit(ascii_class + "+"), 0)),
        longest(F.regexp_extract_all(s, F.lit(any_class + "+"), 0)),
    )


def longest_digit_run(s: Column) -> Column:
    return _longest_run(s, r"\p{Digit}", DIGIT)


def longest_letter_run(s: Column) -> Column:
    return _longest_run(s, r"\p{Alpha}", r"\p{L}")


def longest_special_run(s: Column) -> Column:
    """Cut at the letters and numbers; a search for the negated class is far slower."""
    return _by_script(
        s, longest(F.split(s, r"\p{Alnum}+")), longest(F.split(s, r"[\p{L}\p{N}]+"))
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters in bits, 0 for the empty string.

    With k the multiplicity of each character, H = log2(n) - sum(k*log2 k)/n.
    Sorting the characters turns every multiplicity into one run, and only runs
    of two or more add to the sum, so the fold visits the repeated characters
    alone. This is several times faster than counting each distinct character.
    """
    n = F.length(s)
    in_order = F.array_join(F.sort_array(F.split(s, "")), "")
    repeats = F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1+"), 0)
    weighted = F.aggregate(
        repeats, F.lit(0.0), lambda acc, run: acc + F.length(run) * F.log2(F.length(run))
    )
    return F.when(n > 0, F.log2(n) - weighted / n).otherwise(F.lit(0.0))


def settled(h: Column) -> Column:
    """Entropy rounded at 1e-12, so a threshold test cannot flip on the last bit."""
    return F.round(h, 12)


def repeated_character_flag(s: Column) -> Column:
    """1 when some character occurs three or more times in a row."""
    return F.when(s.rlike(r"(.)\1{2,}"), 1.0).otherwise(0.0)
