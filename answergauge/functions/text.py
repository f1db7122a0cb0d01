"""Text functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The openings that mark a refusal, the one more that a second marker set has, and bytes looked at.
REFUSALS = (
    "i cannot", "i can't", "i can not", "cannot provide", "can't provide", "cannot directly", "sorry, i", "i'm sorry", "i am sorry", "i do not have", "i don't have",
    "unable to provide", "unable to determine", "not able to provide", "i'm not able", "i am not able", "no data available", "not explicitly provided", "insufficient data", "i'm unable",
)
REFUSALS_MORE = (*REFUSALS, "i am unable")
REFUSAL_WINDOW = 240
#: Letters and digits of any script.
WORD = "([\\p{IsAlphabetic}\\p{N}]+)"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def upper_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_LOWER, ASCII_UPPER)


def split_words(text: Column) -> Column:
    """Runs of letters and digits, as an array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(1))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of two bytes at least, A-Z lower-cased."""
    return F.filter(F.transform(split_words(text), lower_ascii), lambda w: F.octet_length(w) >= 2)


def byte_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def is_blank(text: Column) -> Column:
    """No byte but the six ASCII white spaces; null is blank."""
    return F.coalesce(text, F.lit("")).rlike("\\A[ \\t\\n\\r\\x0B\\f]*\\z")


def is_blank_unicode(text: Column) -> Column:
    """No character but white space of any script; null is blank."""
    return F.coalesce(text, F.lit("")).rlike("\\A[\\p{IsWhite_Space}]*\\z")


def contains_fold(text: Column, marker: str) -> Column:
    """Whether the text has the marker, A-Z being equal to a-z."""
    return lower_ascii(F.coalesce(text, F.lit(""))).contains(marker)


def head_bytes(text: Column, size: int) -> Column:
    """The characters that the first bytes of a text hold whole."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    # A character has four bytes at most, so one of these ends between characters.
    return F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, size - k).cast("string")) for k in range(4)])


def is_refusal(text: Column, markers: tuple[str, ...] = REFUSALS, window: int = REFUSAL_WINDOW) -> Column:
    """Whether a marker stands in the first window bytes. Markers are ASCII: a cut character is part of none."""
    if not markers:
        return F.lit(False)
    head = lower_ascii(head_bytes(text, window))
    return reduce(lambda a, b: a | b, [head.contains(m) for m in markers])


def clip(text: Column, size: int) -> Column:
    """At most size characters on one line, with an ellipsis where more were cut."""
    line = F.regexp_replace(F.coalesce(text, F.lit("")), "\\n", " ")
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("…"))).otherwise(line)


def pct(a: Column, b: Column) -> Column:
    """100 * a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(F.lit(100.0) * a, b), F.lit(0.0))


def general(value: Column, digits: int = 8) -> Column:
    """So many significant digits without zeros at the end; with a power of ten below 0.0001 and where there are more places."""
    shown = F.format_string(f"%.{digits - 1}e", value)
    power = F.regexp_extract(shown, "e(.*)$", 1).cast("int")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    far = F.concat(bare(F.regexp_extract(shown, "^([^e]*)e", 1)), F.regexp_extract(shown, "(e.*)$", 1))
    near = F.lit(None).cast("string")
    for k in range(-4, digits):
        near = F.when(power == k, bare(F.format_string(f"%.{digits - 1 - k}f", value))).otherwise(near)
    return F.coalesce(near, far)


def trim_float(value: Column) -> Column:
    """Six decimals without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), "\\.$", "")
