"""Column expressions on text; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space: all Unicode blanks and the four ASCII separators.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NO_SPACE = r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]"
#: The same one by one.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_BREAKS = r"\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
LINE_BREAK = rf"\r\n|[\n{OTHER_BREAKS}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, even where ``use`` names it inside a lambda function."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends; null stays null."""
    return F.btrim(col(c), F.lit(BLANKS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and all-blank text."""
    return F.coalesce(strip(c), F.lit("")) == ""


def span(n: Column) -> Column:
    """0, 1, ..., n-1; empty for n <= 0 or null."""
    n = n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def split_literal(c: Column | str, sep: str) -> Column:
    return F.split(col(c), r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E")


def lines(c: Column | str) -> Column:
    """Lines at all Unicode line breaks; a break at the end opens no line, empty text has none."""
    return let(F.split(col(c), LINE_BREAK), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def keep_text(pieces: Column) -> Column:
    """Pieces stripped, blank and null ones dropped; null gives an empty array."""
    stripped = F.transform(F.coalesce(pieces, F.array().cast("array<string>")), lambda x: strip(x))
    return F.filter(stripped, lambda x: x.isNotNull() & (x != ""))


def sentences(c: Column | str) -> Column:
    """Every one of ``. ? !`` ends a sentence; the rest without one is the last."""
    return keep_text(F.regexp_extract_all(col(c), F.lit(r"[^.?!]*[.?!]|[^.?!]+"), F.lit(0)))


def tokens(c: Column | str) -> Column:
    """Runs of non-blank characters."""
    return F.regexp_extract_all(col(c), F.lit(f"{NO_SPACE}+"), F.lit(0))


def token_estimate(c: Column | str, chars_per_token: int = 4) -> Column:
    """ceil(length / chars_per_token); a size of 0 or less stands for 4."""
    per = chars_per_token if chars_per_token > 0 else 4
    return F.ceil(F.length(col(c)) / F.lit(per)).cast("long")


def alnum_tokens(c: Column | str) -> Column:
    """Small-letter runs of letters and numbers of any script."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def match_form(c: Column | str) -> Column:
    """The form in which needles and hits are compared: small ASCII letters and digits with single blanks."""
    out = F.regexp_replace(F.lower(col(c)), "[-_]+", " ")
    out = F.regexp_replace(out, rf"(?:(?!{SPACE})[^a-z0-9])", " ")
    return strip(F.regexp_replace(out, f"{SPACE}+", " "))


# Words that are no keywords.
STOP_WORDS = [
    "the", "and", "of", "in", "to", "for", "with", "on", "by", "an", "a", "is", "are", "be", "we", "this", "that",
    "as", "at", "from", "can", "it", "or", "their", "our", "via", "using", "into", "these", "those", "such", "have",
    "has", "was", "were", "will", "may", "also", "both", "between", "within", "over", "under", "through", "than",
    "more", "less",
]


def keyword_tokens(c: Column | str) -> Column:
    """Words of more than two ASCII letters or digits that are no stop words, in order."""
    out = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[-_]+", " "), rf"(?:(?!{SPACE})[^a-z0-9])", " ")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(out), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
