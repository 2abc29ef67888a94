"""Character classes shared by the text operators of this subpackage."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache


@lru_cache(maxsize=None)
def class_ranges(categories: str) -> str:
    """The body of a regular-expression class holding every code point whose general category starts with one of
    ``categories`` (built once per process from the running Python's Unicode tables)."""
    out, start, prev = [], None, None
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(chr(point))[0] in categories:
            if start is None:
                start = point
            prev = point
        elif start is not None:
            out.append((start, prev))
            start = None
    if start is not None:
        out.append((start, prev))
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


@lru_cache(maxsize=None)
def word_pattern() -> re.Pattern:
    """Maximal runs of letters, marks and digits."""
    return re.compile(f"[{class_ranges('LMN')}]+")


_ASCII_SPACED = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))


class _Spaced(dict):
    """For str.translate: a blank for every code point that is no letter, mark or digit; filled as characters occur."""

    def __missing__(self, point: int) -> int:
        self[point] = value = point if unicodedata.category(chr(point))[0] in "LMN" else 32
        return value


_SPACED = _Spaced()


def words(text: str) -> list[bytes] | list[str]:
    """Lower-cased maximal runs of letters, marks and digits (as ASCII bytes where the whole text is ASCII)."""
    low = text.lower()
    if low.isascii():
        return low.encode().translate(_ASCII_SPACED).split()
    return low.translate(_SPACED).split()
