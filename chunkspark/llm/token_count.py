"""Tokens as a plain pre-tokenizer gives them, counted over Arrow batches.

Every code point has a class (blank, alone, part of a word, other sign), looked up in one table per Python worker; the
tokens of a text are its lone characters and signs and the beginnings of its runs of word characters, so a batch is
counted by array operations on its code points, without a regular expression.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of code points.
BLANK, ALONE, WORD, SIGN = 0, 1, 2, 3
#: Code points that are counted at once; longer texts go on in the next portion.
PORTION = 1 << 21


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: Han, Kana and Thai characters stand alone; other letters, marks and digits make
    words; blanks are white space and separators."""
    table = np.full(sys.maxunicode + 1, SIGN, np.uint8)
    points = np.r_[0:0xD800, 0xE000 : sys.maxunicode + 1].astype("<u4")  # all but the surrogates
    everything = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((WORD, r"[\p{L}\p{M}\p{N}]+"), (BLANK, r"[\s\x1c-\x1f\x85\p{Z}]+"), (ALONE, r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]+")):
        for run in regex.finditer(pattern, everything):
            table[points[run.start() : run.end()]] = kind
    return table


def count_texts(texts: list[str | None]) -> np.ndarray:
    """Number of tokens of each text; 0 for null."""
    kind_of = classes()
    out = np.zeros(len(texts), np.int64)
    held: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        kinds = kind_of[np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = (kinds == ALONE) | (kinds == SIGN)
        word = kinds == WORD
        first = word.copy()
        first[1:] &= ~word[:-1]
        begins |= first
        # Each piece ends in a blank of ours, so a word never goes on into the next piece.
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
        total = np.cumsum(begins)[ends - 1]
        np.add.at(out, np.asarray(owner), np.diff(total, prepend=0))
        held.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        start = 0
        while len(text) - start > PORTION:  # cut a very long text behind its last blank, or count what has none whole
            cut = max(text.rfind(" ", start, start + PORTION), text.rfind("\n", start, start + PORTION)) + 1
            if cut <= start:
                break
            held.append(text[start:cut])
            owner.append(i)
            start = cut
            flush()
        held.append(text[start:] + " ")
        owner.append(i)
        size += len(held[-1])
        if size > PORTION:
            flush()
    if held:
        flush()
    return out


def token_count(text: Column | str) -> Column:
    """Number of tokens of ``text``; 0 for null."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(count_texts(texts.to_pylist()))

    return run(F.col(text) if isinstance(text, str) else text)


#: The same count for DuckDB, whose regular expressions cannot subtract classes: lone characters are replaced first.
DUCKDB = r"len(regexp_extract_all(regexp_replace({0}, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}ー]', ' . ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+|[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}\p{{L}}\p{{M}}\p{{N}}]'))"
