"""Oversized items cut at natural boundaries (problem 3) with a sparse-table range-maximum index.

Every position of a text has a boundary strength: 4 the end of a paragraph, 3 of a sentence, 2 of a word, 1 any
character that no combining mark follows. A sparse table over (strength, position) answers "the strongest cut in this
window, the rightmost among equals" in constant time. Each piece takes that cut from its permissible window and the
next one starts ``overlap`` code points before it. The same index tells the coarsest unit that never exceeds the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkspark.llm.sentences import sentence_ends

NAMES = {4: "paragraph", 3: "sentence", 2: "word", 1: "char"}
_PARAGRAPH = re.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+[^\S\n]*")
_WORD = re.compile(r"\S+")


def strengths(text: str) -> np.ndarray:
    """Boundary strength of a cut after each number of code points, 0 to len(text)."""
    n = len(text)
    out = np.ones(n + 1, np.int8)
    out[0] = 0
    if not text.isascii():
        for i, c in enumerate(text):
            if c > "˿" and unicodedata.category(c)[0] == "M":
                out[i] = 0
    out[[m.end() for m in _WORD.finditer(text)]] = 2
    start = 0
    for end, following in [*((m.start(), m.end()) for m in _PARAGRAPH.finditer(text)), (n, n)]:
        for e in sentence_ends(text[start:end]):
            out[start + e] = 3
        if end > start:
            out[start + len(text[start:end].rstrip())] = 4
        start = following
    out[n] = 4
    out[0] = 0
    return out


class StrongestCut:
    """Sparse table: the strongest, then rightmost, cut of any window."""

    def __init__(self, strength: np.ndarray) -> None:
        self.width = len(strength)
        level = strength.astype(np.int64) * self.width + np.arange(self.width)
        self.levels = [level]
        step = 1
        while 2 * step <= self.width:
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def query(self, low, high):
        """(strength, position) over the windows [low, high], ends included; arrays or single numbers."""
        low, high = np.asarray(low), np.minimum(np.asarray(high), self.width - 1)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        best = np.empty(low.shape, np.int64)
        for j in np.unique(k):
            at = k == j
            table = self.levels[j]
            best[at] = np.maximum(table[low[at]], table[high[at] - (1 << int(j)) + 1])
        return best // self.width, best % self.width


def coarsest_unit(text: str, strength: np.ndarray, index: StrongestCut, limit: int) -> str:
    """The coarsest boundary whose units never exceed ``limit``: from the start of each of its units, the strongest
    cut within the limit is at least that strong."""
    words = np.array([m.start() for m in _WORD.finditer(text)], np.int64)
    if not len(words):
        return "char"
    for level in (4, 3, 2):
        ends = np.flatnonzero(strength >= level)
        at = np.searchsorted(words, ends)  # each unit starts with the first word behind the end of the one before
        starts = np.unique(np.r_[words[0], words[at[at < len(words)]]])
        if (index.query(starts + 1, starts + limit)[0] >= level).all():
            return NAMES[level]
    return "char"


def pieces(text: str, limit: int, overlap: int, least: int | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The coarsest unit, and (start, end, boundary at the end) of the pieces of ``text``.

    Pieces are at most ``limit`` long; each but the first starts ``overlap`` before the end of the piece before it, so
    they cover the text. A piece is cut at the strongest boundary, the rightmost among equals, that leaves it at least
    ``least`` long (just more than the overlap by default).
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    if n <= limit:
        return "whole", [(0, n, "end")] if n else []
    least = max(overlap + 1, min(least or 0, limit))
    strength = strengths(text)
    index = StrongestCut(strength)
    out, start = [], 0
    while n - start > limit:
        kind, cut = (int(x) for x in index.query(start + least, start + limit))
        if kind == 0:
            kind, cut = 1, start + limit
        out.append((start, cut, NAMES[kind]))
        start = cut - overlap
    out.append((start, n, "end"))
    return coarsest_unit(text, strength, index, limit), out


_PIECES = "array<struct<piece:int,start:int,stop:int,cut:string,unit:string,pieces:int>>"
_ARROW = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("cut", pa.string()), ("unit", pa.string()), ("pieces", pa.int32())]))


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                unit, found = pieces(text, limit, overlap)
                rows.append([{"piece": k, "start": s, "stop": e, "cut": b, "unit": unit, "pieces": len(found)} for k, (s, e, b) in enumerate(found)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, _ARROW)], [*batch.schema.names[:-1], "__pieces"])

    return run


def split_oversized(df: DataFrame, keys: list[str], text_col: str, limit: int = 2000, overlap: int = 200, version: str | None = None) -> DataFrame:
    """``(*keys, piece, start, stop, cut, unit, pieces)``: the pieces of every key of ``df``.

    Positions are code points; ``unit`` is the coarsest unit that never exceeds the limit in that text (``whole`` if
    the text itself does not). A key that occurs several times counts once, with the text of its largest ``version``
    (such as a time of loading), among equals or without a version the one of the largest hash: its pieces are never
    those of two texts. Null and empty texts have no piece and no say in this. Other columns are ignored. Only texts
    above the limit reach Python, and only pieces, not texts, are shuffled.
    """
    order = F.struct((F.col(version) if version else F.lit(0)).alias("v"), F.xxhash64(text_col).alias("h"))
    rows = df.select(*keys, order.alias("__order"), F.col(text_col).alias("__text")).where("__text is not null and length(__text) > 0")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, "__order").schema.fields)
    size = F.length("__text")
    cut = rows.where(size > limit).mapInArrow(_cut(limit, overlap), f"{schema}, __pieces {_PIECES}")
    one = F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).alias("start"), size.alias("stop"), F.lit("end").alias("cut"), F.lit("whole").alias("unit"), F.lit(1).alias("pieces")))
    whole = rows.where(size <= limit).select(*keys, "__order", one.cast(_PIECES).alias("__pieces"))
    latest = cut.unionByName(whole).groupBy(*keys).agg(F.max_by("__pieces", "__order").alias("__pieces"))
    return latest.select(*keys, F.explode("__pieces").alias("__p")).select(*keys, "__p.*")
