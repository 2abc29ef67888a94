"""A table of counts by hash that fits on the driver and on every executor, whatever the number of rows.

It holds 2**bits one-byte cells; several hashes may share a cell, so a count is never too small. It serves as an order
(rare before frequent), as a proof of uniqueness (1), and as a filter (0: not there).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the cells of a table: as many as there are code points per CHARS_PER_CELL, within these bounds, so the
#: broadcast is 64 MB at most. With more shingles than that the order of the index is coarser; nothing else changes.
LEAST_BITS, MOST_BITS = 16, 26
CHARS_PER_CELL = 24
SLICES = 64
FAN_OUT = 16
_EXACT = 128  # counts below are kept as they are, larger ones by their logarithm


def table_bits(rows: DataFrame, text_col: str) -> int:
    """Logarithm of the table's size for the texts of ``rows``."""
    chars = rows.agg(F.sum(F.length(text_col).cast("long")).alias("n")).first()["n"] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(chars // CHARS_PER_CELL).bit_length()))


def cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def encode_counts(counts: np.ndarray) -> np.ndarray:
    """One byte per count: exact below _EXACT, then quarters of powers of two, up to about 2**38."""
    high = _EXACT + np.floor(4 * np.log2(np.maximum(counts, _EXACT) / _EXACT)).astype(np.int64)
    return np.where(counts <= _EXACT, counts, np.minimum(high, 255)).astype(np.uint8)


def decode_counts(codes: np.ndarray) -> np.ndarray:
    """The largest count of a code."""
    return np.where(codes < _EXACT, codes, np.ceil(_EXACT * 2.0 ** ((codes.astype(np.float64) - _EXACT + 1) / 4))).astype(np.int64)


def _packed(at: np.ndarray, value: np.ndarray) -> bytes:
    planes = (np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(at, prepend=0), value))
    return zlib.compress(b"".join(planes), 1)


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    steps, value = (np.ascontiguousarray(raw[i * 4 * n : (i + 1) * 4 * n].reshape(4, n).T).view("<u4").ravel() for i in (0, 1))
    return np.cumsum(steps, dtype=np.int64), value


_PART = "slice int, n int, data binary"
_MOST = np.uint64(2**32 - 1)


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = len(total) // SLICES
    for s in range(SLICES):
        part = total[s * width : (s + 1) * width]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([_packed(at, part[at])], pa.binary())], ["slice", "n", "data"])


def _sum_slices(bits: int, last: bool):
    """Sums of the parts of each slice; in the ``last`` step as one byte per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}  # at most SLICES arrays, together as wide as the table
        for batch in batches:
            for s, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                at, value = _unpacked(n, data)
                total = totals.setdefault(s, np.zeros((1 << bits) // SLICES, np.uint64))
                total[at] += value
        for s, total in totals.items():
            at = np.flatnonzero(total)
            data = zlib.compress(encode_counts(total.astype(np.int64)).tobytes(), 1) if last else _packed(at, np.minimum(total[at], _MOST))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([data], pa.binary())], ["slice", "n", "data"])

    return run


def count_table(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How often the cells of 2**bits occur among the hashes of all batches of ``rows``, one byte per cell.

    Each task counts its batches; the parts of a slice are summed in a tree of two levels (FAN_OUT groups of tasks,
    then all), so no task reads the parts of all tasks. The result goes to the driver: 2**MOST_BITS bytes at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            h = hashes(batch)
            if len(h):
                found, n = np.unique(cells(h, bits), return_counts=True)
                total[found] += n.astype(np.uint32)
        yield from _slices(total)

    parts = rows.mapInArrow(count, _PART).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(FAN_OUT)))
    some = parts.repartition("slice", "group").select("slice", "n", "data").mapInArrow(_sum_slices(bits, False), _PART)
    table = np.zeros(1 << bits, np.uint8)
    width = len(table) // SLICES
    for row in some.repartition("slice").mapInArrow(_sum_slices(bits, True), _PART).collect():  # at most SLICES rows
        table[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    return table
