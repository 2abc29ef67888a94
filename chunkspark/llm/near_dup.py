"""Near-duplicate records (problem 2): an exact Jaccard join on word shingles behind pigeonring filters.

The shingle set of a record is its indicator vector, so Jaccard(x, y) >= p/q holds exactly when the Hamming distance D
of the two vectors has ``(p + q) * D <= (q - p) * (|x| + |y|)``. The universe of shingles is cut by hash into a ring
of BOXES segments with the distances D_i and a proportional budget for each: ``(q - p) * (|x_i| + |y_i|)`` for
``(p + q) * D_i``. As the sums over the ring keep the whole budget, some segment exists from which every chain of
consecutive segments stays within the sum of its budgets, and one of these segments is not empty (the pigeonring
principle). The plan:

1. A count table of all shingles of *all* records (see ``count_table``). It never counts too little, so a cell of 1
   proves a shingle to be unique: such shingles join nothing and are left out, and a record with too many of them can
   have no partner at all. Otherwise the table only orders shingles, rarest first; any order gives the same result.
2. The index: where a chain starts, the two segments have Jaccard p/q themselves, so they share a shingle of the
   rare-first prefix of that segment. Each distinct text sends these shingles with parity sketches of 32 bits of their
   segment and of the next one; the Hamming distance of two sketches is never above that of the segments. Shingles
   above HOT occurrences are spread over pairs of classes of rows.
3. The join on the shingle makes a candidate of a pair only if both positions fit the pair's own prefix in the segment
   and if the chains of one and of CHAIN = 2 segments from there stay within their budgets.
4. The full Hamming check of the candidates against their texts.

Nothing is sampled or capped; every filter is a necessary condition. Copies of a text are one record until the end.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from chunkspark.llm.count_table import cells, count_table, decode_counts, table_bits
from chunkspark.session import cut_lineage

BOXES = 8
HOT = 20_000
#: Code points that are hashed together; longer texts are hashed alone.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_KINDS = np.zeros(0x110000, np.uint8)  # 1: no word, 2: letter, mark or digit; filled as characters occur
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(max(n, SLICE), base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_slice(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32)
    kind = _KINDS[code]
    if len(kind) and not kind.min():
        for c in np.unique(code[kind == 0]).tolist():
            _KINDS[c] = 1 + (unicodedata.category(chr(c))[0] in "LMN")
        kind = _KINDS[code]
    edges = np.flatnonzero(np.diff(kind == 2, prepend=False, append=False))
    start, stop = edges[::2], edges[1::2]
    up, down = _powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up[:-1], out=sums[1:])
    # The code points of a word as a polynomial, whatever its place.
    h = (sums[stop] - sums[start]) * down[start]
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    return np.searchsorted(ends, start, "right"), _mix(h)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(record index, hash) of every word of ``unicode_text.words``, in order."""
    owners, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    some, low, size = [], [], 0
    last = len(texts) - 1
    for i, text in enumerate(texts):
        if text:
            some.append(i)
            low.append(text.lower())
            size += len(low[-1])
        if low and (size >= SLICE or i == last):
            at, h = _hash_slice(low)
            owners.append(np.asarray(some, np.int64)[at])
            hashes.append(h)
            some, low, size = [], [], 0
    return np.concatenate(owners), np.concatenate(hashes)


def shingles(texts: list[str | None], k: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record index, shingle hash) of every distinct shingle, sorted by record; and the words of each record.

    Records with fewer than ``least_words`` (or than k) words have no shingles here.
    """
    doc, h = word_hashes(texts)
    counts = np.bincount(doc, minlength=len(texts))
    enough = (counts >= max(k, least_words))[doc]
    doc, h = doc[enough], h[enough]
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64), counts
    mixed = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    whole = doc[: len(doc) - k + 1] == doc[k - 1 :]
    mixed, doc = mixed[whole], doc[: len(doc) - k + 1][whole]
    order = np.lexsort((mixed, doc))
    mixed, doc = mixed[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], mixed[first], counts


def _strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _once(batch: pa.RecordBatch, seen: set[int]) -> list[str | None]:
    """The texts of a batch, without those that this task had before."""
    if len(seen) > 2_000_000:  # forgetting only costs repeated rows, which are dropped after the exchange
        seen.clear()
    texts = _strings(batch, "text")
    for i, h in enumerate(batch.column(batch.schema.get_field_index("h")).to_pylist()):
        if h in seen:
            texts[i] = None
        else:
            seen.add(h)
    return texts


def shingle_counts(texts: DataFrame, k: int, least_words: int, bits: int) -> np.ndarray:
    """The count table of the shingles of ``texts(h, text)``."""
    seen: set[int] = set()  # each task has its own copy
    return count_table(texts, lambda batch: shingles(_once(batch, seen), k, least_words)[1], bits)


#: In this order what is mostly zero (m2, and the low bits of the token in the next row) lies together and shuffles small.
COLUMNS = "token long, id long, sketches long, m1 long, m2 long"


def prefix_rows(texts: list[str | None], ids: np.ndarray, codes: np.ndarray, k: int, least_words: int, t: Fraction) -> dict[str, np.ndarray]:
    """The index rows of a batch: token, id, the sketches of the segment and of the next one (32 bits each), and four
    numbers, their low halves of 16 bits in m1 and their high ones in m2: from the lowest, place in the segment's prefix
    and class flag (2 bits), sizes of the segment and of the next one, size of the set. A token is 48 bits of the
    shingle's hash: where two shingles have the same, there are only more candidates."""
    doc, h, _ = shingles(texts, k, least_words)
    if not len(h):
        return {c.split()[0]: np.empty(0, np.int64) for c in COLUMNS.split(", ")}
    code = codes[cells(h, len(codes).bit_length() - 1)]
    box = (h & np.uint64(BOXES - 1)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    which = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[start, len(doc)])
    p, q = t.numerator, t.denominator
    must = (p * size + q - 1) // q  # least overlap with any partner
    may = size - np.add.reduceat((code <= 1).astype(np.int64), start) >= must
    cell = which * BOXES + box
    order = np.lexsort((h, code, cell))
    h, code, cell = h[order], code[order], cell[order]
    sizes = np.bincount(cell, minlength=len(start) * BOXES)
    begin = np.cumsum(sizes) - sizes
    sketch = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    sketch[some] = np.bitwise_xor.reduceat(np.uint64(1) << ((h >> np.uint64(3)) & np.uint64(31)), begin[some])
    pos = np.arange(len(h)) - begin[cell]
    least = (p * sizes + q - 1) // q
    keep = np.flatnonzero((pos <= (sizes - least)[cell]) & (code > 1) & may[cell // BOXES])
    token, at, position = h[keep].view(np.int64), cell[keep], pos[keep]
    own = ids[doc[start]][at // BOXES]
    # A hot token has classes of rows of about HOT each; a row goes to the cells of its class with each class, and two
    # rows meet in one cell: flag 2 where both classes are the same, else 0 and 1 by their order.
    classes = np.maximum(1, -(-decode_counts(code[keep]) // HOT))
    mine = np.where(classes > 1, own.view(np.uint64) % classes.astype(np.uint64), 0).astype(np.int64)
    rep = np.repeat(np.arange(len(keep)), classes)
    other = np.arange(len(rep)) - np.repeat(np.cumsum(classes) - classes, classes)
    mine, at = mine[rep], at[rep]
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    flag = np.where(mine == other, 2, (mine > other).astype(np.int64))
    following = at // BOXES * BOXES + (at + 1) % BOXES
    numbers = [(position[rep] << 2) | flag, sizes[at], sizes[following], size[at // BOXES]]
    with np.errstate(over="ignore"):
        return {
            "token": (token[rep] + low * np.int64(0x1F123BB5159A55E5) + high * np.int64(0x2545F4914F6CDD1D)) & np.int64(-(1 << 16)),
            "id": own[rep],
            "sketches": ((sketch[at] << np.uint64(32)) | sketch[following]).view(np.int64),
            "m1": sum((x & 0xFFFF) << 16 * i for i, x in enumerate(numbers)),
            "m2": sum((x >> 16) << 16 * i for i, x in enumerate(numbers)),
        }


def _prefix_partition(table, k: int, least_words: int, t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = table.value
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False)
            rows = prefix_rows(_once(batch, seen), ids, codes, k, least_words, t)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))

    return run


def index_rows(texts: DataFrame, t: Fraction, k: int, least_words: int, bits: int) -> DataFrame:
    """The index of ``texts(h, text)``, each text once."""
    table = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, k, least_words, bits))
    rows = texts.select("h", "text").mapInArrow(_prefix_partition(table, k, least_words, t), COLUMNS)
    return rows.repartition("token").dropDuplicates(["token", "id"])


def ring_pairs(rows: DataFrame, t: Fraction, chain: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of ids whose index rows meet and whose chains of up to ``chain`` (0 to 2) segments from
    there stay within their budgets."""
    p, q = t.numerator, t.denominator
    place, n1, n2, size = (f"((shiftright({{0}}.m1, {i}) & 65535) | shiftleft(shiftright({{0}}.m2, {i}) & 65535, 16))" for i in (0, 16, 32, 48))
    place = f"shiftright({place}, 2)"
    both = lambda n: f"({n.format('l')} + {n.format('r')})"
    # The distance of two segments is at least that of their sketches and of their sizes.
    far = lambda bits, n: f"greatest(bit_count((l.sketches ^ r.sketches) & {bits}), abs({n.format('l')} - {n.format('r')}))"
    first, second = f"{-(1 << 32)}L", f"{(1 << 32) - 1}L"
    overlap = f"(({p} * {both(n1)} + {p + q - 1}) div {p + q})"
    flags = "(l.m1 & 3) + (r.m1 & 3)"
    conditions = [
        "l.token = r.token",
        # The smaller set is on the left; the flags are 0 and 1, or 2 and 2. Each condition names both sides, so that
        # none is pushed below the exchange, and one exchange serves both.
        f"({flags} = 1 or {flags} = 4)",
        f"({size.format('l')} < {size.format('r')} or ({size.format('l')} = {size.format('r')} and l.id < r.id))",
        f"{q} * {size.format('l')} >= {p} * {size.format('r')}",
        f"{place.format('l')} <= {n1.format('l')} - {overlap} and {place.format('r')} <= {n1.format('r')} - {overlap}",
        f"{p + q} * {far(first, n1)} <= {q - p} * {both(n1)}",
        f"{p + q} * ({far(first, n1)} + {far(second, n2)}) <= {q - p} * ({both(n1)} + {both(n2)})",
    ]
    found = rows.alias("l").join(rows.alias("r"), F.expr(" and ".join(conditions[: 5 + chain])))
    return found.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def _check(k: int, least_words: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _strings(batch, "text_a"), _strings(batch, "text_b")
            same = []
            each = {text: i for i, text in enumerate(dict.fromkeys(left + right))}
            doc, h, _ = shingles(list(each), k, least_words)
            at = np.searchsorted(doc, np.arange(len(each) + 1)).tolist()
            for i, j in zip(map(each.__getitem__, left), map(each.__getitem__, right)):
                x, y = h[at[i] : at[i + 1]], h[at[j] : at[j + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both / (len(x) + len(y) - both) if len(x) and len(y) and q * both >= p * (len(x) + len(y) - both) else None)
            keep = pa.array([s is not None for s in same], pa.bool_())
            kept = [batch.column(batch.schema.get_field_index(c)).filter(keep) for c in ("a", "a2", "b", "b2")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([s for s in same if s is not None], pa.float64())], ["a", "a2", "b", "b2", "jaccard"])

    return run


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, k: int = 5, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate join of ``df``: ``(members, links)``.

    ``members(id, a, a2, paired)`` holds each distinct id with the class (two hashes of the text) that it belongs to;
    a class that is not ``paired`` has no link;
    ``links(a, a2, b, b2, jaccard)`` every pair of classes whose sets of ``k`` consecutive words have at least the
    Jaccard similarity ``threshold``, a class being linked to itself when it has several ids and enough words.
    Ids with a null id or text are in no class; repeated rows count once; texts with fewer than ``least_words``
    words (or than ``k``) have no link. Other columns of ``df`` are ignored, an empty table gives empty results.
    """
    t = Fraction(str(threshold)).limit_denominator(10_000)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"))
    long_enough = rows.where(F.length("text") >= max(1, 2 * max(least_words, k) - 1))
    second = F.xxhash64(F.lit("second"), F.col("text"))
    copies = long_enough.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = copies.select(F.col("h").alias("a"), F.col("h").alias("b"))
    bits = table_bits(long_enough, "text")
    pairs = cut_lineage(ring_pairs(index_rows(long_enough, t, k, least_words, bits), t).unionByName(copies), free=True)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h"))
    wanted = rows.sparkSession.sparkContext.broadcast(count_table(ends, lambda batch: batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))

    @F.arrow_udf("boolean")
    def is_wanted(h: pa.Array) -> pa.Array:
        return pa.array(wanted.value[cells(h.to_numpy(zero_copy_only=False).view(np.uint64), bits)] > 0)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("a")).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.append_column("paired", pa.array(wanted.value[cells(h, bits)] > 0))

    # Only ids and texts with a candidate go on (and a few whose cell is taken by another), before anything is shuffled.
    # As a column the optimizer would repeat the test of a member on its links.
    members = rows.select("id", F.col("h").alias("a"), second.alias("a2"))
    members = members.mapInArrow(paired, StructType([*members.schema, StructField("paired", BooleanType())])).distinct()
    texts = long_enough.where(is_wanted("h")).select("h", F.struct(second.alias("h2"), "text").alias("one"))
    # Grouped by h alone, so that one exchange serves both joins.
    texts = texts.groupBy("h").agg(F.collect_set("one").alias("same")).select("h", F.inline("same"))
    left, right = (texts.select(F.col("h").alias(c), F.col("h2").alias(f"{c}2"), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").where("a <> b or a2 = b2").select("a", "a2", "b", "b2", "text_a", "text_b")
    links = both.mapInArrow(_check(k, least_words, t.numerator, t.denominator), "a long, a2 long, b long, b2 long, jaccard double")
    return members, links


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of different ids ``(id_a, id_b)``, smaller id first in byte order, behind ``links``."""
    some = members.where("paired")
    left, right = some.select(F.col("id").alias("x"), "a", "a2"), some.select(F.col("id").alias("y"), F.col("a").alias("b"), F.col("a2").alias("b2"))
    pairs = links.join(left, ["a", "a2"]).join(right, ["b", "b2"])
    pairs = pairs.where((F.col("x") != F.col("y")) & ((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per id: its class (the smallest id of the same text), the ids in it, and the similar other classes."""
    classes = members.groupBy("a", "a2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    other = links.where("a <> b")
    ends = other.select("a", "a2").unionByName(other.select(F.col("b").alias("a"), F.col("b2").alias("a2")))
    degree = ends.groupBy("a", "a2").agg(F.count("*").alias("links"))
    classes = classes.join(degree, ["a", "a2"], "left")
    return members.join(classes, ["a", "a2"]).select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
