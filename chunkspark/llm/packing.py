"""Fixed-capacity containers filled with items (problem 6) by exact-complement hashing.

Containers are planned on the histogram of item sizes, which has at most ``capacity`` rows however many items there
are: while items are left, the largest opens a container, and the gap is filled exactly by one, two or three further
sizes looked up in the index of available sizes and of their pair sums; where no such combination exists, the
largest fitting size goes in (best fit) and the search goes on with the rest of the gap. A plan line says "this
multiset of sizes, so many times", so the plan is bounded by the number of sizes too. Items then find their container
by their rank among the items of their size, counted in parts of about PART_ROWS so that no size makes a hot group.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkspark.session import cut_lineage

#: Items of one size that are sorted together.
PART_ROWS = 100_000
#: The histogram and the plan of each capacity are on the driver.
MOST_CAPACITIES = 1000


class _Available:
    """Counts of the sizes still to place, and the index of their sums: which sizes, pairs and triples fill a gap.

    ``_first[g]`` is a size that makes ``g`` with one other, ``_third[g]`` one that makes it with a pair. Sizes only
    vanish, so an entry is checked when it is used: one that has become void is looked for again among the sizes that
    are left, and a sum that once has no combination never gets one.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.n[size] = n
        sizes = np.flatnonzero(self.n)
        self._first = np.zeros(capacity + 1, np.int64)
        for s in sizes[::-1]:  # smaller sizes overwrite: the most unequal pair stays
            sums = s + (sizes if self.n[s] > 1 else sizes[sizes != s])
            self._first[sums[sums <= capacity]] = s
        self._third = np.zeros(capacity + 1, np.int64)
        pairs = np.flatnonzero(self._first)
        for s in sizes:  # larger sizes overwrite
            sums = s + pairs
            self._third[sums[sums <= capacity]] = s

    def largest(self, most: int) -> int:
        """The largest available size up to ``most``, 0 if none."""
        found = np.flatnonzero(self.n[: most + 1])
        return int(found[-1]) if len(found) else 0

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two available sizes that add up to ``gap``."""
        a = int(self._first[gap])
        if not a:
            return None
        if self.n[a] > 0 and self.n[gap - a] > (2 * a == gap):
            return a, gap - a
        x = np.arange(1, gap // 2 + 1)
        at = np.flatnonzero((self.n[x] > 0) & (self.n[gap - x] > (2 * x == gap)))
        self._first[gap] = a = int(x[at[0]]) if len(at) else 0
        return (a, gap - a) if a else None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """Three available sizes that add up to ``gap``."""
        c = int(self._third[gap])
        while c:
            if self.n[c] > 0:
                self.n[c] -= 1
                found = self.pair(gap - c)
                self.n[c] += 1
                if found:
                    self._third[gap] = c
                    return (*found, c)
            rest = np.flatnonzero((self.n[:c] > 0) & (self._first[gap - np.arange(c)] > 0))
            c = int(rest[-1]) if len(rest) else 0
        self._third[gap] = 0
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available sizes that fill ``gap`` exactly."""
        if self.n[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Lines (((size, how often in the container), ...), number of such containers) that place every item."""
    left = _Available({s: n for s, n in counts.items() if 0 < s <= capacity}, capacity)
    lines = []
    while size := left.largest(capacity):
        content = [size]
        left.n[size] -= 1
        gap = capacity - size
        while gap:
            if found := left.complement(gap):
                content.extend(found)
                for s in found:
                    left.n[s] -= 1
                break
            if not (best := left.largest(gap)):
                break
            content.append(best)
            left.n[best] -= 1
            gap -= best
        each = Counter(content)
        for s, k in each.items():
            left.n[s] += k
        times = min(int(left.n[s]) // k for s, k in each.items())
        for s, k in each.items():
            left.n[s] -= k * times
        lines.append((tuple(sorted(each.items())), times))
    return lines


def pack(df: DataFrame, id_col: str, size_col: str, containers: DataFrame) -> DataFrame:
    """``(capacity, container, id, part, parts, size)``: every item of ``df`` in containers of each capacity.

    ``containers(capacity)`` is a small fixed table; more than MOST_CAPACITIES are an error. An item larger than the
    capacity is cut into full containers and a rest that is packed as an item (``parts`` > 1); no other item is cut.
    Items with a null id or with no positive size take no space and have no row. Repeated rows are different items.
    """
    spark = df.sparkSession
    items = df.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("total")).where("id is not null and total > 0")
    items = cut_lineage(items)  # sizes may be costly to compute, and are read three times
    capacities = [r[0] for r in containers.select(F.col("capacity").cast("long")).where("capacity > 0").distinct().orderBy("capacity").limit(MOST_CAPACITIES + 1).collect()]
    if len(capacities) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities; each is planned on the driver")
    if not capacities:
        return items.selectExpr("0L as capacity", "0L as container", "id", "0L as part", "1L as parts", "total as size").limit(0)
    items = items.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities])))
    items = items.withColumn("parts", F.expr("(total + capacity - 1) div capacity"))
    items = items.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    items = items.withColumn("size", F.least(F.col("capacity"), F.col("total") - F.col("part") * F.col("capacity")))
    histogram = items.groupBy("capacity", "size").agg(F.count("*").alias("n")).collect()  # at most sum(capacities) rows
    slots, opened, used = [], 0, Counter()
    for capacity in capacities:
        opened = 0
        for content, times in plan({r["size"]: r["n"] for r in histogram if r["capacity"] == capacity}, capacity):
            for size, k in content:
                first = used[capacity, size]
                used[capacity, size] += k * times
                slots.append((capacity, size, first, first + k * times, opened, k))
            opened += times
    lines = spark.createDataFrame(slots or [(0, 0, 0, 0, 0, 1)], "capacity long, size long, first long, stop long, opened long, each long")
    # Sizes with more than PART_ROWS items are ranked in parts; the others are part 0.
    hot = [(r["capacity"], r["size"], -(-r["n"] // PART_ROWS)) for r in histogram if r["n"] > PART_ROWS]
    hot = F.broadcast(spark.createDataFrame(hot or [(0, 0, 1)], "capacity long, size long, salts long"))
    items = items.join(hot, ["capacity", "size"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.coalesce("salts", F.lit(1))))
    cells = items.groupBy("capacity", "size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("capacity", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("capacity", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("capacity", "size", "salt").orderBy("id", "part")
    ranked = items.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["capacity", "size", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    placed = ranked.join(F.broadcast(lines), ["capacity", "size"]).where("rank >= first and rank < stop")
    return placed.selectExpr("capacity", "opened + (rank - first) div each as container", "id", "part", "parts", "size")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens in them, share of the space that is used, and cut items."""
    return packed.groupBy("capacity").agg(
        (F.max("container") + 1).alias("containers"),
        F.sum("size").alias("used"),
        F.round(F.sum("size") / ((F.max("container") + 1) * F.col("capacity")), 6).alias("fill"),
        F.sum(F.when((F.col("parts") > 1) & (F.col("part") == 0), 1).otherwise(0)).alias("cut_items"),
    )
