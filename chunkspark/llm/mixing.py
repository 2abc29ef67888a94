"""Sources mixed to target weights (problem 7) by pivotal dependent rounding.

The budget of a mix is all that its sources have. A source that shall give the share s needs s * budget / available
copies of each of its documents, at most ``max_repeats``. The whole part of that number is taken at once; its fraction
is a probability per document, and the pivotal method makes these probabilities 0 or 1 in pairs: the two transfer mass
at random (each keeping its expectation) until one of them is integral. Neighbours in a pair are neighbours by size,
so that the tokens stay near the target. Every block of documents leaves at most one undecided document, and those
meet again in the next level of a reduction tree, until one per source is decided by its own probability.
"""

from __future__ import annotations

import random

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkspark.session import cut_lineage

BLOCK_ROWS = 4_000
FAN_IN = 256
_ROWS = "mix_id string, source string, block long, id {id}, tokens long, p double, extra int"


def clean_source(column: str) -> Column:
    """Sources are compared without blanks around and in small letters."""
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def pivotal(p: list[float], rng: random.Random) -> list[float]:
    """Round the probabilities in order; all but at most one come out as 0.0 or 1.0, and their sum is kept."""
    out = list(p)
    open_at = None
    for i, b in enumerate(out):
        if b <= 1e-12 or b >= 1 - 1e-12:
            out[i] = float(b > 0.5)
            continue
        if open_at is None:
            open_at = i
            continue
        a = out[open_at]
        if a + b < 1:
            gives, keeps = (open_at, i) if rng.random() < b / (a + b) else (i, open_at)
            out[gives], out[keeps] = 0.0, a + b
        else:
            gives, keeps = (open_at, i) if rng.random() < (1 - b) / (2 - a - b) else (i, open_at)
            out[gives], out[keeps] = 1.0, a + b - 1
        open_at = keeps if 1e-12 < out[keeps] < 1 - 1e-12 else None
        if open_at is None:
            out[keeps] = float(out[keeps] > 0.5)
    return out


def _round_block(seed: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "id"], kind="stable").reset_index(drop=True)
        rng = random.Random(xxhash.xxh3_64_intdigest("\x1f".join(map(str, key)), seed))
        p = pivotal(rows["p"].tolist(), rng)
        if last:
            p = [float(rng.random() < x) if 0 < x < 1 else x for x in p]
        rows["p"] = p
        rows["extra"] = pd.array([int(x) if x in (0.0, 1.0) else None for x in p], dtype="Int32")
        return rows[["mix_id", "source", "block", "id", "tokens", "p", "extra"]]

    return run


def mix(df: DataFrame, id_col: str, source_col: str, size_col: str, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(copies, report)`` for the mixes of ``targets(mix_id, source, target_share, max_repeats)``.

    ``copies(mix_id, id, source, tokens, copies)`` holds the documents with at least one copy; ``report(mix_id,
    source, target_share, max_repeats, available, budget, wanted, actual, budget_share, actual_share, reachable)`` one row
    per row of ``targets``: ``budget_share`` is the share of the budget, which meets the target wherever it is reachable;
    ``actual_share`` that of what the mix holds, larger where other sources fall short, as nothing takes their place. Documents with a null source, id or size are left out; those without tokens have no copies. A
    source without documents has 0 available and reaches its share only if that is 0. The same seed gives the same mix.
    """
    kind = df.select(id_col).dtypes[0][1]
    docs = df.select(F.col(id_col).alias("id"), clean_source(source_col).alias("source"), F.col(size_col).cast("long").alias("tokens"))
    docs = cut_lineage(docs.where("id is not null and source is not null and tokens > 0"))  # sizes are read several times
    stock = docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n"))
    wanted = targets.select("mix_id", F.col("source").alias("listed"), clean_source("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    wanted = wanted.join(stock, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    budget = wanted.groupBy("mix_id").agg(F.sum("available").alias("budget"))
    wanted = wanted.join(budget, "mix_id").withColumn("wanted", F.col("target_share") * F.col("budget"))
    wanted = wanted.withColumn("each", F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long")
    parts = docs.join(wanted.where("each > 0").select("mix_id", "source", "each", blocks.alias("blocks")), "source")
    parts = parts.withColumn("whole", F.floor("each")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    open_rows = parts.select("mix_id", "source", "block", "id", "tokens", (F.col("each") - F.col("whole")).alias("p"), F.lit(None).cast("int").alias("extra"))
    most = stock.agg(F.max("n")).first()[0] or 1
    left = max(1, -(-most // BLOCK_ROWS))
    decided = None
    while True:
        out = open_rows.groupBy("mix_id", "source", "block").applyInPandas(_round_block(seed, left == 1), _ROWS.format(id=kind))
        if left > 1:
            out = cut_lineage(out)  # both its decided and its open rows are read, the latter by all later levels
        done = out.where("extra is not null")
        decided = done if decided is None else decided.unionByName(done)
        if left == 1:
            break
        left = -(-left // FAN_IN)
        open_rows = out.where("extra is null").withColumn("block", F.floor(F.col("block") / FAN_IN))
    extra = decided.where("extra > 0").select("mix_id", "source", "id", "extra")
    copies = parts.join(extra, ["mix_id", "source", "id"], "left")
    copies = copies.select("mix_id", "id", "source", "tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")).where("copies > 0")
    given = copies.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual"))
    total = given.groupBy("mix_id").agg(F.sum("actual").alias("of"))
    report = wanted.join(given, ["mix_id", "source"], "left").join(total, "mix_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    # A source is out of reach if all its allowed copies are in the mix and are still too few.
    short = (F.col("actual") >= F.col("max_repeats") * F.col("available")) & (F.col("wanted") > F.col("actual"))
    report = report.select(
        "mix_id", F.col("listed").alias("source"), "target_share", "max_repeats", "available", "budget", "wanted", "actual",
        F.round(F.coalesce(F.try_divide("actual", "budget"), F.lit(0.0)), 6).alias("budget_share"),
        F.round(F.coalesce(F.try_divide("actual", "of"), F.lit(0.0)), 6).alias("actual_share"), (~short).alias("reachable"),
    )
    return copies, report
