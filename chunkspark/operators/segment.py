"""Documents cut into segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkspark.functions.text import keep_text, split_literal


def segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sep: str = "\n\n") -> DataFrame:
    """``(doc_id, segment_id, seg_order, text)``: the stripped parts between ``sep``, blank ones dropped, numbered from
    0 behind that. A null or blank text has none."""
    parts = F.posexplode(keep_text(split_literal(text_col, sep))).alias("seg_order", "text")
    rows = df.select(F.col(id_col).alias("doc_id"), parts)
    return rows.select("doc_id", F.concat(F.lit("seg_"), F.col("seg_order")).alias("segment_id"), "seg_order", "text")
