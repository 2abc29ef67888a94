"""Sections materialised from segments, and sections cut into overlapping token windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkspark.functions.text import is_blank, let, span, strip, token_estimate, tokens


def materialize(hierarchy: DataFrame, segments: DataFrame) -> DataFrame:
    """``(doc_id, section_id, sec_order, section_title, text)`` from ``hierarchy(doc_id, sections)``.

    Segments come in the order in which a section lists them, joined by empty lines; unknown, null and blank ones are
    left out, and a section without text stays, with "". Of a repeated segment_id the last by seg_order counts.
    A missing section id is ``s`` and its place from 1, a missing title ``Untitled``.
    """
    rows = hierarchy.select("doc_id", F.posexplode("sections").alias("sec_order", "s"))
    members = rows.select(
        "doc_id", "sec_order",
        F.coalesce("s.section_id", F.concat(F.lit("s"), F.col("sec_order") + 1)).alias("section_id"),
        F.coalesce("s.section_title", F.lit("Untitled")).alias("section_title"),
        F.posexplode_outer("s.segment_ids").alias("place", "segment_id"),
    )
    return materialize_members(members, segments)


def materialize_members(members: DataFrame, segments: DataFrame) -> DataFrame:
    """The same from ``members(doc_id, sec_order, section_id, section_title, place, segment_id)``, a row per listed
    segment, so that no document has to fit into one row."""
    last = segments.where("doc_id is not null and segment_id is not null and segment_id <> ''").groupBy("doc_id", "segment_id").agg(F.max_by("text", "seg_order").alias("text"))
    rows = members.join(last, ["doc_id", "segment_id"], "left")
    piece = F.when(~is_blank("text"), F.struct("place", strip("text").alias("t")))
    grouped = rows.groupBy("doc_id", "sec_order", "section_id", "section_title").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    return grouped.select("doc_id", "section_id", "sec_order", "section_title", F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"))


def windows(words: Column, most: int, overlap: int) -> Column:
    """Windows of ``most`` words, each beginning ``overlap`` words before the end of the one before."""
    step = most - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        count = F.when(n <= most, F.least(n, F.lit(1))).otherwise(1 + F.ceil((n - most) / F.lit(step)))
        return F.transform(span(count), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(most)), " "))

    return let(words, cut)


def rechunk(sections: DataFrame, max_tokens: int = 500, overlap: int = 50, short_circuit: bool = True, tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(doc_id, section_id, chunk_ord, chunk_id, section_title, text)`` of ``sections``.

    A blank section has no chunk. One whose estimated tokens (a quarter of its length) don't exceed ``max_tokens`` is
    one chunk with its white space kept; others become windows of words joined by single blanks. ``overlap`` is held
    between 0 and ``max_tokens - 1``; a ``max_tokens`` of 0 or less raises. Chunk ids are doc, section and place.
    ``tokenize`` makes an array of token strings of a text column (such as a pandas UDF around a tokenizer); with one of
    one's own no section is let through by its estimate.
    """
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    overlap = min(max(overlap, 0), max_tokens - 1)
    text = strip("text")
    parts = windows((tokenize or tokens)(text), max_tokens, overlap)
    if short_circuit and tokenize is None:
        parts = F.when(token_estimate(text) <= max_tokens, F.array(text)).otherwise(parts)
    rows = sections.where(~is_blank("text")).select("doc_id", F.coalesce("section_id", F.lit("s")).alias("section_id"), F.coalesce("section_title", F.lit("")).alias("section_title"), F.posexplode(parts).alias("chunk_ord", "text"))
    return rows.select("doc_id", "section_id", "chunk_ord", F.concat_ws("-", "doc_id", "section_id", "chunk_ord").alias("chunk_id"), "section_title", "text")
