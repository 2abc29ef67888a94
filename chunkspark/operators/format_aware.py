"""Chunks along the markdown structure: headings outside code fences begin chunks, leading fenced blocks are chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkspark.functions.text import LINE_BREAK, OTHER_BREAKS, SPACE, col, keep_text, let, lines, strip

_FENCE = "```"
_HEADING = rf"^#{{1,6}}{SPACE}+"


def format_aware(c: Column | str) -> Column:
    """Array of chunks, by one fold over the lines of the text.

    Until the first line outside a fence, each fenced block is a chunk of its own; from then on a chunk begins at
    each heading outside a fence, fences stay in their chunk, and one that is never closed takes all the rest.
    The fold keeps whether it is inside a fence, whether text has begun, and the finished chunks; the text of a
    chunk is the slice between its first and last line.
    """
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("begun"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("cuts"))

    def step(state: Column, line: Column) -> Column:
        fence = F.startswith(strip(line), F.lit(_FENCE))
        outside = ~state["inside"]
        plain = ~fence & outside
        first = plain & ~state["begun"]
        cut = F.when(state["begun"], plain & line.rlike(_HEADING)).otherwise(first | fence & outside)
        return F.struct(
            (state["inside"] != fence).alias("inside"),
            (state["begun"] | first).alias("begun"),
            (state["i"] + 1).alias("i"),
            F.when(cut, F.concat(state["cuts"], F.array(state["i"]))).otherwise(state["cuts"]).alias("cuts"),
        )

    def join(all_lines: Column, cuts: Column) -> Column:
        return F.transform(cuts, lambda x, i: F.array_join(F.slice(all_lines, x + 1, F.coalesce(F.get(cuts, i + 1), F.size(all_lines)) - x), "\n"))

    def chunks(all_lines: Column) -> Column:
        return let(F.aggregate(all_lines, start, step, lambda s: s["cuts"]), lambda cuts: join(all_lines, cuts))

    # Without fences and headings all lines are one chunk.
    one = F.when(col(c).rlike(f"[{OTHER_BREAKS}]"), F.regexp_replace(col(c), LINE_BREAK, "\n")).otherwise(col(c))
    structured = F.contains(col(c), F.lit(_FENCE)) | F.contains(col(c), F.lit("#"))
    return keep_text(F.when(structured, let(lines(c), chunks)).otherwise(F.array(one)))
