"""From documents to chunks, graph and report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkspark.operators import graph, hierarchy, sections, segment
from chunkspark.session import written


class Ingested(NamedTuple):
    segments: DataFrame
    sections: DataFrame
    chunks: DataFrame


def ingest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sep: str = "\n\n", max_tokens: int = 200, overlap: int = 30, responses: DataFrame | None = None, write: bool = False) -> Ingested:
    """Segments, sections and chunks of ``df``; ``responses(doc_id, response)`` are a model's hierarchies, by default
    the rule's. All of it is lazy and keyed by document, unless the sections are to be written once (``write``) because
    several results are read from them."""
    segments = segment.segments(df, id_col, text_col, sep)
    answers = hierarchy.rule_responses(hierarchy.summarize(segments)) if responses is None else responses
    parts = sections.materialize(hierarchy.induce_hierarchy(segments, answers), segments)
    parts = written(parts) if write else parts
    return Ingested(segments, parts, sections.rechunk(parts, max_tokens, overlap))


def report(parts: Ingested) -> DataFrame:
    """``(doc_id, num_segments, num_sections, num_chunks, num_graph_nodes, num_graph_edges)``."""
    n_segments = parts.segments.groupBy("doc_id").agg(F.count("*").alias("num_segments"))
    n_sections = parts.sections.groupBy("doc_id").agg(F.count("*").alias("num_sections"))
    n_chunks = parts.chunks.groupBy("doc_id").agg(F.count("*").alias("num_chunks"))
    g = graph.counts(parts.sections, parts.chunks).select("doc_id", F.col("num_nodes").alias("num_graph_nodes"), F.col("num_edges").alias("num_graph_edges"))
    out = n_segments.join(n_sections, "doc_id", "left").join(n_chunks, "doc_id", "left").join(g, "doc_id", "left")
    return out.fillna(0)
