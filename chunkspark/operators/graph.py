"""The document, section and chunk graph as two tables, and its use in retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nodes(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(doc_id, node_id, type, title, text, section_id)``: documents, sections and chunks, each once.

    Empty and null ids are no nodes; a chunk of an unknown section is one.
    """
    docs = sections.select("doc_id").unionByName(chunks.select("doc_id")).distinct()
    none = F.lit(None).cast("string")
    d = docs.select("doc_id", F.col("doc_id").cast("string").alias("node_id"), F.lit("doc").alias("type"), none.alias("title"), none.alias("text"), none.alias("section_id"))
    s = sections.where("section_id <> ''").select("doc_id", F.col("section_id").alias("node_id"), F.lit("section").alias("type"), F.col("section_title").alias("title"), "text", "section_id")
    c = chunks.where("chunk_id <> ''").select("doc_id", F.col("chunk_id").alias("node_id"), F.lit("chunk").alias("type"), F.col("section_title").alias("title"), "text", "section_id")
    return d.unionByName(s.dropDuplicates(["doc_id", "node_id"])).unionByName(c.dropDuplicates(["doc_id", "node_id"]))


def edges(sections: DataFrame, chunks: DataFrame, add_next: bool = True, add_sibling: bool = False) -> DataFrame:
    """``(doc_id, src, dst, relation)``: has_section, has_chunk (for known sections), next between neighbouring chunks
    of a section, and on request sibling between all chunks of a section in both directions (as a join on the section,
    so its size is that of the relation). Each edge once."""
    s = sections.where("section_id <> ''").select("doc_id", "section_id").distinct()
    c = chunks.where("chunk_id <> ''").select("doc_id", "section_id", "chunk_id", "chunk_ord")
    out = s.select("doc_id", F.col("doc_id").cast("string").alias("src"), F.col("section_id").alias("dst"), F.lit("has_section").alias("relation"))
    out = out.unionByName(c.join(s, ["doc_id", "section_id"]).select("doc_id", F.col("section_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("has_chunk").alias("relation")))
    if add_next:
        w = Window.partitionBy("doc_id", "section_id").orderBy("chunk_ord", "chunk_id")
        following = c.select("doc_id", F.col("chunk_id").alias("src"), F.lead("chunk_id").over(w).alias("dst"), F.lit("next").alias("relation"))
        out = out.unionByName(following.where("dst is not null"))
    if add_sibling:
        other = c.select("doc_id", "section_id", F.col("chunk_id").alias("dst"))
        out = out.unionByName(c.withColumnRenamed("chunk_id", "src").join(other, ["doc_id", "section_id"]).where("src <> dst").select("doc_id", "src", "dst", F.lit("sibling").alias("relation")))
    return out.dropDuplicates(["doc_id", "src", "dst"])


def counts(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(doc_id, num_nodes, num_edges)`` without building the graph: all chunks in known sections."""
    c = chunks.groupBy("doc_id", "section_id").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.sum(F.col("n") - 1).alias("nexts"))
    s = sections.groupBy("doc_id").agg(F.count("*").alias("sections"))
    both = s.join(c, "doc_id", "full").fillna(0, ["sections", "chunks", "nexts"])
    return both.select("doc_id", (1 + F.col("sections") + F.col("chunks")).alias("num_nodes"), (F.col("sections") + F.col("chunks") + F.col("nexts")).alias("num_edges"))


def expand_hits(hits: DataFrame, chunks: DataFrame, edges_: DataFrame | None) -> DataFrame:
    """``(query_id, hit_rank, is_neighbor, doc_id, chunk_id, section_title, text, score)``: each hit of ``hits(query_id,
    doc_id, chunk_id, score, rank)`` and the chunk behind it.

    A chunk appears once per query, where it comes first: a neighbour has the score of its hit, and a hit that came as
    a neighbour keeps that place, but its own neighbour is still added. Without ``edges_`` only the hits.
    """
    out = hits.select("query_id", "doc_id", "chunk_id", "score", F.col("rank").alias("hit_rank"), F.lit(0).alias("is_neighbor"))
    if edges_ is not None:
        after = edges_.where("relation = 'next'").select("doc_id", F.col("src").alias("chunk_id"), "dst")
        behind = out.join(after, ["doc_id", "chunk_id"]).select("query_id", "doc_id", F.col("dst").alias("chunk_id"), "score", "hit_rank", F.lit(1).alias("is_neighbor"))
        out = out.unionByName(behind)
    first = Window.partitionBy("query_id", "doc_id", "chunk_id").orderBy("hit_rank", "is_neighbor")
    out = out.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    known = chunks.select("doc_id", "chunk_id", "section_title", "text").dropDuplicates(["doc_id", "chunk_id"])
    return out.join(known, ["doc_id", "chunk_id"], "left").select("query_id", "hit_rank", "is_neighbor", "doc_id", "chunk_id", "section_title", "text", "score")
