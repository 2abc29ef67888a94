"""Queries p1 to p8 over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkspark.llm import mixing, near_dup, packing, pairs, quality, scan_repair, sentences, split_oversized
from chunkspark.llm.token_count import DUCKDB, token_count
from chunkspark.session import spread


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.repair(_table(spark, folder, "enhancing_multimodal_protein"), "doc_id", "text")[1]


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.paragraphs(scan_repair.repair(_table(spark, folder, "enhancing_multimodal_protein"), "doc_id", "text")[0])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = near_dup.near_duplicates(_table(spark, folder, "chunk"), "chunk_id", "text", threshold=0.65, k=3, least_words=60)
    return near_dup.expand_pairs(members, links).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    members, links = near_dup.near_duplicates(_table(spark, folder, "chunk"), "chunk_id", "text", threshold=0.8, k=5)
    return near_dup.link_counts(members, links).withColumnRenamed("id", "chunk_id")


LIMIT, OVERLAP = 2000, 200


def _split(spark: SparkSession, folder: str) -> DataFrame:
    sections = split_oversized.split_oversized(_table(spark, folder, "section"), ["doc_id", "section_id"], "text", LIMIT, OVERLAP, "loaded_at")
    chunks = split_oversized.split_oversized(_table(spark, folder, "chunk"), ["doc_id", "chunk_id"], "text", LIMIT, OVERLAP, "loaded_at")
    named = [df.withColumnRenamed(key, "item_id").withColumn("kind", F.lit(kind)) for df, key, kind in ((sections, "section_id", "section"), (chunks, "chunk_id", "chunk"))]
    return named[0].unionByName(named[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).where("piece = 0 and unit <> 'whole'").select("kind", "doc_id", "item_id", F.col("unit").alias("boundary"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).select("kind", "doc_id", "item_id", "piece", "start", "stop", "cut")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["doc_id", "segment_id"]
    return sentences.sentence_units(_table(spark, folder, "segment"), keys, "text").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, folder, "segment"), ["doc_id", "segment_id"], "text", "summary")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", "source", token_count("text").alias("tokens"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_sizes(spark, folder), "doc_id", "tokens", _table(spark, folder, "container"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("parts > 1 and part = 0").select(F.col("capacity").cast("int").alias("capacity"), F.col("id").alias("doc_id"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_packed(spark, folder))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sizes(spark, folder), "doc_id", "source", "tokens", _table(spark, folder, "mix_target"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1].where("not reachable").select("mix_id", "source")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_statistics(spark, folder).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_statistics(_table(spark, folder, "documents"), ["doc_id"], "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_links, p3_found, p3_pieces, p4_found, p5_found, p6_found, p6_fill, p6_containers, p7_found, p7_report, p7_copies, p8_found, p8_statistics)}


_TOKENS = DUCKDB.format("text")
_SOURCE = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"select c.capacity, d.doc_id from documents d join container c on {_TOKENS} > c.capacity",
        "p7_found": f"""
            with docs as (select {_SOURCE.format("source")} as src, {_TOKENS} as tokens from documents where source is not null and text is not null),
            stock as (select src, sum(tokens) as available from docs group by src),
            rows_ as (select m.*, coalesce(s.available, 0) as available from mix_target m left join stock s on {_SOURCE.format("m.source")} = s.src)
            select mix_id, source from (select *, sum(available) over (partition by mix_id) as budget from rows_)
            where target_share * budget > max_repeats * available""",
    }
