"""Readers and writers of the file formats in use."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkspark.functions.clean import clean_text
from chunkspark.functions.text import is_blank, strip

RESULT_SCHEMA = "method string, num_chunks long, avg_chunk_len double, std_chunk_len double, max_chunk_len long, min_chunk_len long, total_chars long, compression_ratio double, chunks array<string>"
RETRIEVAL_SCHEMA = "method string, recall_at_k double, recall double, num_chunks long, k long, total_queries long, hits long"

#: Queries that are used where no file of queries is given.
DEMO_QUERIES = [
    ("how is a document cut into chunks", ["chunk", "segment"]),
    ("which nodes does the graph have", ["node", "section"]),
    ("how large may a chunk be", ["token", "limit"]),
    ("how is retrieval measured", ["recall", "hit"]),
]


def file_stem(name: Column | str) -> Column:
    """A file name without its last extension; ``doc`` where nothing is left."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), F.lit("")), F.lit("doc"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)``: one row per text file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(file_stem(F.col("_metadata.file_name")).alias("doc_id"), F.col("value").alias("text"))


def read_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Lines of JSON objects with their file name; lines that are no such object are skipped."""
    rows = spark.read.schema(f"{schema}, __bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad")
    return rows.select("*", F.col("_metadata.file_name").alias("file")).where("__bad is null").drop("__bad")


def usable_chunks(results: DataFrame) -> DataFrame:
    """Rows with a method (stripped) and at least one chunk that is not blank; chunks stay as they are."""
    rows = results.withColumn("method", strip("method")).where("method <> '' and size(chunks) > 0")
    return rows.withColumn("chunks", F.filter("chunks", lambda x: ~is_blank(x)))


def explode_chunks(results: DataFrame) -> DataFrame:
    """``(file, method, chunk_ord, text)`` of all rows whose chunks are a list."""
    return results.where("chunks is not null").select("file", "method", F.posexplode("chunks").alias("chunk_ord", "text"))


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of retrieval runs with ``doc``, the document their file is named for; files of runs at k = 1 (named
    ``..._k1.jsonl``) are left out, and so are lines without a method."""
    rows = read_results(spark, path, RETRIEVAL_SCHEMA).where(~F.endswith("file", F.lit("_k1.jsonl")))
    return rows.where("method is not null").withColumn("doc", F.regexp_replace(file_stem("file"), "_retrieval$", ""))


QUERY_SCHEMA = "query string, must_contain array<string>"


def read_queries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(query, must_contain)`` of files that hold an array of queries each; entries without both are dropped.

    Each file is read as JSON, else as YAML where the package is installed. Without a path, or where nothing can be
    read, the four built-in queries.
    """
    demo = spark.createDataFrame(DEMO_QUERIES, QUERY_SCHEMA)
    if path is None:
        return demo

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q["query"], q["must_contain"]) for text in pdf["value"] for q in _entries(text) if isinstance(q, dict) and isinstance(q.get("query"), str) and isinstance(q.get("must_contain"), list)]
            yield pd.DataFrame({"query": [r[0] for r in rows], "must_contain": [[str(x) for x in r[1]] for r in rows]}, dtype=object)

    found = spark.read.text(path, wholetext=True).mapInPandas(run, QUERY_SCHEMA)
    return found if found.take(1) else demo


def _entries(text: str) -> list:
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml

            found = yaml.safe_load(text)
        except Exception:  # noqa: BLE001  no such package, or no such file: nothing to read
            found = []
    return found if isinstance(found, list) else []


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``(method, total_chunks, recall, ordinal)`` of a CSV table with blanks around names and values."""
    raw = spark.read.csv(path, header=True)
    for name in raw.columns:
        raw = raw.withColumnRenamed(name, name.strip())
    recall = next(c for c in raw.columns if c.startswith("recall"))
    return raw.select(F.trim("method").alias("method"), F.trim("total_chunks").cast("double").cast("long").alias("total_chunks"), F.trim(f"`{recall}`").cast("double").alias("recall"), F.monotonically_increasing_id().alias("ordinal"))


def normalized_name(name: Column | str) -> Column:
    """File names in small letters with underscores for blanks (as a mapping; nothing is renamed)."""
    name = F.col(name) if isinstance(name, str) else name
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], str | None] | None = None, second: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """``(doc_id, text)`` of PDF files by ``extract`` (the optional pdfminer package by default), and where that fails or
    finds only blanks by ``second``; null where both fail."""

    def run(batches):
        get = extract or _pdfminer
        for pdf in batches:
            texts = [_quietly(get, c) for c in pdf["content"]]
            if second is not None:
                texts = [t if t and t.strip() else _quietly(second, c) for t, c in zip(texts, pdf["content"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    files = spark.read.format("binaryFile").load(path).select(file_stem(F.element_at(F.split("path", "/"), -1)).alias("doc_id"), "content")
    return files.mapInPandas(run, "doc_id string, text string")


def _quietly(get: Callable[[bytes], str | None], content: bytes) -> str | None:
    try:
        return get(content)
    except Exception:
        return None


def _pdfminer(content: bytes) -> str | None:
    import io

    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(content))


def prepare(documents: DataFrame, existing: DataFrame | None = None, least: int = 2000, limit: int | None = None) -> DataFrame:
    """Cleaned ``documents(doc_id, text)`` of at least ``least`` code points; those in ``existing(doc_id)`` and blank
    ones are skipped. ``limit`` takes the first documents by id, as a feature of the command."""
    rows = documents if limit is None else documents.orderBy("doc_id").limit(limit)
    if existing is not None:
        rows = rows.join(existing.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.where(~is_blank("text")).select("doc_id", clean_text("text").alias("text")).where(F.length("text") >= least)


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line and row."""
    results.write.mode(mode).json(path)
