"""Structured Streaming over the stateless operators, and evaluation per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkspark.operators import chunkers, segment
from chunkspark.sources.readers import file_stem


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)``: new text files as they come."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(file_stem(F.col("_metadata.file_name")).alias("doc_id"), F.col("value").alias("text"))


def segment_stream(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    return segment.segments(docs, sep=sep)


def chunk_stream(docs: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Chunks of each document as it comes: append mode without state."""
    return chunkers.chunk_all(docs, methods)


def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet once for what is there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``run(batch, batch_id)`` for top-k and recall, which look at all rows of a batch."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
