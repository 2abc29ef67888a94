"""Chunking strategies: each maps a text column to an array of chunks, without a shuffle or a Python worker.

``REGISTRY`` names them; ``chunk_all`` runs any of them over a table in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkspark.functions.text import col, keep_text, let, sentences, span, split_literal, strip, token_estimate, tokens
from chunkspark.operators.format_aware import format_aware
from chunkspark.operators.hierarchy import HEADING
from chunkspark.operators.sections import windows

EMPTY = "array<string>"


def _windows(c: Column | str, size: int, step: int) -> Column:
    """Code-point windows of the stripped text, the last one short, none that begins behind the end."""

    def cut(text: Column) -> Column:
        n = F.length(text)
        count = F.ceil(n / size) if step == size else F.least(1 + F.ceil(F.greatest(n - size, F.lit(0)) / step), F.ceil(n / step))
        if size % step == 0:  # pieces found in one pass: a window far behind isn't counted off from the beginning
            pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
            return pieces if step == size else let(pieces, lambda p: F.transform(span(count), lambda i: F.array_join(F.slice(p, i + 1, F.lit(size // step)), "")))
        return F.transform(span(count), lambda i: F.substring(text, i * step + 1, F.lit(size)))

    return let(strip(c), cut)


def fixed(c: Column | str, size: int = 800) -> Column:
    """Windows of ``size`` code points side by side."""
    if size <= 0:
        raise ValueError("size must be positive")
    return keep_text(_windows(c, size, size))


def sliding(c: Column | str, size: int = 800, stride: int = 400) -> Column:
    """Windows of ``size`` code points, one every ``stride``; the first that reaches the end is the last."""
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    return keep_text(_windows(c, size, stride))


def group_sentences(pieces: Column, per: int = 3) -> Column:
    """Neighbouring sentences joined by a blank, ``per`` at a time."""
    return let(pieces, lambda p: F.transform(span(F.ceil(F.size(p) / per)), lambda i: F.array_join(F.slice(p, i * per + 1, F.lit(per)), " ")))


def sentence(c: Column | str, per: int = 3, split: Callable[[Column | str], Column] = sentences) -> Column:
    """Neighbouring sentences, ``per`` at a time; ``split`` makes an array of sentences of a text column (a pandas UDF
    around a sentence tokenizer may take the place of the plain rule)."""
    return keep_text(group_sentences(split(c), per))


def paragraphs(c: Column | str) -> Column:
    """Parts between empty lines, as they are."""
    return split_literal(c, "\n\n")


def paragraph(c: Column | str) -> Column:
    return keep_text(paragraphs(c))


def _long_paragraphs(c: Column | str, most: int, cut: Callable[[Column], Column]) -> Column:
    return keep_text(F.flatten(F.transform(paragraphs(c), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(cut(p)))))


def recursive(c: Column | str, most: int = 800, size: int = 800) -> Column:
    """Paragraphs; those longer than ``most`` by groups of three sentences; longer groups by windows of ``size``."""
    short = lambda g: F.when(F.length(g) <= most, F.array(g)).otherwise(_windows(g, size, size))
    return _long_paragraphs(c, most, lambda p: F.flatten(F.transform(group_sentences(sentences(p)), short)))


def hybrid(c: Column | str, most: int = 800) -> Column:
    """Paragraphs; those longer than ``most`` by groups of three sentences, however long."""
    return _long_paragraphs(c, most, lambda p: group_sentences(sentences(p)))


def delimiter(c: Column | str, marks: tuple[str, ...] = ("---", "###")) -> Column:
    """Parts between the first of ``marks`` that occurs in the text; paragraphs where none does."""
    out = paragraphs(c)
    for mark in reversed(marks):
        out = F.when(F.contains(col(c), F.lit(mark)), split_literal(c, mark)).otherwise(out)
    return keep_text(out)


Tokenizer = tuple[Callable[[str], list[int]], Callable[[list[int]], str]]


def token_limit(c: Column | str, limit: int = 800, load: Callable[[], Tokenizer] | None = None) -> Column:
    """Runs of ``limit`` tokens. ``load`` is called once per Python worker and gives the functions that encode and
    decode; where no tokenizer is at hand, a token stands for a code point: the same as ``fixed``."""
    if load is None:
        return fixed(c, limit)
    if limit <= 0:
        raise ValueError("limit must be positive")

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = load()
        for texts in batches:
            yield texts.fillna("").map(lambda t: [decode(ids[i : i + limit]) for ids in [encode(t)] for i in range(0, len(ids), limit)])

    return keep_text(run(col(c)))


def semantic(c: Column | str, load: Callable[[], Callable[[str], list[str]]] | None = None) -> Column:
    """Chunks of a model: ``load`` is called once per Python worker and gives a function from a text to its chunks.
    Where none is at hand, or it fails on a text or finds nothing: groups of three sentences."""
    plain = sentence(c, 3)
    if load is None:
        return plain

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield texts.map(lambda t: _or_none(model, t))

    found = keep_text(run(col(c)))
    return F.when(F.size(found) > 0, found).otherwise(plain)


def _or_none(model: Callable[[str], list[str]], text: str | None) -> list[str] | None:
    try:
        return list(model(text)) if text else None
    except Exception:  # noqa: BLE001  the plain rule takes its place
        return None


def hierarchical(c: Column | str, max_tokens: int = 200, overlap: int = 30, every: int = 5) -> Column:
    """Paragraphs gathered into sections by the rule of ``hierarchy.rule_sections``, and these cut into windows of
    words: the whole pipeline of a document as one expression."""

    def step(state: Column, segment: Column) -> Column:
        cut = segment.rlike(HEADING) | (state["since"] == 0)
        following = F.when(cut, F.lit(1)).otherwise(state["since"] + 1) % every
        return F.struct(following.alias("since"), (state["i"] + 1).alias("i"), F.when(cut, F.concat(state["cuts"], F.array(state["i"]))).otherwise(state["cuts"]).alias("cuts"))

    def gather(segments: Column, cuts: Column) -> Column:
        return F.transform(cuts, lambda x, i: F.array_join(F.slice(segments, x + 1, F.coalesce(F.get(cuts, i + 1), F.size(segments)) - x), "\n\n"))

    start = F.struct(F.lit(0).alias("since"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("cuts"))
    sections = let(keep_text(paragraphs(c)), lambda segments: let(F.aggregate(segments, start, step, lambda s: s["cuts"]), lambda cuts: gather(segments, cuts)))
    cut = lambda s: F.when(token_estimate(s) <= max_tokens, F.array(s)).otherwise(windows(tokens(s), max_tokens, overlap))
    return keep_text(F.flatten(F.transform(sections, cut)))


REGISTRY: dict[str, Callable[[Column | str], Column]] = {
    "fixed": fixed,
    "sliding": sliding,
    "sentence": sentence,
    "paragraph": paragraph,
    "recursive": recursive,
    "hybrid": hybrid,
    "delimiter": delimiter,
    "token_limit": token_limit,
    "semantic": semantic,
    "format_aware": format_aware,
    "hierarchical": hierarchical,
}
#: Without models and tokenizers these methods give the same chunks as others, which are computed once for both.
_SAME = {"token_limit": "fixed", "semantic": "sentence"}


def chunk_arrays(df: DataFrame, methods: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, method, source_len, chunks)``, one row per document and method; one scan for all methods.

    Unknown methods are left out. A null text counts as empty: it has no chunks.
    """
    names = [m for m in (REGISTRY if methods is None else methods) if m in REGISTRY]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    if not names:
        return rows.select("doc_id", F.lit("").alias("method"), F.lit(0).alias("source_len"), F.array().cast(EMPTY).alias("chunks")).limit(0)
    chunks = dict.fromkeys(_SAME.get(m, m) for m in names)
    rows = rows.select("doc_id", "text", *[REGISTRY[m]("text").alias(f"by_{m}") for m in chunks])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"by_{_SAME.get(m, m)}").alias("chunks")) for m in names]))
    return rows.select("doc_id", F.length("text").alias("source_len"), each.alias("r")).select("doc_id", "r.method", "source_len", "r.chunks")


def chunk_all(df: DataFrame, methods: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, method, chunk_ord, text)`` for the named methods (all of the registry by default)."""
    arrays = chunk_arrays(df, methods, id_col, text_col)
    return arrays.select("doc_id", "method", F.posexplode("chunks").alias("chunk_ord", "text"))


def chunked_once(methods: Iterable[str] | None = None) -> dict[str, list[str]]:
    """Method -> the named methods that have its chunks, itself first: what is to be computed once for all of them."""
    out: dict[str, list[str]] = {}
    for m in REGISTRY if methods is None else methods:
        if m in REGISTRY:
            out.setdefault(_SAME.get(m, m), []).append(m)
    return out


def chunk_stats(arrays: DataFrame, by: list[str]) -> DataFrame:
    """Number and lengths of chunks per group of ``chunk_arrays`` rows; the compression ratio is the length of the raw
    text over that of all chunks (0 without any)."""
    sizes = F.transform("chunks", lambda x: F.length(x).cast("long"))
    rows = arrays.select(*by, F.col("source_len").cast("long").alias("source_len"), F.explode_outer(sizes).alias("n"), F.size("chunks").alias("of"))
    # One row of each document carries its raw length.
    share = F.when(F.col("of") > 0, F.col("source_len") / F.col("of")).otherwise(F.col("source_len"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return rows.withColumn("share", share).groupBy(*by).agg(
        F.count("n").alias("num_chunks"),
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_chunk_len"),
        F.round(F.coalesce(F.stddev_pop("n"), F.lit(0.0)), 6).alias("std_chunk_len"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_chunk_len"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_chunk_len"),
        total.alias("total_chars"),
        F.round(F.coalesce(F.round(F.sum("share"), 3) / F.nullif(total, F.lit(0)), F.lit(0.0)), 4).alias("compression_ratio"),
    )


def token_stats(arrays: DataFrame, by: list[str]) -> DataFrame:
    """Estimated tokens of chunks (a quarter of the length, at least 1) per group."""
    rows = arrays.select(*by, F.explode("chunks").alias("x")).select(*by, F.greatest(F.lit(1), F.expr("length(x) div 4")).alias("n"))
    return rows.groupBy(*by).agg(F.round(F.avg("n"), 6).alias("avg_tokens"), F.max("n").alias("max_tokens"), F.min("n").alias("min_tokens"))
