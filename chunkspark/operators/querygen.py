"""Query sets from texts: keywords, prompts, tolerant parsing of answers, and deterministic fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkspark.functions.text import col, is_blank, keyword_tokens, strip
from chunkspark.operators.hierarchy import Client, strip_fences

# Questions of the fallback set, and its needles for a text without keywords.
FALLBACK_QUESTIONS = [
    "What primary problem does this paper address?",
    "How is the core method or approach defined?",
    "What assumptions are made about the entities or variables?",
    "Which theoretical results or propositions are central?",
    "How does the proposed method compare with prior work?",
    "What datasets, simulations, or examples illustrate the approach?",
    "How are efficiency or performance metrics characterized?",
    "What are key limitations or open challenges noted?",
    "What broader implications follow from the findings?",
    "How does the paper position itself in related literature?",
]
FALLBACK_NEEDLES = ["method", "result", "approach", "model", "analysis", "data", "performance"]
PER_SET = 10


def top_keywords(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 25) -> DataFrame:
    """``(doc_id, rank, keyword, n)``: the k most frequent keywords, ties by first occurrence."""
    words = df.select(F.col(id_col).alias("doc_id"), F.posexplode(keyword_tokens(text_col)).alias("pos", "keyword"))
    counts = words.groupBy("doc_id", "keyword").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "rank", "keyword", "n")


def keyword_lists(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 40) -> DataFrame:
    """``(doc_id, keywords)`` for every document, with an empty list where there are none."""
    top = top_keywords(df, id_col, text_col, k).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("ranked"))
    lists = top.select("doc_id", F.transform("ranked", lambda r: r["keyword"]).alias("keywords"))
    docs = df.select(F.col(id_col).alias("doc_id")).distinct()
    return docs.join(lists, "doc_id", "left").select("doc_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def fallback_queries(lists: DataFrame) -> DataFrame:
    """``(doc_id, query_no, query, must_contain)``: ten questions per row of ``lists(doc_id, keywords)``, each with up
    to four neighbouring keywords of the first 35, going on by four and around."""
    questions = F.posexplode(F.array(*[F.lit(q) for q in FALLBACK_QUESTIONS])).alias("query_no", "query")
    words = F.when(F.size("keywords") > 0, F.slice("keywords", 1, 35)).otherwise(F.array(*[F.lit(w) for w in FALLBACK_NEEDLES]))
    rows = lists.select("doc_id", words.alias("kw"), questions)
    return rows.select("doc_id", "query_no", "query", F.slice("kw", F.pmod(F.col("query_no") * 4, F.size("kw")) + 1, F.lit(4)).alias("must_contain"))


def prompt(text: Column | str, name: Column | str, keywords: Column | str) -> Column:
    """The request for ten queries with needles, holding the first 25 keywords and the text."""
    return F.concat(
        F.lit(f"Write {PER_SET} questions that the paper answers, as a JSON array of objects with the keys query and must_contain (3 to 6 word stems of the answer).\nPaper: "),
        col(name), F.lit("\nKeywords: "), F.array_join(F.slice(col(keywords), 1, 25), ", "), F.lit("\nText:\n"), col(text),
    )


def parse_queries(raw: Column | str) -> Column:
    """Array of (query, must_contain) in an answer: a JSON array, perhaps in a code fence or among other words.

    Entries need a query that is not blank and a list of needles; needles come out in small letters with the blanks
    around them, blank ones are dropped. Anything else gives an empty array.
    """
    text = strip_fences(raw)
    inner = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(inner, "array<struct<query:string,must_contain:array<string>>>")
    kind = "struct<query:string,must_contain:array<string>>"
    usable = F.filter(F.coalesce(parsed, F.array().cast(f"array<{kind}>")), lambda q: (F.coalesce(strip(q["query"]), F.lit("")) != "") & (F.coalesce(F.size(q["must_contain"]), F.lit(0)) > 0))
    needles = lambda q: F.transform(F.filter(q["must_contain"], lambda n: ~is_blank(n)), lambda n: F.lower(n))
    return F.transform(usable, lambda q: F.struct(strip(q["query"]).alias("query"), needles(q).alias("must_contain")))


def answers_with(df: DataFrame, make_client: Callable[[], Client], id_col: str = "doc_id", text_col: str = "text", max_chars: int = 12_000) -> DataFrame:
    """``(doc_id, response)``: the answers of a client to ``prompt``, one client per Python worker. One that fails gives
    an empty answer, which ``generate`` replaces or leaves out."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, max_chars).alias("text"))
    asked = docs.join(keyword_lists(docs), "doc_id").select("doc_id", prompt("text", F.col("doc_id").cast("string"), "keywords").alias("response"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for pdf in batches:
            client = client or make_client()
            yield pdf.assign(response=[_quietly(client, p) for p in pdf["response"]])

    return asked.mapInPandas(run, asked.schema)


def _quietly(client: Client, prompt_: str) -> str:
    try:
        return client(prompt_) or ""
    except Exception:  # noqa: BLE001  the document then has no usable answer
        return ""


def job(documents: DataFrame, make_client: Callable[[], Client] | None = None, existing: DataFrame | None = None, limit: int | None = None, overwrite: bool = False, max_chars: int = 12_000, allow_fallback: bool = False) -> DataFrame:
    """Query sets for the first ``limit`` of ``documents(doc_id, text)`` by id (all without a limit, which is a feature
    of the command); those in ``existing(doc_id)`` are skipped unless they shall be overwritten."""
    docs = documents if limit is None else documents.orderBy("doc_id").limit(limit)
    known = None if overwrite else existing
    if known is not None:
        docs = docs.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
    answers = None if make_client is None else answers_with(docs, make_client, max_chars=max_chars)
    return generate(docs, answers, max_chars=max_chars, allow_fallback=allow_fallback)


def generate(df: DataFrame, answers: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 12_000, allow_fallback: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """``(doc_id, query_no, query, must_contain)`` for the documents that ``existing(doc_id)`` doesn't hold.

    ``answers(doc_id, response)`` come from a model; one with exactly ten usable queries is taken, the other documents
    get the fallback set if that is allowed. Only the first ``max_chars`` of a text are read for keywords, as the
    prompt shows no more of it.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, max_chars).alias("text"))
    if existing is not None:
        docs = docs.join(existing.select("doc_id").distinct(), "doc_id", "left_anti")
    taken = None
    if answers is not None:
        good = answers.select("doc_id", parse_queries("response").alias("qs")).where(F.size("qs") == PER_SET).join(docs.select("doc_id"), "doc_id", "left_semi")
        taken = good.select("doc_id", F.posexplode("qs").alias("query_no", "q")).select("doc_id", "query_no", "q.query", "q.must_contain")
        docs = docs.join(good.select("doc_id"), "doc_id", "left_anti")
    if not allow_fallback:
        return taken if taken is not None else fallback_queries(keyword_lists(docs.limit(0)))
    rest = fallback_queries(keyword_lists(docs))
    return rest if taken is None else taken.unionByName(rest)
