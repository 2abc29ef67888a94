"""One query per operator over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkspark.functions import clean, text
from chunkspark.operators import chunkers, evaluate, graph, hierarchy, querygen, search, sections, segment
from chunkspark.plans import pipeline
from chunkspark.session import spread
from chunkspark.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def section_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Sections as documents: their texts have empty lines and headings."""
    return table(spark, folder, "section").where("text is not null").select(F.concat_ws("/", "doc_id", "section_id").alias("doc_id"), "text").distinct()


def section_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "section").select("doc_id", "section_id", F.col("sec_order"), "section_title", "text").distinct()


def segment_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "segment").select("doc_id", "segment_id", "seg_order", "text").distinct()


def _digest(df: DataFrame, *columns: str) -> DataFrame:
    longs = [F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes if c not in columns]
    return df.select(*longs, *[F.md5(c).alias(c) for c in columns])


@query
def segment_lines(spark, folder):
    return _digest(segment.segments(docs(spark, folder), sep="\n"), "text")


@query
def segment_paragraphs(spark, folder):
    return _digest(segment.segments(section_docs(spark, folder)), "text")


def _text_query(f: Callable) -> Query:
    return lambda spark, folder: docs(spark, folder).where("text is not null").select("doc_id", F.md5(f("text")).alias("text"))


for _f in (clean.clean_text, clean.numeric_headings, clean.drop_references, clean.newlines, clean.ascii_and_greek):
    QUERIES[_f.__name__] = _text_query(_f)

#: Small texts for what the tables don't hold.
LATEX = [r"\section{ Intro }", r"a \subsection*{One} b", r"\subsubsection{x y}", r"\paragraph{no}", r"\section{A}\section*{ B}"]
REFERENCES = ["a\n References\nx", "no references here", "Bibliography", "x \n\nReferences to prose\ny", "Referencesx\n"]


@query
def latex_headings(spark, folder):
    return spark.createDataFrame([(x,) for x in LATEX], "raw string").select("raw", clean.latex_headings("raw").alias("text"))


@query
def reference_blocks(spark, folder):
    return spark.createDataFrame([(x,) for x in REFERENCES], "raw string").select("raw", clean.drop_references("raw").alias("text"))


@query
def sentences(spark, folder):
    return _digest(docs(spark, folder).select("doc_id", F.posexplode(text.sentences("text")).alias("sentence_no", "text")), "text")


def _chunks(method: str, source: Callable) -> Query:
    return lambda spark, folder: _digest(chunkers.chunk_all(source(spark, folder), [method]).drop("method"), "text")


for _m in ("fixed", "sliding", "sentence", "token_limit", "semantic", "delimiter"):
    QUERIES[f"{_m}_chunks"] = _chunks(_m, docs)
for _m in ("paragraph", "recursive", "hybrid", "format_aware", "delimiter", "hierarchical"):
    QUERIES[f"{_m}_chunks_of_sections"] = _chunks(_m, section_docs)

MARKDOWN = ["```\nx\n```\n```\ny\n```\ntext\n# H\na\n```\n# no\n```\n## K\nb", "# A\n\n#x\n####### y\n### B\n", "\n```\nopen\n# in", "plain", "```py\na\n```", "a\n  ```\n# f\n ``` \n# g"]


@query
def format_aware_cases(spark, folder):
    rows = spark.createDataFrame(list(enumerate(MARKDOWN)), "doc_id long, text string")
    return chunkers.chunk_all(rows, ["format_aware"]).select("doc_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "text")


@query
def chunk_stats(spark, folder):
    return chunkers.chunk_stats(chunkers.chunk_arrays(docs(spark, folder)), ["method"])


@query
def chunk_stats_per_document(spark, folder):
    return chunkers.chunk_stats(chunkers.chunk_arrays(docs(spark, folder), ["fixed", "sentence", "recursive"]), ["doc_id", "method"])


@query
def token_stats(spark, folder):
    return chunkers.token_stats(chunkers.chunk_arrays(docs(spark, folder), ["token_limit"]), ["doc_id"])


@query
def token_estimate(spark, folder):
    return docs(spark, folder).where("text is not null").select("doc_id", text.token_estimate("text").alias("estimate"), F.size(text.tokens("text")).cast("long").alias("tokens"))


@query
def alnum_tokens(spark, folder):
    words = docs(spark, folder).select(F.explode(text.alnum_tokens("text")).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


@query
def summaries(spark, folder):
    rows = segment_rows(spark, folder).where("text is not null")
    return hierarchy.summarize(rows).select("doc_id", "segment_id", F.md5("summary").alias("summary"))


def _members(spark, folder) -> DataFrame:
    rows = hierarchy.rule_sections(hierarchy.summarize(segment_rows(spark, folder)))
    return rows.select("doc_id", (F.col("sec_no") - 1).cast("int").alias("sec_order"), F.concat(F.lit("s"), "sec_no").alias("section_id"), F.lit("t").alias("section_title"), F.col("seg_order").alias("place"), "segment_id")


@query
def rule_sections(spark, folder):
    return _members(spark, folder).select("doc_id", "segment_id", "section_id", F.col("place").cast("long").alias("place"))


@query
def materialize_sections(spark, folder):
    return _digest(sections.materialize_members(_members(spark, folder), segment_rows(spark, folder)).drop("section_title"), "text")


#: Answers with the ids seg_0, seg_1, seg_2 and whether they are valid.
ANSWERS = [
    ('{"sections":[{"section_id":"a","section_title":"T","segment_ids":["seg_0","seg_1","seg_2"]}]}', True),
    ("not json", False),
    ('{"sections":[{"section_id":"a","section_title":"T","segment_ids":["seg_0","seg_1","seg_999"]}]}', False),
    ('{"sections":[{"section_id":"a","section_title":"T","segment_ids":["seg_1","seg_0","seg_2"]}]}', False),
    ('{"sections":[{"section_id":"a","section_title":"T","segment_ids":["seg_0"]},{"section_id":"a","section_title":"U","segment_ids":["seg_1","seg_2"]}]}', False),
    ('{"sections":[{"section_id":"a","section_title":"T","segment_ids":["seg_0"]},{"section_id":"b","section_title":"U","segment_ids":["seg_1","seg_2"]}]}', True),
    ('```json\n{"sections":[{"section_id":"a","section_title":"T","segment_ids":["seg_0","seg_1","seg_2"]}]}\n```', True),
    ('Sure: {"sections":[{"section_id":"a","section_title":"T","segment_ids":["seg_0","seg_1","seg_2"]}]} Bye', True),
    ('{"sections":[{"section_id":"a","segment_ids":["seg_0","seg_1","seg_2"]}]}', False),
    ('{"sections":[{"section_id":"a","section_title":null,"segment_ids":["seg_0","seg_1","seg_2"]}]}', True),
    ('{"sections":[{"section_id":"a","section_title":"T","segment_ids":[0,1,2]}]}', False),
    ('{"sections":[]}', False),
    ('[{"section_id":"a"}]', False),
]


@query
def hierarchy_validate(spark, folder):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "doc_id long, response string")
    ids = spark.range(len(ANSWERS)).select(F.col("id").alias("doc_id"), F.posexplode(F.array(*[F.lit(f"seg_{i}") for i in range(3)])).alias("seg_order", "segment_id"))
    out = hierarchy.induce_hierarchy(ids, rows)
    return out.select("doc_id", "valid", F.size("sections").cast("long").alias("n_sections"), F.get("sections", 0)["section_title"].alias("first_title"))


def _rechunked(spark, folder) -> DataFrame:
    return sections.rechunk(section_rows(spark, folder), 200, 30)


@query
def rechunk_sections(spark, folder):
    return _digest(_rechunked(spark, folder).drop("section_title"), "text")


@query
def rechunk_windows(spark, folder):
    return _digest(sections.rechunk(section_rows(spark, folder), 50, 10, short_circuit=False).drop("section_title"), "text")


@query
def graph_nodes(spark, folder):
    return graph.nodes(section_rows(spark, folder), _rechunked(spark, folder)).select("doc_id", "node_id", "type", "title", "section_id", F.md5("text").alias("text"))


@query
def graph_edges(spark, folder):
    return graph.edges(section_rows(spark, folder), _rechunked(spark, folder))


@query
def graph_counts(spark, folder):
    return graph.counts(section_rows(spark, folder), _rechunked(spark, folder))


@query
def sibling_edges(spark, folder):
    out = graph.edges(section_rows(spark, folder), _rechunked(spark, folder), add_next=False, add_sibling=True)
    return out.where("relation = 'sibling'").select("doc_id", "src", "dst")


@query
def vector_topk(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return search.topk_dense(rows, queries, 3, "vec_id").withColumn("rank", F.col("rank").cast("long"))


@query
def vector_norm(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(search.norm("embedding"), 6).alias("norm"))


@query
def hash_tf(spark, folder):
    return search.hash_embedding(docs(spark, folder), ["doc_id"], "text").withColumn("bucket", F.col("bucket").cast("long"))


@query
def hash_topk(spark, folder):
    rows = search.hash_rows(docs(spark, folder), ["doc_id"], "text")
    queries = search.hash_rows(_asking(spark, folder), ["query_id"], "text")
    return search.topk_hashed(rows, queries, 5, "doc_id").withColumn("rank", F.col("rank").cast("long"))


def _asking(spark, folder) -> DataFrame:
    return docs(spark, folder).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


@query
def sparse_topk(spark, folder):
    """The same by a join on the buckets."""
    index = search.hash_embedding(docs(spark, folder), ["doc_id"], "text")
    queries = search.hash_embedding(_asking(spark, folder), ["query_id"], "text")
    out = search.topk_sparse(index, queries, 5, ["doc_id"], ["doc_id"], index.select("doc_id").distinct())
    return out.withColumn("rank", F.col("rank").cast("long"))


@query
def zero_topk(spark, folder):
    """Search without a model: all scores are 0, hits come in the order of their ids."""
    rows = docs(spark, folder).withColumn("vector", search.zero_vector(16))
    return search.topk_dense(rows, _asking(spark, folder).withColumn("vector", search.zero_vector(16)), 3, "doc_id").withColumn("rank", F.col("rank").cast("long"))


def _chunk_hits(spark, folder, k: int) -> tuple[DataFrame, DataFrame]:
    chunks = _rechunked(spark, folder)
    hits = search.topk_hashed(search.hash_rows(chunks, ["chunk_id"], "text"), search.hash_rows(_asking(spark, folder), ["query_id"], "text"), k, "chunk_id")
    return hits.join(chunks.select("doc_id", "chunk_id").distinct(), "chunk_id"), chunks


@query
def graph_retrieval(spark, folder):
    hits, chunks = _chunk_hits(spark, folder, 5)
    out = graph.expand_hits(hits, chunks, graph.edges(section_rows(spark, folder), chunks))
    return out.select("query_id", F.col("hit_rank").cast("long").alias("hit_rank"), F.col("is_neighbor").cast("long").alias("is_neighbor"), "chunk_id", "score")


@query
def contains_match(spark, folder):
    rows = table(spark, folder, "chunk").where("text is not null").select("chunk_id", "text").distinct()
    needles = F.array(F.lit("low-rank"), F.lit("Thermal"), F.lit("EQ. 1"), F.lit(""))
    return rows.select("chunk_id", evaluate.contains_any("text", needles).alias("hit"))


@query
def top_keywords(spark, folder):
    out = querygen.top_keywords(docs(spark, folder), k=25)
    return out.select("doc_id", F.col("rank").cast("long").alias("rank"), "keyword", "n")


@query
def fallback_queries(spark, folder):
    out = querygen.fallback_queries(querygen.keyword_lists(docs(spark, folder)))
    return out.select("doc_id", F.col("query_no").cast("long").alias("query_no"), "query", F.array_join("must_contain", ",").alias("needles"))


RAW_QUERIES = ['[{"query":" A?","must_contain":["X"," Y "," "]},{"query":" ","must_contain":["z"]},{"query":"B","must_contain":[]}]', "```json\n[{\"query\":\"Q\",\"must_contain\":[\"N\"]}]\n```", "here: [{\"query\":\"R\",\"must_contain\":[\"M\",\"\"]}] ok", "nothing", None]


@query
def llm_queries_parse(spark, folder):
    rows = spark.createDataFrame(list(enumerate(RAW_QUERIES)), "id long, raw string")
    return rows.select("id", F.posexplode(querygen.parse_queries("raw")).alias("n", "q")).select("id", F.col("n").cast("long").alias("n"), "q.query", F.array_join("q.must_contain", ",").alias("needles"))


def _recall(spark, folder, k: int, asking: str = "true") -> DataFrame:
    """Recall of all chunkers over the corpus: the questions of the documents ``asking`` against all chunks."""
    sources = docs(spark, folder)
    once = chunkers.chunked_once()
    # Texts differ in length by far: every task gets the same share of them.
    even = sources.repartition(2 * spark.sparkContext.defaultParallelism)
    chunks = chunkers.chunk_all(even, once).withColumn("id", F.concat_ws("-", "doc_id", "method", "chunk_ord"))
    asked = querygen.fallback_queries(querygen.keyword_lists(sources.where(asking)))
    out = evaluate.evaluate(chunks, asked, k, F.concat_ws(" ", "query", F.array_join("must_contain", " ")))
    # The ids of two methods with the same chunks are in the same order, so their hits are the same.
    copies = F.create_map(*[x for m, names in once.items() for x in (F.lit(m), F.array(*map(F.lit, names)))])
    return out.select(F.explode(copies[F.col("method")]).alias("method"), *out.columns[1:])


@query
def recall_at_k(spark, folder):
    return _recall(spark, folder, 3, "doc_id % 100 = 0")


@query
def corpus_recall(spark, folder):
    return _recall(spark, folder, 1)


#: Published results per method (chunks, recall at 1), for the two small reports.
RESULTS = [("hierarchical", 619, 0.925), ("delimiter", 5221, 0.9812), ("fixed", 958, 0.9938), ("format_aware", 16, 1.0), ("hybrid", 7140, 0.9875), ("paragraph", 5221, 0.9812), ("recursive", 7143, 0.9875), ("semantic", 1343, 0.9938), ("sentence", 3814, 1.0), ("sliding", 1890, 0.9875), ("token_limit", 958, 0.9938)]


@query
def recall_aggregate(spark, folder):
    rows = [(m, r if n % 2 else None) for m, n, r in RESULTS] + [(m, r) for m, n, r in RESULTS if n > 1000]
    return evaluate.aggregate(spark.createDataFrame(rows, "method string, recall_at_k double"))


@query
def pareto_frontier(spark, folder):
    rows = [(i, *r) for i, r in enumerate(RESULTS)]
    return evaluate.pareto(spark.createDataFrame(rows, "ordinal long, method string, total_chunks long, recall double"))


@query
def filename_normalize(spark, folder):
    names = table(spark, folder, "doc_domain").select("file").distinct()
    return names.select("file", readers.normalized_name(F.concat(F.upper(F.substring("file", 1, 3)), F.lit(" "), F.expr("substring(file, 4)"))).alias("name"), readers.file_stem("file").alias("doc_id"))


@query
def ingestion_report(spark, folder):
    return pipeline.report(pipeline.ingest(section_docs(spark, folder), write=True))
