"""Golden cases of the operators, edge cases, and plans."""

import json

import pytest
from pyspark.sql import functions as F

from chunkspark.functions import clean, text
from chunkspark.operators import chunkers, evaluate, graph, hierarchy, querygen, search, sections, segment
from chunkspark.plans import pipeline
from chunkspark.sources import readers
from chunkspark.streaming import streams


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t")).first()[0]


@pytest.mark.parametrize(("raw", "expected"), [("A\n\nB", ["A", "B"]), ("A\n\n\nB", ["A", "B"]), ("", []), ("  \n\n ", []), (None, []), ("\n\n A \n\n", ["A"])])
def test_segments(spark, raw, expected):
    rows = segment.segments(docs(spark, raw)).orderBy("seg_order").collect()
    assert [r.text for r in rows] == expected
    assert [r.segment_id for r in rows] == [f"seg_{i}" for i in range(len(expected))]


def test_text_functions(spark):
    assert one(spark, "...", text.sentences) == [".", ".", "."]
    assert one(spark, "3.14", text.sentences) == ["3.", "14"]
    assert one(spark, "a\r\nb\x0cc\n", text.lines) == ["a", "b", "c"]
    assert one(spark, "a b c", text.tokens) == ["a", "b", "c"]
    assert one(spark, "12345", text.token_estimate) == 2
    assert one(spark, "Low-rank_A: É!", text.match_form) == "low rank a"


@pytest.mark.parametrize(("n", "size", "stride"), [(0, 5, 3), (4, 5, 3), (5, 5, 3), (6, 5, 3), (11, 5, 3), (11, 3, 5)])
def test_windows(spark, n, size, stride):
    raw = "abcdefghijklmnop"[:n]
    expected, at = [], 0
    while at < n:
        expected.append(raw[at : at + size])
        if at + size >= n:
            break
        at += stride
    assert one(spark, raw, lambda t: chunkers.sliding(t, size, stride)) == expected
    assert one(spark, raw, lambda t: chunkers.fixed(t, size)) == [raw[i : i + size] for i in range(0, n, size)]


def test_bad_sizes():
    with pytest.raises(ValueError, match="positive"):
        chunkers.sliding("t", 5, 0)


def test_long_paragraphs(spark):
    raw = "x" * 800 + "\n\n" + "y" * 801
    assert [len(c) for c in one(spark, raw, chunkers.recursive)] == [800, 800, 1]
    assert [len(c) for c in one(spark, raw, chunkers.hybrid)] == [800, 801]
    assert one(spark, "a---b###c", chunkers.delimiter) == ["a", "b###c"]
    assert one(spark, "a###b", chunkers.delimiter) == ["a", "b"]


def test_format_aware(spark):
    raw = "```\nx\n```\n```\ny\n```\ntext\n# H\n```\n# no\n```\n## K\n####### n"
    assert one(spark, raw, chunkers.format_aware) == ["```\nx\n```", "```\ny\n```", "text", "# H\n```\n# no\n```", "## K\n####### n"]


def test_chunk_all_skips_unknown_methods_and_clashing_columns(spark):
    rows = docs(spark, "A. B. C. D.", None).withColumn("method", F.lit("z")).withColumn("chunks", F.lit(1))
    out = chunkers.chunk_all(rows, ["sentence", "nonsense"]).collect()
    assert [(r.doc_id, r.method, r.text) for r in out] == [(0, "sentence", "A. B. C."), (0, "sentence", "D.")]
    assert chunkers.chunk_all(rows, ["nonsense"]).count() == 0


def test_chunk_stats_of_nothing(spark):
    row = chunkers.chunk_stats(chunkers.chunk_arrays(docs(spark, None), ["fixed"]), ["method"]).first()
    assert (row.num_chunks, row.avg_chunk_len, row.max_chunk_len, row.compression_ratio) == (0, 0.0, 0, 0.0)


def test_cleaning(spark):
    assert one(spark, r"\section*{ A }", clean.latex_headings) == "### A"
    assert one(spark, "x\nReferences\ny", clean.drop_references) == "x\n"
    assert one(spark, " 1.2   Title  ", clean.numeric_headings) == "1.2 Title"
    assert one(spark, "1.2  A   B\tC\n x  y", clean.numeric_headings) == "1.2 A B C\n x  y"
    assert one(spark, "αé  b", clean.ascii_and_greek) == "α b"
    assert one(spark, "a\r\n\r\n\r\nb \n", clean.clean_text) == "a\n\nb\n"


def test_materialize(spark):
    seg = spark.createDataFrame([("d", "seg_0", 0, "A"), ("d", "seg_1", 1, "B"), ("d", "seg_3", 3, "D"), ("d", "seg_4", 4, " ")], "doc_id string, segment_id string, seg_order int, text string")
    h = spark.createDataFrame([("d", [("s1", "One", ["seg_0", "seg_2"]), (None, None, ["seg_1", "seg_3", "seg_4"]), ("s3", "E", [])])], f"doc_id string, sections {hierarchy.SECTIONS}")
    rows = {r.section_id: (r.section_title, r.text) for r in sections.materialize(h, seg).collect()}
    assert rows == {"s1": ("One", "A"), "s2": ("Untitled", "B\n\nD"), "s3": ("E", "")}


def test_rechunk(spark):
    words = " ".join(f"w{i}" for i in range(24))
    sec = spark.createDataFrame([("doc1", "sX", "T", words), ("doc1", "sY", "T", " ")], "doc_id string, section_id string, section_title string, text string")
    rows = sections.rechunk(sec, 10, 2).orderBy("chunk_ord").collect()
    sizes = [len(r.text.split()) for r in rows]
    assert sizes == [10, 10, 8]
    assert rows[0].text.split()[-2:] == rows[1].text.split()[:2]
    assert rows[0].chunk_id == "doc1-sX-0"
    assert [r.text for r in sections.rechunk(sec.limit(1), 50, 60).collect()] == [words]
    with pytest.raises(ValueError, match="positive"):
        sections.rechunk(sec, 0)


def test_hierarchy(spark):
    from chunkspark.plans.queries import ANSWERS

    ids = F.array(*[F.lit(f"seg_{i}") for i in range(3)])
    rows = spark.createDataFrame([(a, ok) for a, ok in ANSWERS], "raw string, ok boolean").withColumn("ids", ids)
    got = rows.select("ok", hierarchy.parse_hierarchy("raw", "ids").isNotNull().alias("valid")).collect()
    assert [r.valid for r in got] == [r.ok for r in got]


def test_summaries(spark):
    rows = spark.createDataFrame([("Alpha",), ("One sentence that is rather long, indeed. Another.",), (None,)], "text string")
    assert [r.summary for r in hierarchy.summarize(rows).collect()] == ["Alpha", "One sentence that is rather long, indeed.", None]

    def client():
        return lambda asked: json.dumps({"seg_0": "S"}) if asked.startswith("Summarise each") else "single"

    out = hierarchy.summarize_with(rows, client)
    assert {r.summary for r in out.collect()} == {"Alpha", "S", None}


LONG = "This passage has more than forty code points, number {}."


def _client(batch, single="single"):
    def make():
        def answer(asked):
            if not asked.startswith("Summarise each"):
                return single
            if isinstance(batch, Exception):
                raise batch
            return batch

        return answer

    return make


@pytest.mark.parametrize(
    ("batch", "expected"),
    [
        ('```json\n{"seg_0": "A", "seg_1": " B "}\n```', ["A", "B"]), ('Here: {"seg_0": "A"} done', ["A", "single"]), ("no object", ["single", "single"]),
        ('["A", "B"]', ["single", "single"]), ('{"seg_0": 1, "seg_1": ""}', ["single", "single"]), (OSError("down"), ["single", "single"]), (" ", ["single", "single"]),
    ],
)
def test_summaries_fall_back_one_by_one(spark, batch, expected):
    rows = spark.createDataFrame([(i, LONG.format(i)) for i in range(2)], "i int, text string").coalesce(1)
    assert [r.summary for r in hierarchy.summarize_with(rows, _client(batch)).orderBy("i").collect()] == expected


def test_a_blank_answer_is_an_error(spark):
    rows = spark.createDataFrame([(LONG,)], "text string")
    with pytest.raises(Exception, match="blank answer"):
        hierarchy.summarize_with(rows, _client("x", " \n")).collect()
    with pytest.raises(ValueError, match="blank"):
        hierarchy.ask(lambda p: "", "x")


def test_hierarchies_of_a_client(spark):
    seg = spark.createDataFrame([("d", f"seg_{i}", i, t, s) for i, (t, s) in enumerate([("A", "a"), ("B", None), (None, None)])] + [("e", "seg_0", 0, "x", "x")], "doc_id string, segment_id string, seg_order int, text string, summary string")

    def client():
        return lambda asked: '{"sections":[{"section_id":"k","section_title":null,"segment_ids":["seg_0","seg_1","seg_2"]}]}' if "seg_0: a\nseg_1: B\nseg_2: " in asked else "nothing"

    rows = {r.doc_id: r for r in hierarchy.induce_hierarchy(seg, hierarchy.responses_with(seg, client)).collect()}
    assert (rows["d"].valid, rows["d"].sections[0].section_id) == (True, "k")
    assert (rows["e"].valid, rows["e"].sections[0].section_title) == (False, "All Segments")


def test_rule_sections_do_not_depend_on_ranges(spark, monkeypatch):
    texts = ["# H" if i in (3, 11, 12, 29) else f"text {i}" for i in range(40)]
    seg = spark.createDataFrame([(d, f"seg_{i}", i, t, None if i % 7 == 0 else t) for d in ("a", "b") for i, t in enumerate(texts)], "doc_id string, segment_id string, seg_order int, text string, summary string")
    whole = {tuple(r) for r in hierarchy.rule_sections(seg).collect()}
    monkeypatch.setattr(hierarchy, "RANGE", 4)
    assert {tuple(r) for r in hierarchy.rule_sections(seg).collect()} == whole
    starts = {i for i in range(40) if i in (0, 3, 11, 12, 29)}
    last = 0
    for i in range(40):
        last = i if i in starts or i - last == 5 else last
        starts.add(last)
    firsts = {}
    for _, _, i, sec, _ in whole:
        firsts[sec] = min(i, firsts.get(sec, i))
    assert set(firsts.values()) == starts


def test_graph(spark):
    sec = spark.createDataFrame([("d", "s1", 0, "T", "x")], "doc_id string, section_id string, sec_order int, section_title string, text string")
    ch = spark.createDataFrame([("d", "s1", i, f"d-s1-{i}", "T", "x") for i in range(3)] + [("d", "s9", 0, "d-s9-0", "", "x")], "doc_id string, section_id string, chunk_ord int, chunk_id string, section_title string, text string")
    assert graph.nodes(sec, ch).count() == 6
    e = graph.edges(sec, ch)
    assert {(r.src, r.dst, r.relation) for r in e.collect()} == {("d", "s1", "has_section")} | {("s1", f"d-s1-{i}", "has_chunk") for i in range(3)} | {(f"d-s1-{i}", f"d-s1-{i + 1}", "next") for i in range(2)}
    hits = spark.createDataFrame([(1, "d", "d-s1-0", 0.9, 1), (1, "d", "d-s1-1", 0.8, 2)], "query_id int, doc_id string, chunk_id string, score double, rank int")
    got = graph.expand_hits(hits, ch, e).orderBy("hit_rank", "is_neighbor").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("d-s1-0", 0.9), ("d-s1-1", 0.9), ("d-s1-2", 0.8)]
    assert graph.expand_hits(hits, ch, None).count() == 2


def test_search(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "chunk_id int, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vector array<float>")
    assert [(r.chunk_id, r.score) for r in search.topk_dense(index, q, 9).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0)]
    assert search.topk_dense(index, q, 0).count() == 0
    assert search.topk_dense(index.limit(0), q, 3).count() == 0
    assert search.topk_dense(index, q.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(8, None), (9, [1.0]), (7, [1.0, 0.0])], "query_id int, vector array<float>")
    alone = [(r.query_id, r.chunk_id, r.score) for part in (odd.where("query_id = 8"), odd.where("query_id = 9"), odd.where("query_id = 7")) for r in search.topk_dense(index, part, 2).collect()]
    assert sorted(alone) == sorted((r.query_id, r.chunk_id, r.score) for r in search.topk_dense(index, odd, 2).collect())
    assert len(alone) == 6
    assert {tuple(r) for r in search.topk_dense(index, odd, 2, block=1).collect()} == {tuple(r) for r in search.topk_dense(index, odd, 2).collect()}
    two = index.withColumn("m", F.when(F.col("chunk_id") < 3, "x").otherwise("y"))
    assert sorted((r.m, r.chunk_id) for r in search.topk_dense(two, q, 1, by="m").collect()) == [("x", 1), ("y", 3)]
    tf = search.hash_embedding(docs(spark, "a b", "b c", "z", ""), ["doc_id"], "text")
    sparse = search.topk_sparse(tf, search.hash_embedding(docs(spark, "b"), ["doc_id"], "text").withColumnRenamed("doc_id", "query_id"), 3, ["doc_id"], ["doc_id"], docs(spark, "a b", "b c", "z", ""))
    assert [(r.doc_id, r.score) for r in sparse.orderBy("rank").collect()] == [(0, 0.707107), (1, 0.707107), (2, 0.0)]


def test_evaluation(spark):
    rows = spark.createDataFrame([("Low-Rank plasma", ["low rank"], True), ("x", [""], False), ("x", ["..."], True), ("x", None, False), (None, ["a"], False)], "t string, needles array<string>, ok boolean")
    assert all(r.hit == r.ok for r in rows.select("ok", evaluate.contains_any("t", "needles").alias("hit")).collect())
    rows = spark.createDataFrame([(0, 16, 1.0), (1, 100, 1.0), (2, 50, 0.5)], "ordinal int, total_chunks int, recall double")
    assert {r.ordinal for r in evaluate.pareto(rows).collect()} == {0, 1}


def test_query_generation(spark):
    got = querygen.fallback_queries(spark.createDataFrame([(1, [f"k{i}" for i in range(35)]), (2, [])], "doc_id int, keywords array<string>")).collect()
    assert len(got) == 20
    assert [r.must_contain for r in got if r.doc_id == 1 and r.query_no == 8] == [["k32", "k33", "k34"]]
    answers = spark.createDataFrame([(0, json.dumps([{"query": f"q{i}", "must_contain": ["N"]} for i in range(10)]))], "doc_id long, response string")
    out = querygen.generate(docs(spark, "alpha beta", "gamma"), answers).collect()
    assert sum(r.query == "q0" for r in out) == 1
    assert len(out) == 20


def test_search_in_a_grid_equals_one_block(spark):
    import random

    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)], "vec_id int, vector array<float>")
    queries = rows.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    one_block, grid = ({tuple(r) for r in search.topk_dense(rows, queries, 3, "vec_id", block=b).collect()} for b in (1000, 4))
    assert one_block == grid
    assert len(grid) == 3 * 43


def test_embed(spark):
    import numpy as np

    out = search.embed(docs(spark, "ab", None), "text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])).orderBy("doc_id").collect()
    assert [r.vector for r in out] == [[2.0, 1.0], [0.0, 1.0]]


def test_evaluate(spark):
    chunks = spark.createDataFrame([("m", 1, "alpha beta"), ("m", 2, "gamma delta"), ("n", 1, "alpha gamma"), ("n", 2, None)], "method string, id int, text string")
    asked = spark.createDataFrame([("alpha beta", ["Beta"]), ("gamma", ["delta"]), (" ", ["x"]), ("alpha", [])], "query string, must_contain array<string>")
    rows = {r.method: (r.recall_at_k, r.num_chunks, r.total_queries, r.hits) for r in evaluate.evaluate(chunks, asked, 0).collect()}
    assert rows == {"m": (0.666667, 2, 3, 2), "n": (0.0, 2, 3, 0)}
    table = evaluate.rounded(chunkers.chunk_stats(chunkers.chunk_arrays(docs(spark, "A. B. C. D."), ["sentence"]), ["method"])).first()
    assert (table.avg_chunk_len, table.compression_ratio) == (5.0, 1.1)


def test_hooks(spark):
    codes = lambda: (lambda t: [ord(c) for c in t], lambda ids: "".join(map(chr, ids)))
    assert one(spark, "abcde fg", lambda t: chunkers.token_limit(t, 3, codes)) == ["abc", "de", "fg"]
    assert one(spark, "a. b. c. d.", lambda t: chunkers.semantic(t, lambda: lambda x: x.split("b"))) == ["a.", ". c. d."]
    assert one(spark, "a. b. c. d.", lambda t: chunkers.semantic(t, lambda: lambda x: 1 / 0)) == ["a. b. c.", "d."]
    assert one(spark, "a|b|c|d", lambda t: chunkers.sentence(t, 2, lambda c: F.split(c, r"\|"))) == ["a b", "c d"]
    sec = spark.createDataFrame([("d", "s", "T", "abcd")], "doc_id string, section_id string, section_title string, text string")
    assert [r.text for r in sections.rechunk(sec, 3, 1, tokenize=lambda c: F.split(c, "")).orderBy("chunk_ord").collect()] == ["a b c", "c d"]


def test_hierarchical_equals_the_pipeline(spark):
    raw = "\n\n".join(["# A", *[f"part {i} " + "word " * 90 for i in range(7)], "2. B", "end", " "])
    parts = pipeline.ingest(docs(spark, raw))
    want = [r.text for r in parts.chunks.join(parts.sections.select("section_id", "sec_order"), "section_id").orderBy("sec_order", "chunk_ord").collect()]
    assert one(spark, raw, chunkers.hierarchical) == want
    assert len(want) > 3
    assert one(spark, " ", chunkers.hierarchical) == one(spark, None, chunkers.hierarchical) == []


def test_query_job(spark):
    rows = spark.createDataFrame([(f"d{i}", f"alpha beta {i}") for i in range(4)], "doc_id string, text string")
    good = json.dumps([{"query": f"q{i}", "must_contain": [" N "]} for i in range(10)])

    def client():
        def answer(asked):
            if "Paper: d1" in asked:
                raise OSError("down")
            return f"```json\n{good}\n```" if "Paper: d0" in asked else "?"

        return answer

    out = querygen.job(rows, client, existing=rows.where("doc_id = 'd2'").select("doc_id"), limit=3).collect()
    assert {(r.doc_id, r.must_contain[0]) for r in out} == {("d0", " n ")}
    out = querygen.job(rows, client, existing=rows.select("doc_id"), overwrite=True, allow_fallback=True).collect()
    assert {r.doc_id for r in out} == {"d0", "d1", "d2", "d3"}
    asked = one(spark, "The text", lambda t: querygen.prompt(t, F.lit("n.txt"), F.array(*[F.lit(f"k{i}") for i in range(30)])))
    assert "n.txt" in asked and "k24" in asked and "k25" not in asked and asked.endswith("The text")


def test_more_readers(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text('[{"query": "A", "must_contain": ["x"]}, {"query": "B"}, 3]', encoding="utf-8")
    assert [tuple(r) for r in readers.read_queries(spark, str(tmp_path / "q")).collect()] == [("A", ["x"])]
    (tmp_path / "bad.json").write_text("{not json", encoding="utf-8")
    assert readers.read_queries(spark, str(tmp_path / "bad.json")).count() == 4
    try:
        import yaml  # noqa: F401
    except ImportError:
        pass
    else:
        (tmp_path / "b.json").write_text("- query: C\n  must_contain: [y, z]\n", encoding="utf-8")
        assert [tuple(r) for r in readers.read_queries(spark, str(tmp_path / "b.json")).collect()] == [("C", ["y", "z"])]
    (tmp_path / "p").mkdir()
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / "p" / name).write_bytes(name.encode())

    def first(content):
        if content == b"c.pdf":
            raise ValueError("damaged")
        return " " if content == b"b.pdf" else "text"

    rows = readers.read_pdfs(spark, str(tmp_path / "p"), first, lambda c: "second" if c == b"b.pdf" else None)
    assert {tuple(r) for r in rows.collect()} == {("a", "text"), ("b", "second"), ("c", None)}
    raw = docs(spark, "x" * 30, "y", None, "z" * 40)
    assert {r.doc_id for r in readers.prepare(raw, raw.where("doc_id = 3").select("doc_id"), least=10).collect()} == {0}
    assert readers.prepare(raw, least=1, limit=2).count() == 2
    arrays = chunkers.chunk_arrays(docs(spark, "A. B. C. D."), ["sentence"]).select("method", "chunks")
    readers.write_results(arrays, str(tmp_path / "r"))
    back = readers.explode_chunks(readers.read_results(spark, str(tmp_path / "r")))
    assert [(r.method, r.chunk_ord, r.text) for r in back.orderBy("chunk_ord").collect()] == [("sentence", 0, "A. B. C."), ("sentence", 1, "D.")]
    (tmp_path / "e").mkdir()
    for name in ("one_retrieval.jsonl", "one_retrieval_k1.jsonl"):
        (tmp_path / "e" / name).write_text('{"method": "fixed", "recall_at_k": 0.5}\n', encoding="utf-8")
    assert [(r.doc, r.recall_at_k) for r in readers.read_retrieval(spark, str(tmp_path / "e")).collect()] == [("one", 0.5)]


def test_streams_of_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A. B. C. D.", encoding="utf-8")
    seen = []
    q = streams.each_batch(streams.chunk_stream(streams.document_stream(spark, str(tmp_path / "in")), ["sentence"]), lambda df, i: seen.extend(r.text for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == ["A. B. C.", "D."]


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from chunkspark import session

    conf = SimpleNamespace(get=lambda key: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.b.txt").write_text("A\n\nB", encoding="utf-8")
    assert [tuple(r) for r in readers.read_documents(spark, str(tmp_path / "in")).collect()] == [("a.b", "A\n\nB")]
    q = streams.write_append(streams.segment_stream(streams.document_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "r.jsonl").write_text('{"method":" fixed ","chunks":["a"," "]}\nnope\n\n[1]\n', encoding="utf-8")
    rows = readers.usable_chunks(readers.read_results(spark, str(tmp_path / "r.jsonl"))).collect()
    assert [(r.method, r.chunks) for r in rows] == [("fixed", ["a"])]
    (tmp_path / "m.csv").write_text("method, total_chunks, recall@1\nfixed, 958.0, 0.99\n", encoding="utf-8")
    assert tuple(readers.read_metrics(spark, str(tmp_path / "m.csv")).first())[:3] == ("fixed", 958, 0.99)
    assert readers.read_queries(spark).count() == 4


def test_pipeline_report(spark):
    rows = pipeline.report(pipeline.ingest(docs(spark, "# A\n\nSome text.\n\n# B\n\nMore text here.", None, ""))).collect()
    assert [(r.num_segments, r.num_sections, r.num_chunks, r.num_graph_nodes, r.num_graph_edges) for r in rows] == [(4, 2, 2, 5, 4)]


def test_native_plans_stay_in_the_jvm(spark, folder):
    from chunkspark.plans.queries import QUERIES

    plan = QUERIES["chunk_stats"](spark, folder)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan
    assert "ArrowEval" not in plan


def test_entry(spark, folder):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == len(chunkers.REGISTRY)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_evaluation_computes_every_chunk_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def chunk(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([("m", i, f"word{i % 7} alpha") for i in range(40)], "method string, id int, text string")
    asked = spark.createDataFrame([("word3", ["Word3"]), ("word5", ["word6"])], "query string, must_contain array<string>")
    got = evaluate.evaluate(rows.mapInPandas(chunk, rows.schema), asked, 1).collect()
    assert [(r.num_chunks, r.hits) for r in got] == [(40, 1)]
    assert calls.value == 40


def test_best_rows_equal_all_scores():
    import random

    import numpy as np

    from chunkspark.operators import best

    rng = random.Random(7)
    bag = lambda most: {rng.randrange(32): rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(most))}
    rows, asked = [bag(9) for _ in range(900)], [bag(6) for _ in range(60)] + [{31: 1}]
    rows = [{b: w for b, w in r.items() if b != 31} for r in rows]  # the last query meets no row
    for k, positive in ((1, False), (3, False), (3, True), (70, False)):
        keep = best.Best(best.tree(asked), k, 32, positive=positive)
        for part in (range(0, 900, 3), range(1, 900, 3), range(2, 900, 3)):
            pairs = [(i, b, w) for i, r in enumerate(part) for b, w in rows[r].items()]
            i, b, w = (np.array(x, np.int64) for x in zip(*pairs))
            keep.add("m", [f"{r:03}" for r in part], i, b, w)
        want = {}
        for j, q in enumerate(asked):
            dots = [(sum(w * r.get(b, 0) for b, w in q.items()), f"{i:03}", r) for i, r in enumerate(rows) if r and q]
            scored = [(-float(best.rounded(np.array(d / (np.sqrt(sum(w * w for w in r.values())) * np.sqrt(sum(w * w for w in q.values())))))), key) for d, key, r in dots if d or not positive]
            if scored:
                want[j] = sorted(scored)[:k]
        got = {}
        for j, _, key, score, _ in keep.rows():
            got.setdefault(j, []).append((-score, key))
        assert got == {j: x for j, x in want.items() if x}
    assert best.rounded(np.array([13 / 128, 0.1234564999])).tolist() == [0.101563, 0.123456]


def test_sparse_search_shuffles_no_pairs(spark):
    import random

    rng = random.Random(5)
    index = spark.createDataFrame([(i, b, rng.choice([1, 1, 2])) for i in range(200) for b in rng.sample(range(-5, 900, 9), 12)], "doc_id int, bucket int, tf long")
    queries = index.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id").withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    # The join on the buckets, as SQL has it.
    index.createOrReplaceTempView("x")
    queries.createOrReplaceTempView("y")
    want = spark.sql("""
        with dots as (select query_id, doc_id, sum(x.tf * y.tf) as dot from x join y using (bucket) group by 1, 2),
        s as (select query_id, doc_id, round(dot / (sqrt((select sum(tf * tf) from x where x.doc_id = dots.doc_id)) * sqrt((select sum(tf * tf) from y where y.query_id = dots.query_id))), 6) as score from dots)
        select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 4""")
    want = {tuple(r) for r in want.collect()}
    for block in (1000, 5):
        got = search.topk_sparse(index, queries, 4, ["doc_id"], ["doc_id"], block=block)
        assert {tuple(r) for r in got.collect()} == want
    few = search.topk_sparse(index.where("doc_id < 2"), queries, 4, ["doc_id"], ["doc_id"], index.select("doc_id").distinct())
    assert few.groupBy("query_id").count().where("count = 4").count() == 23
    lone = spark.createDataFrame([(i, 0, 1) for i in range(200)], "doc_id int, bucket int, tf long")
    top = search.topk_sparse(lone, lone.withColumnRenamed("doc_id", "query_id"), 1, ["doc_id"], ["doc_id"])
    assert {r.doc_id for r in top.collect()} == {0}
    assert "SortMergeJoin" not in top._jdf.queryExecution().toString()


def test_evaluation_of_many_questions(spark):
    calls = spark.sparkContext.accumulator(0)

    def chunk(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([("m", i, f"word{i} alpha") for i in range(60)], "method string, id int, text string")
    asked = spark.createDataFrame([(f"word{i % 70}", [f"word{i % 70}"]) for i in range(1400)], "query string, must_contain array<string>")
    # Words of 60 to 69 are in no chunk, but may share a bucket with one.
    assert [(r.num_chunks, r.total_queries, r.hits) for r in evaluate.evaluate(rows.mapInPandas(chunk, rows.schema), asked, 3).collect()] == [(60, 1400, 1200)]
    assert calls.value == 60
    assert [(r.num_chunks, r.total_queries, r.hits) for r in evaluate.evaluate(rows, asked, 3, block=500).collect()] == [(60, 1400, 1200)]


def test_shared_chunks_are_hashed_and_scored_once(spark, monkeypatch):
    import pyarrow as pa

    from chunkspark.operators import best

    rows = [(m, f"{i}-{m}", f"word{i} alpha. beta{i % 3}") for i in range(30) for m in ("m", "n")] + [("n", "x", "word3 gamma"), ("n", "y", None)]
    seen = []
    add = best.Bounded.add_shared
    monkeypatch.setattr(best.Bounded, "add_shared", lambda self, by, ids, row, bucket, texts: (seen.extend(texts), add(self, by, ids, row, bucket, texts)))
    monkeypatch.setattr(best.Waiting, "part", lambda self, least: None)  # few rows aren't shared else
    asked = spark.createDataFrame([], "method string")  # only its session
    run = evaluate._best_of_task(asked, [("word3 gamma", ["gamma"]), ("beta1", ["none"])], 2)
    batch = pa.RecordBatch.from_pylist([dict(zip(("method", "id", "text"), r)) for r in rows])
    out = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    assert sorted(seen) == sorted({t for _, _, t in rows if t})
    assert {r["method"]: r["n"] for r in out if r["place"] == -1} == {"m": 30, "n": 32}
    assert sorted((r["id"], r["hit"]) for r in out if r["place"] == 0 and r["method"] == "n") == [("3-n", False), ("x", True)]
    assert sorted((r["id"]) for r in out if r["place"] == 1 and r["method"] == "m") == ["1-m", "10-m"]


def test_bounded_rows_equal_all_scores():
    import random

    import numpy as np

    from chunkspark.operators import best

    rng = random.Random(11)
    bag = lambda most, of: {rng.randrange(31): rng.choice(of) for _ in range(rng.randrange(most))}
    rows = [bag(9, [1, 1, 2]) for _ in range(700)]
    for long in (False, True):
        asked = [bag(6, [1, 1, 2]) for _ in range(40)] + [{31: 1}] + ([{1: 3000, 2: 1}] if long else [])  # one meets no row
        for k, positive in ((1, False), (3, False), (3, True), (70, False)):
            keep = best.Bounded(best.tree(asked), k, 32, positive=positive)
            names = {"m": [f"{i:03}" for i in range(700)], "n": [f"{i}" for i in range(700)]}  # ids in two orders
            for part, by in ((range(0, 300), ["m", "n"]), (range(300, 600), ["m", "n"]), (range(600, 700), ["n"])):
                words = [(i, b) for i, r in enumerate(part) for b, w in rows[r].items() for _ in range(w)]
                row, bucket = (np.array(x, np.int64) for x in zip(*words))
                keep.add_shared(by, [[names[g][i] for i in part] for g in by], row, bucket, [""] * len(part))
            got = {}
            for j, g, key, score, _ in keep.rows():
                got.setdefault((j, g), []).append((-score, key))
            want = {}
            for j, q in enumerate(asked):
                for g, n in (("m", 600), ("n", 700)):
                    dots = [(sum(w * r.get(b, 0) for b, w in q.items()), names[g][i], r) for i, r in enumerate(rows[:n]) if r and q]
                    scored = [(-float(best.rounded(np.array(d / (np.sqrt(sum(w * w for w in r.values())) * np.sqrt(sum(w * w for w in q.values())))))), key) for d, key, r in dots if d or not positive]
                    if scored:
                        want[j, g] = sorted(scored)[:k]
            assert got == want


def test_strip_and_windows_of_all_blanks_and_pieces(spark):
    from chunkspark.functions import text

    rows = spark.createDataFrame([(chr(i) + "a" + chr(i) + "b" + chr(i),) for i in range(1, 0x3100)], "t string")
    assert rows.where(F.regexp_replace("t", f"^{text.SPACE}+|{text.SPACE}+$", "") != text.strip("t")).isEmpty()
    assert rows.where(text.strip("t") != F.col("t")).count() == 29
    assert one(spark, "ab😀\ncdefg", lambda t: chunkers.sliding(t, 4, 2)) == ["ab😀", "😀\ncd", "cdef", "efg"]
    assert one(spark, "ab\r\n\x1dc d\n", lambda t: chunkers.REGISTRY["format_aware"](t)) == ["ab\n\nc d"]


def test_corpus_recall_asks_for_every_document(spark, tmp_path):
    from chunkspark.plans import oracles
    from chunkspark.plans.queries import QUERIES

    duckdb = pytest.importorskip("duckdb")
    texts = ["Alpha beta gamma. Beta delta. Epsilon zeta.\n\nEta theta beta iota.", "Kappa lambda. Lambda mu nu. Xi omicron pi!\n\n# Rho\nSigma tau.", "", None, "Alpha beta gamma. Beta delta."]
    docs(spark, *texts).withColumn("doc_id", F.col("doc_id") + 1).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {tuple(r) for r in QUERIES["corpus_recall"](spark, str(tmp_path)).collect()}
    assert {r[4] for r in rows} == {50}
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows == set(db.sql(oracles.oracle_sql()["corpus_recall"]).fetchall())


def test_evaluation_by_shares_of_the_questions_equals_one_pass(spark):
    import random

    rng = random.Random(7)
    word = lambda n: f"w{int(rng.paretovariate(0.7)) % n}"
    texts = [" ".join(word(400) for _ in range(rng.choice([1, 3, 9, 40]))) for _ in range(1500)]
    rows = [(m, f"{i * 7 % 1500}-{m}", None if i == 5 else t) for i, t in enumerate(texts) for m in "abc" if m == "a" or i % 3 or i > 900] + [("d", "0", "??")]
    chunks = spark.createDataFrame(rows, "method string, id string, text string")
    asked = [(rng.choice(["What is w1 of w2 and w3", "How does w4 w4", word(400), "zz"]), [word(400) for _ in range(rng.randrange(5))]) for _ in range(400)] + [("?", ["w1"]), ("w9", [])]
    queries = spark.createDataFrame(asked, "query string, must_contain array<string>")
    words = F.concat_ws(" ", "query", F.array_join("must_contain", " "))
    for k in (1, 3, 70):
        one_pass, shares, rounds = ({tuple(r) for r in evaluate.evaluate(chunks, queries, k, words, block=b).collect()} for b in (1000, 150, 50))
        assert one_pass == shares == rounds
        assert {r[0]: r[2] for r in shares} == {"a": 1500, "b": 1199, "c": 1199, "d": 1}
