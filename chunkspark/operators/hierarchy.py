"""Summaries and section hierarchies: providers, validation of their answers, and fallbacks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chunkspark.functions.text import col, sentences, strip

SECTIONS = "array<struct<section_id:string,section_title:string,segment_ids:array<string>>>"
SHORT = 40
FENCE = "```"


def first_sentence(text: Column | str) -> Column:
    """The deterministic provider of summaries (ours)."""
    return F.coalesce(F.get(sentences(text), 0), strip(text))


def summarize(segments: DataFrame, provider: Callable[[Column], Column] = first_sentence) -> DataFrame:
    """``segments`` with ``summary``: segments of less than 40 code points are their own, the provider's column makes
    the others. A null text has a null summary."""
    text = strip("text")
    return segments.withColumn("summary", F.when(F.length(text) < SHORT, text).otherwise(provider(text)))


Client = Callable[[str], str]


def ask(client: Client, prompt: str) -> str:
    """The answer of a client without blanks around it; a blank one is an error."""
    answer = client(prompt)
    if not isinstance(answer, str) or not answer.strip():
        raise ValueError("the client gave a blank answer")
    return answer.strip()


def batch_prompt(texts: list[str], first: int = 0) -> str:
    """The request for the summaries of several passages, named by their place."""
    listed = "\n".join(f"seg_{first + i}: {t}" for i, t in enumerate(texts))
    return f"Summarise each passage in one sentence. Answer with a JSON object of passage keys and summaries.\n{listed}"


def parse_object(raw: str) -> dict | None:
    """The JSON object in an answer: in a code fence whose first line may name the language, alone, or between the first
    and the last brace; null where there is none."""
    text = raw.strip()
    if text.startswith(FENCE):
        text = text.strip("`\n ")
        first, _, rest = text.partition("\n")
        text = rest if rest and not first.strip().startswith("{") else text
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


def summarize_with(segments: DataFrame, make_client: Callable[[], Client], batch_size: int = 5) -> DataFrame:
    """The same by a client called with prompts, one client per Python worker, ``batch_size`` segments per prompt.

    A batch that fails in any way, or a segment that the answer misses, is asked for one by one; a client that fails
    there, or gives a blank answer, fails the job. Only segments that need it reach Python, in their partitions.
    """
    size = max(1, int(batch_size))
    text = strip("text")
    base = segments.withColumn("__short", F.length(text) < SHORT)
    easy = base.where("coalesce(__short, true)").drop("__short").withColumn("summary", text)
    hard = base.where("not __short").drop("__short")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for pdf in batches:
            client = client or make_client()
            texts, out = pdf["text"].tolist(), []
            for start in range(0, len(texts), size):
                group = texts[start : start + size]
                try:
                    answers = parse_object(ask(client, batch_prompt(group, start))) or {}
                except Exception:  # noqa: BLE001  whatever the batch failed of, its passages are asked for singly
                    answers = {}
                for i, t in enumerate(group):
                    got = answers.get(f"seg_{start + i}")
                    out.append(got.strip() if isinstance(got, str) and got.strip() else ask(client, f"Summarise in one sentence:\n{t}"))
            yield pdf.assign(summary=out)

    schema = T.StructType([*hard.schema.fields, T.StructField("summary", T.StringType())])
    return easy.unionByName(hard.mapInPandas(run, schema))


def strip_fences(raw: Column | str) -> Column:
    """The inside of the first code fence where the text begins with one and closes it."""
    t = strip(raw)
    parts = F.split(t, FENCE)
    return F.when(F.startswith(t, F.lit(FENCE)) & (F.size(parts) >= 3), strip(F.get(parts, 1))).otherwise(t)


def _sections_of(variant: Column) -> Column:
    """Sections of a parsed answer; null where the shape or a type is not as asked for."""
    listed = F.try_variant_get(variant, "$.sections", "array<variant>")

    def one(v: Column) -> Column:
        return F.struct(
            F.try_variant_get(v, "$.section_id", "string").alias("section_id"),
            F.try_variant_get(v, "$.section_title", "string").alias("section_title"),
            F.try_variant_get(v, "$.section_title", "variant").isNotNull().alias("titled"),
            F.try_variant_get(v, "$.segment_ids", "array<string>").alias("segment_ids"),
            F.schema_of_variant(F.coalesce(F.try_variant_get(v, "$.segment_ids", "variant"), F.parse_json(F.lit("0")))).alias("kind"),
        )

    typed = F.transform(listed, one)
    fine = F.size(typed) > 0
    fine = fine & F.forall(typed, lambda s: s["section_id"].isNotNull() & s["titled"] & s["segment_ids"].isNotNull() & s["kind"].isin("ARRAY<STRING>", "ARRAY<VOID>"))
    plain = F.transform(typed, lambda s: F.struct(s["section_id"].alias("section_id"), s["section_title"].alias("section_title"), s["segment_ids"].alias("segment_ids")))
    return F.when(fine, plain)


def parse_hierarchy(raw: Column | str, ids: Column | str) -> Column:
    """Sections of an answer, or null unless it is valid: a JSON object (alone, in a fence, or between the first and
    last brace) whose list of sections is not empty, with string ids, a title (perhaps null), each section id once, and all
    segment ids of the document exactly once and in their order."""
    text = strip_fences(raw)
    tail = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})$", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(F.try_parse_json(text), F.try_parse_json(tail), F.try_parse_json(inner))
    sections = _sections_of(found)
    all_ids = F.flatten(F.transform(sections, lambda s: s["segment_ids"]))
    names = F.transform(sections, lambda s: s["section_id"])
    return F.when((all_ids == col(ids)) & (F.size(F.array_distinct(names)) == F.size(names)), sections)


def fallback_hierarchy(ids: Column | str) -> Column:
    """One section with all segments."""
    return F.array(F.struct(F.lit("s1").alias("section_id"), F.lit("All Segments").alias("section_title"), col(ids).alias("segment_ids"))).cast(SECTIONS)


def segment_lists(segments: DataFrame) -> DataFrame:
    """``(doc_id, ids)``: the segment ids of each document in their order."""
    lists = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg_order", "segment_id"))).alias("s"))
    return lists.select("doc_id", F.transform("s", lambda x: x["segment_id"]).alias("ids"))


def induce_hierarchy(segments: DataFrame, responses: DataFrame) -> DataFrame:
    """``(doc_id, sections, valid)``: the answer of ``responses(doc_id, response)`` where it is valid, else the fallback."""
    rows = segment_lists(segments).join(responses.select("doc_id", "response"), "doc_id", "left")
    rows = rows.withColumn("parsed", parse_hierarchy("response", "ids"))
    return rows.select("doc_id", F.coalesce(F.col("parsed").cast(SECTIONS), fallback_hierarchy("ids")).alias("sections"), F.col("parsed").isNotNull().alias("valid"))


def hierarchy_prompt(lines: list[str]) -> str:
    """The request for a hierarchy of the segments listed as ``id: summary``."""
    listed = "\n".join(lines)
    return (
        "Group the segments below into sections. Keep their order and use every segment id once, in one section. Answer with one JSON object"
        f' like {{"sections": [{{"section_id": "s1", "section_title": "...", "segment_ids": ["..."]}}]}} and nothing else.\n{listed}'
    )


def responses_with(summarised: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
    """``(doc_id, response)``: the answers of a client, one prompt per document with all its segments, as the model sees
    a document as a whole; a missing summary stands for the text. A client that fails fails the job."""
    line = F.struct("seg_order", F.concat("segment_id", F.lit(": "), F.coalesce(strip("summary"), strip("text"), F.lit(""))).alias("line"))
    docs = summarised.groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("l")).select("doc_id", F.transform("l", lambda x: x["line"]).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for pdf in batches:
            client = client or make_client()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "response": [ask(client, hierarchy_prompt(list(x))) for x in pdf["lines"]]})

    return docs.mapInPandas(run, T.StructType([docs.schema["doc_id"], T.StructField("response", T.StringType())]))


HEADING = r"^(?:#{1,6}\s|\d+(?:\.\d+)*\.?\s)"
#: Places of a document that are numbered together; only a row for each such range is looked at per document.
RANGE = 10_000


def rule_sections(summarised: DataFrame, every: int = 5) -> DataFrame:
    """The deterministic provider of hierarchies (ours), as a table ``(doc_id, segment_id, seg_order, sec_no, title)``.

    A section begins at a markdown or numbered heading and at every ``every``-th segment behind the last beginning;
    its title is the first 60 code points of its first summary. Numbers run within ranges of ``seg_order`` and go on
    from what the ranges before hold, so a document of any size is spread over tasks.
    """
    key = ["doc_id", "range"]
    rows = summarised.select("doc_id", "segment_id", "seg_order", F.substring("summary", 1, 60).alias("summary"), F.floor(F.col("seg_order") / RANGE).alias("range"), F.coalesce(F.col("text").rlike(HEADING), F.lit(False)).alias("heading"))
    w = Window.partitionBy(*key).orderBy("seg_order")
    before = Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    rows = rows.withColumn("place", F.row_number().over(w))
    rows = rows.withColumn("start", F.max(F.when(F.col("heading"), F.col("place"))).over(w))
    held = rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("start").alias("start"))
    held = held.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = held.select(*key, "offset", F.max(F.col("offset") + F.col("start")).over(before).alias("earlier"))
    rows = rows.join(held, key)
    behind = F.col("offset") + F.col("place") - F.coalesce(F.col("offset") + F.col("start"), "earlier", F.lit(1))
    rows = rows.withColumn("opens", behind % every == 0).select(*key, "segment_id", "seg_order", "summary", "opens")

    rows = rows.withColumn("sections", F.sum(F.col("opens").cast("long")).over(w))
    rows = rows.withColumn("named", F.last(F.when(F.col("opens"), F.struct("summary")), ignorenulls=True).over(w))
    held = rows.groupBy(*key).agg(F.max("sections").alias("n"), F.max_by("named", "seg_order").alias("last"))
    held = held.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.last("last", ignorenulls=True).over(before).alias("earlier"))
    return rows.join(held, key).select("doc_id", "segment_id", "seg_order", (F.col("offset") + F.col("sections")).alias("sec_no"), F.coalesce("named", "earlier")["summary"].alias("title"))


def rule_responses(summarised: DataFrame, every: int = 5) -> DataFrame:
    """``(doc_id, response)``: the rule's sections as the JSON answer that a model would give, so that they pass the
    same validation."""
    rows = rule_sections(summarised, every).groupBy("doc_id", "sec_no").agg(F.sort_array(F.collect_list(F.struct("seg_order", "segment_id"))).alias("s"), F.min_by("title", "seg_order").alias("title"))
    section = F.struct(F.concat(F.lit("s"), F.col("sec_no")).alias("section_id"), F.coalesce("title", F.lit("")).alias("section_title"), F.transform("s", lambda x: x["segment_id"]).alias("segment_ids"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec_no", section.alias("section")))).alias("all"))
    return docs.select("doc_id", F.to_json(F.struct(F.transform("all", lambda x: x["section"]).alias("sections"))).alias("response"))
