"""The same queries as SQL for DuckDB, for comparison."""

from __future__ import annotations

from chunkspark.operators.chunkers import REGISTRY
from chunkspark.plans import queries as q

_WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
_NWS = r"[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_NL2 = "chr(10) || chr(10)"


def _quote(text: str | None) -> str:
    if text is None:
        return "null"
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(_quote(v) if v is None or isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f") as t({names})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def keep(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda v: {strip('v')}), lambda v: v <> '')"


def lines(x: str) -> str:
    parts = f"string_split_regex({x}, '{_BREAK}')"
    return f"(case when {parts}[-1] = '' then {parts}[:-2] else {parts} end)"


def sentences(x: str) -> str:
    return keep(f"regexp_extract_all({x}, '[^.?!]*[.?!]|[^.?!]+')")


def groups(s: str, v: str) -> str:
    return f"list_transform([{s}], lambda z: list_transform(range(0, len(z), 3), lambda {v}: array_to_string(z[{v}+1:{v}+3], ' ')))[1]"


def windows(x: str, size: int, step: int, v: str) -> str:
    t, n = "y", "length(y)"
    count = f"ceil({n} / {size})" if size == step else f"least(1 + ceil(greatest({n} - {size}, 0) / {step}), ceil({n} / {step}))"
    return f"list_transform([{strip(x)}], lambda y: list_transform(range(0, ({count})::bigint), lambda {v}: substring({t}, {v} * {step} + 1, {size})))[1]"


def _long(x: str, cut: str) -> str:
    return keep(f"flatten(list_transform(string_split({x}, {_NL2}), lambda p: case when length(p) <= 800 then [p] else {cut} end))")


_PARAGRAPHS = keep(f"string_split(text, {_NL2})")
CHUNKS = {
    "fixed": keep(windows("text", 800, 800, "i")),
    "sliding": keep(windows("text", 800, 400, "i")),
    "sentence": keep(groups(sentences("text"), "i")),
    "token_limit": keep(windows("text", 800, 800, "i")),
    "semantic": keep(groups(sentences("text"), "i")),
    "paragraph": _PARAGRAPHS,
    "recursive": _long("text", f"flatten(list_transform({groups(sentences('p'), 'i')}, lambda g: case when length(g) <= 800 then [g] else {windows('g', 800, 800, 'j')} end))"),
    "hybrid": _long("text", groups(sentences("p"), "i")),
    "delimiter": f"case when contains(text, '---') then {keep(chr(115) + 'tring_split(text, ' + _quote('---') + ')')} when contains(text, '###') then {keep('string_split(text, ' + _quote('###') + ')')} else {_PARAGRAPHS} end",
}

_DOCS = "(select doc_id, text from documents)"
_ALL_DOCS = "(select doc_id, coalesce(text, '') as text from documents)"
_SECTION_DOCS = "(select distinct doc_id || '/' || section_id as doc_id, text from section where text is not null)"
_SECTIONS = "(select distinct doc_id, section_id, sec_order, section_title, text from section)"
_SEGMENTS = "(select distinct doc_id, segment_id, seg_order, text from segment)"


def unnested(source: str, array: str, order: str) -> str:
    return f"select doc_id, generate_subscripts(a, 1) - 1 as {order}, unnest(a) as text from (select doc_id, {array} as a from {source})"


def format_aware(source: str) -> str:
    return f"""
        with l as (select doc_id, generate_subscripts(a, 1) - 1 as i, unnest(a) as line from (select doc_id, {lines('text')} as a from {source})),
        f as (select *, starts_with({strip('line')}, '```') as fence, coalesce(sum(starts_with({strip('line')}, '```')::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from l),
        p as (select *, coalesce(min(case when not fence and not inside then i end) over (partition by doc_id), 1000000000) as start from f),
        b as (select *, case when i < start then fence and not inside when i = start then true else not fence and not inside and regexp_matches(line, '^#{{1,6}}{_WS}+') end as cut from p),
        c as (select *, sum(cut::int) over (partition by doc_id order by i) as k from b),
        t as (select doc_id, k, {strip('string_agg(line, chr(10) order by i)')} as text from c where k > 0 group by doc_id, k)
        select doc_id, row_number() over (partition by doc_id order by k) - 1 as chunk_ord, text from t where text <> ''"""


def _md5(sql: str, columns: str) -> str:
    return f"select {columns}, md5(text) as text from ({sql})"


def _stats(by: str, methods: list[str]) -> str:
    arrays = " union all ".join(f"select doc_id, '{m}' as method, length(text) as source_len, {CHUNKS[m]} as chunks from {_ALL_DOCS}" for m in methods if m in CHUNKS)
    for m in ("format_aware", "hierarchical"):
        if m in methods:
            arrays += f" union all select d.doc_id, '{m}', length(d.text), coalesce(c.chunks, []) from {_ALL_DOCS} d left join (select doc_id, list(text order by chunk_ord) as chunks from ({globals()[m](_ALL_DOCS)}) group by doc_id) c using (doc_id)"
    return f"""
        with a as ({arrays}),
        src as (select {by}, sum(source_len) as src from a group by {by}),
        n as (select {by}, unnest(list_transform(chunks, lambda x: length(x))) as n from a),
        s as (select {by}, count(*) as num_chunks, avg(n) as av, stddev_pop(n) as sd, max(n) as mx, min(n) as mn, sum(n) as total from n group by {by})
        select {', '.join('src.' + b.strip() for b in by.split(','))}, coalesce(num_chunks, 0)::bigint as num_chunks, round(coalesce(av, 0), 6) as avg_chunk_len, round(coalesce(sd, 0), 6) as std_chunk_len,
            coalesce(mx, 0)::bigint as max_chunk_len, coalesce(mn, 0)::bigint as min_chunk_len, coalesce(total, 0)::bigint as total_chars, round(coalesce(src / nullif(total, 0), 0), 4) as compression_ratio
        from src left join s using ({by})"""


def rechunk(most: int, overlap: int, short: bool, source: str = _SECTIONS) -> str:
    t = strip("text")
    words = f"regexp_extract_all({t}, '{_NWS}+')"
    n = f"len({words})"
    w = f"list_transform(range(0, (case when {n} <= {most} then least({n}, 1) else 1 + ceil(({n} - {most}) / {most - overlap}) end)::bigint), lambda i: array_to_string(({words})[i * {most - overlap} + 1 : i * {most - overlap} + {most}], ' '))"
    array = f"case when ceil(length({t}) / 4) <= {most} then [{t}] else {w} end" if short else w
    return f"""select doc_id, section_id, section_title, chunk_ord, doc_id || '-' || section_id || '-' || chunk_ord as chunk_id, text from
        (select doc_id, section_id, coalesce(section_title, '') as section_title, generate_subscripts(a, 1) - 1 as chunk_ord, unnest(a) as text from
        (select doc_id, section_id, section_title, {array} as a from {source} where {strip("coalesce(text, '')")} <> ''))"""


_RULE = f"""
    with s as (select doc_id, segment_id, seg_order, coalesce(regexp_matches(text, '^(?:#{{1,6}}\\s|\\d+(?:\\.\\d+)*\\.?\\s)'), false)::int as heading from {_SEGMENTS}),
    h as (select *, sum(heading) over (partition by doc_id order by seg_order) as h from s),
    p as (select *, (row_number() over (partition by doc_id, h order by seg_order) - 1) // 5 as part from h),
    o as (select *, (row_number() over (partition by doc_id, h, part order by seg_order) = 1)::int as opens from p),
    r as (select *, sum(opens) over (partition by doc_id order by seg_order) as sec_no from o)"""

def hierarchical(source: str) -> str:
    """Chunks of the sections that the rule makes of paragraphs: (doc_id, chunk_ord, text)."""
    seg = f"select doc_id, generate_subscripts(a, 1) - 1 as seg_order, unnest(a) as text from (select doc_id, {_PARAGRAPHS} as a from {source})"
    rule = _RULE.replace(_SEGMENTS, f"(select doc_id, 'seg_' || seg_order as segment_id, seg_order, text from ({seg}))")
    sec = f"({rule} select doc_id, sec_no as section_id, null as section_title, string_agg(g.text, {_NL2} order by seg_order) as text from r join ({seg}) g using (doc_id, seg_order) group by doc_id, sec_no)"
    return f"select doc_id, row_number() over (partition by doc_id order by section_id, chunk_ord) - 1 as chunk_ord, text from ({rechunk(200, 30, True, sec)})"


_NEXT = f"select doc_id, chunk_id as src, lead(chunk_id) over (partition by doc_id, section_id order by chunk_ord) as dst, 'next' as relation from ({rechunk(200, 30, True)})"
_EDGES = f"""
    select distinct doc_id, doc_id as src, section_id as dst, 'has_section' as relation from {_SECTIONS}
    union all select distinct doc_id, section_id, chunk_id, 'has_chunk' from ({rechunk(200, 30, True)})
    union all select * from ({_NEXT}) where dst is not null"""


def _tf(source: str, key: str) -> str:
    return f"select {key}, (('0x' || substring(md5(token), 1, 8))::bigint % 512) as bucket, count(*) as tf from (select {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as token from {source}) group by 1, 2"


def _topk(index: str, key: str, queries: str, k: int) -> str:
    """Ranked cosine of sparse rows; rows without a common bucket fill up."""
    return f"""(
        with x as ({index}), y as ({queries}),
        nx as (select {key}, sqrt(sum(tf * tf)) as n from x group by 1), ny as (select query_id, sqrt(sum(tf * tf)) as m from y group by 1),
        dots as (select query_id, {key}, sum(x.tf * y.tf) as dot from x join y using (bucket) group by 1, 2),
        scored as (select ny.query_id, nx.{key}, round(coalesce(dot, 0) / (n * m), 6) as score from nx cross join ny left join dots on dots.{key} = nx.{key} and dots.query_id = ny.query_id)
        select query_id, {key}, score, row_number() over (partition by query_id order by score desc, {key}) as rank from scored qualify rank <= {k})"""


_STOP = " ".join(q.text.STOP_WORDS)
_MATCH = lambda x: strip(f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[-_]+', ' ', 'g'), '[^a-z0-9\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]', ' ', 'g'), '{_WS}+', ' ', 'g')".replace("{{", "{").replace("}}", "}"))


def _keywords(source: str, k: int) -> str:
    words = f"list_filter(regexp_extract_all({_MATCH('text')}, '[^ ]+'), lambda w: length(w) > 2 and not list_contains(string_split('{_STOP}', ' '), w))"
    return f"""select doc_id, row_number() over (partition by doc_id order by n desc, first) as rank, keyword, n from
        (select doc_id, keyword, count(*) as n, min(pos) as first from (select doc_id, generate_subscripts(a, 1) as pos, unnest(a) as keyword from (select doc_id, {words} as a from {source})) group by 1, 2) qualify rank <= {k}"""


def _fallback(source: str) -> str:
    questions = _values(list(enumerate(q.querygen.FALLBACK_QUESTIONS)), "query_no, query")
    none = "[" + ", ".join(_quote(w) for w in q.querygen.FALLBACK_NEEDLES) + "]"
    return f"""select doc_id, query_no, query, kw[(query_no * 4) % len(kw) + 1 : (query_no * 4) % len(kw) + 4] as must_contain from
        (select d.doc_id, coalesce(k.kw[1:35], {none}) as kw from (select distinct doc_id from {source}) d left join (select doc_id, list(keyword order by rank) as kw from ({_keywords(source, 40)}) group by 1) k using (doc_id)), {questions}"""


def _clean(x: str) -> dict[str, str]:
    """Nested stages of cleaning; each takes the column of the stage below."""
    head = rf"^{_WS}*(\d+(?:\.\d+)*){_WS}+(.+?){_WS}*$"
    numeric = f"array_to_string(list_transform({lines(x)}, lambda v: case when regexp_matches(v, '{head}') then regexp_replace({strip('v')}, '{_WS}+', ' ', 'g') else v end), chr(10))"
    block = rf"(?im:^{_WS}*(?:References|Bibliography)\b)(?s:.*)"
    rstrip = lambda v: f"regexp_replace({v}, '{_WS}+$', '')"
    cut = f"regexp_replace({x}, '{block}', '')"
    drop = f"case when regexp_matches({x}, '{block}') then {rstrip(cut)} || chr(10) else {x} end"
    blank = lambda v: f"regexp_replace({v}, '\\n{_WS}*\\n+', chr(10) || chr(10), 'g')"
    unix = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    newline = f"array_to_string(list_transform({lines(blank(unix))}, lambda v: {rstrip('v')}), chr(10))"
    greek = f"regexp_replace(regexp_replace({x}, '[^\\x20-\\x7E\\n\\t\\x{{370}}-\\x{{3ff}}]', ' ', 'g'), '[ \\t]+', ' ', 'g')"
    return {"numeric_headings": numeric, "drop_references": drop, "newlines": newline, "ascii_and_greek": greek, "end": f"{strip(blank(x))} || chr(10)"}


def _latex(x: str) -> str:
    for command, mark in q.clean.LATEX_LEVELS:
        x = f"regexp_replace({x}, '\\\\{command}\\*?\\{{{_WS}*([^}}]*?){_WS}*\\}}', '{mark} \\1', 'g')"
    return x


def oracle_sql() -> dict[str, str]:
    stage = _clean("text")
    out = {name: f"select doc_id, md5({stage[name]}) as text from documents where text is not null" for name in ("numeric_headings", "drop_references", "newlines", "ascii_and_greek")}
    nested = f"select doc_id, {_latex('text')} as text from documents where text is not null"
    for name in ("numeric_headings", "drop_references", "newlines", "ascii_and_greek", "end"):
        nested = f"select doc_id, {stage[name]} as text from ({nested})"
    out["clean_text"] = _md5(nested, "doc_id")
    out["latex_headings"] = f"select raw, {_latex('raw')} as text from {_values([(x,) for x in q.LATEX], 'raw')}"
    out["reference_blocks"] = f"select raw, {_clean('raw')['drop_references']} as text from {_values([(x,) for x in q.REFERENCES], 'raw')}"
    for name, source, sep in (("segment_lines", _DOCS, "chr(10)"), ("segment_paragraphs", _SECTION_DOCS, _NL2)):
        out[name] = _md5(unnested(source, keep(f"string_split(text, {sep})"), "seg_order"), "doc_id, 'seg_' || seg_order as segment_id, seg_order")
    out["sentences"] = _md5(unnested(_DOCS, sentences("text"), "sentence_no"), "doc_id, sentence_no")
    for m in ("fixed", "sliding", "sentence", "token_limit", "semantic", "delimiter"):
        out[f"{m}_chunks"] = _md5(unnested(_ALL_DOCS, CHUNKS[m], "chunk_ord"), "doc_id, chunk_ord")
    for m in ("paragraph", "recursive", "hybrid", "delimiter"):
        out[f"{m}_chunks_of_sections"] = _md5(unnested(_SECTION_DOCS, CHUNKS[m], "chunk_ord"), "doc_id, chunk_ord")
    out["format_aware_chunks_of_sections"] = _md5(format_aware(_SECTION_DOCS), "doc_id, chunk_ord")
    out["hierarchical_chunks_of_sections"] = _md5(hierarchical(_SECTION_DOCS), "doc_id, chunk_ord")
    out["format_aware_cases"] = format_aware(f"(select * from {_values(list(enumerate(q.MARKDOWN)), 'doc_id, text')})")
    out["chunk_stats"] = _stats("method", list(REGISTRY))
    out["chunk_stats_per_document"] = _stats("doc_id, method", ["fixed", "sentence", "recursive"])
    out["token_stats"] = f"select doc_id, round(avg(n), 6) as avg_tokens, max(n) as max_tokens, min(n) as min_tokens from (select doc_id, greatest(1, length(text) // 4) as n from ({unnested(_ALL_DOCS, CHUNKS['token_limit'], 'o')})) group by 1"
    out["token_estimate"] = f"select doc_id, ceil(length(text) / 4)::bigint as estimate, len(regexp_extract_all(text, '{_NWS}+')) as tokens from documents where text is not null"
    out["alnum_tokens"] = "select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as token from documents) group by 1"
    t = strip("text")
    out["summaries"] = f"select doc_id, segment_id, md5(case when length({t}) < 40 then {t} else coalesce({sentences('text')}[1], {t}) end) as summary from {_SEGMENTS} where text is not null"
    out["rule_sections"] = f"{_RULE} select doc_id, segment_id, 's' || sec_no as section_id, seg_order as place from r"
    out["materialize_sections"] = f"""{_RULE}, last as (select doc_id, segment_id, {strip("coalesce(text, '')")} as t from {_SEGMENTS})
        select doc_id, 's' || sec_no as section_id, sec_no - 1 as sec_order, md5(coalesce(string_agg(case when t <> '' then t end, {_NL2} order by seg_order), '')) as text from r join last using (doc_id, segment_id) group by doc_id, sec_no"""
    out["hierarchy_validate"] = _validate()
    out["rechunk_sections"] = _md5(rechunk(200, 30, True), "doc_id, section_id, chunk_ord, chunk_id")
    out["rechunk_windows"] = _md5(rechunk(50, 10, False), "doc_id, section_id, chunk_ord, chunk_id")
    chunks = rechunk(200, 30, True)
    out["graph_nodes"] = f"""
        select distinct doc_id, doc_id as node_id, 'doc' as type, null as title, null as section_id, null as text from {_SECTIONS}
        union all select doc_id, section_id, 'section', section_title, section_id, md5(text) from {_SECTIONS}
        union all select doc_id, chunk_id, 'chunk', section_title, section_id, md5(text) from ({chunks})"""
    out["graph_edges"] = _EDGES
    out["graph_counts"] = f"""
        select doc_id, 1 + s + coalesce(c, 0) as num_nodes, s + coalesce(c, 0) + coalesce(e, 0) as num_edges from (select doc_id, count(*) as s from {_SECTIONS} group by 1)
        left join (select doc_id, sum(n) as c, sum(n - 1) as e from (select doc_id, section_id, count(*) as n from ({chunks}) group by 1, 2) group by 1) using (doc_id)"""
    out["sibling_edges"] = f"with c as ({chunks}) select a.doc_id, a.chunk_id as src, b.chunk_id as dst from c a join c b on a.doc_id = b.doc_id and a.section_id = b.section_id and a.chunk_id <> b.chunk_id"
    out["vector_topk"] = """
        select query_id, vec_id, score, rank from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from
        (select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a cross join embeddings b where a.vec_id % 100 = 0)) where rank <= 3"""
    out["vector_norm"] = "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings"
    out["hash_tf"] = _tf("documents", "doc_id")
    docs_tf = _tf("documents", "doc_id")
    out["hash_topk"] = f"select * from {_topk(docs_tf, 'doc_id', f'select doc_id as query_id, bucket, tf from ({docs_tf}) where doc_id % 100 = 0', 5)}"
    out["sparse_topk"] = out["hash_topk"]
    out["zero_topk"] = "select a.doc_id as query_id, b.doc_id, 0.0 as score, b.rank from documents a, (select doc_id, row_number() over (order by doc_id) as rank from documents qualify rank <= 3) b where a.doc_id % 100 = 0"
    asked = _tf("(select doc_id as query_id, text from documents where doc_id % 100 = 0)", "query_id")
    out["graph_retrieval"] = f"""
        with hits as (select * from {_topk(_tf(f'({chunks})', 'chunk_id'), 'chunk_id', asked, 5)}),
        found as (select query_id, rank as hit_rank, 0 as is_neighbor, chunk_id, score from hits union all select query_id, rank, 1, dst, score from hits join ({_NEXT}) n on n.src = hits.chunk_id where dst is not null)
        select query_id, hit_rank, is_neighbor, chunk_id, score from found qualify row_number() over (partition by query_id, chunk_id order by hit_rank, is_neighbor) = 1"""
    out["ingestion_report"] = _report()
    hay = _MATCH("text")
    out["contains_match"] = f"select distinct chunk_id, (contains({hay}, 'low rank') or contains({hay}, 'thermal') or contains({hay}, 'eq 1')) as hit from chunk where text is not null"
    out["top_keywords"] = _keywords("documents", 25)
    out["fallback_queries"] = f"select doc_id, query_no, query, array_to_string(must_contain, ',') as needles from ({_fallback('documents')})"
    out["llm_queries_parse"] = _parse()
    out["recall_at_k"], out["corpus_recall"] = _recall(3, "(select * from documents where doc_id % 100 = 0)"), _recall(1)
    rows = [(m, r if n % 2 else None) for m, n, r in q.RESULTS] + [(m, r) for m, n, r in q.RESULTS if n > 1000]
    out["recall_aggregate"] = f"select method, count(*) as n, round(avg(coalesce(r, 0)::double), 6) as avg_recall, min(coalesce(r, 0))::double as min_recall, max(coalesce(r, 0))::double as max_recall from {_values(rows, 'method, r')} group by 1"
    out["pareto_frontier"] = f"select ordinal, method, total_chunks, recall::double as recall from (select *, max(recall) over (order by total_chunks, ordinal rows between unbounded preceding and 1 preceding) as best from {_values([(i, *r) for i, r in enumerate(q.RESULTS)], 'ordinal, method, total_chunks, recall')}) where recall >= coalesce(best, 0)"
    out["filename_normalize"] = "select distinct file, replace(lower(upper(substring(file, 1, 3)) || ' ' || substring(file, 4)), ' ', '_') as name, regexp_replace(file, '(.)\\.[^.]+$', '\\1') as doc_id from doc_domain"
    return out


def _report() -> str:
    seg = f"select doc_id, generate_subscripts(a, 1) - 1 as seg_order, unnest(a) as text from (select doc_id, {_PARAGRAPHS} as a from {_SECTION_DOCS})"
    rule = _RULE.replace(_SEGMENTS, f"(select doc_id, 'seg_' || seg_order as segment_id, seg_order, text from ({seg}))")
    t = "text"
    words = f"len(regexp_extract_all({t}, '{_NWS}+'))"
    pieces = f"case when ceil(length({t}) / 4) <= 200 or {words} <= 200 then 1 else 1 + ceil(({words} - 200) / 170) end"
    return f"""{rule}, sec as (select doc_id, sec_no, string_agg(g.text, {_NL2} order by seg_order) as text from r join ({seg}) g using (doc_id, seg_order) group by 1, 2),
        c as (select doc_id, sec_no, ({pieces})::bigint as n from sec), per as (select doc_id, count(*) as num_sections, sum(n)::bigint as num_chunks, sum(n - 1)::bigint as nexts from c group by 1)
        select doc_id, num_segments, num_sections, num_chunks, 1 + num_sections + num_chunks as num_graph_nodes, num_sections + num_chunks + nexts as num_graph_edges
        from (select doc_id, count(*) as num_segments from r group by 1) join per using (doc_id)"""


_FENCED = lambda x: f"case when starts_with({strip(x)}, '```') and len(string_split({strip(x)}, '```')) >= 3 then {strip(f'string_split({strip(x)}, chr(96) || chr(96) || chr(96))[2]')} else {strip(x)} end"


def _validate() -> str:
    """Answers parsed and checked with DuckDB's JSON functions."""
    rows = _values([(i, a) for i, (a, _) in enumerate(q.ANSWERS)], "doc_id, response")
    ids = "['seg_0', 'seg_1', 'seg_2']"
    tail, inner = (f"regexp_extract(t, '(?s)(\\{{.*\\}}){end}', 1)" for end in ("$", ""))
    part = lambda path: f"list_transform(sections, lambda s: s->'{path}')"
    shape = f"len(list_filter(sections, lambda s: coalesce(json_exists(s, '$.section_title') and json_type(s, '$.section_id') = 'VARCHAR' and json_type(s, '$.segment_ids') = 'ARRAY', false))) = len(sections)"
    return f"""
        with t as (select doc_id, {_FENCED('response')} as t from {rows}),
        j as (select doc_id, case when json_valid(t) then t when json_valid({tail}) then {tail} when json_valid({inner}) then {inner} end as j from t),
        s as (select doc_id, case when json_type(j, '$.sections') = 'ARRAY' then json_extract(j, '$.sections[*]') else [] end as sections from j),
        p as (select doc_id, sections, len(sections) > 0 and {shape} as shaped, flatten(list_transform({part('$.segment_ids')}, lambda x: json_extract(x, '$[*]'))) as members, {part('$.section_id')} as names from s),
        v as (select *, coalesce(shaped and list_transform(members, lambda m: m::varchar) = list_transform({ids}, lambda m: '"' || m || '"') and len(list_distinct(list_transform(names, lambda n: n::varchar))) = len(names), false) as valid from p)
        select doc_id, valid, case when valid then len(sections) else 1 end as n_sections, case when valid then sections[1]->>'$.section_title' else 'All Segments' end as first_title from v"""


def _parse() -> str:
    """Query sets read out of answers with DuckDB's JSON functions."""
    rows = _values(list(enumerate(q.RAW_QUERIES)), "id, raw")
    inner = "regexp_extract(t, '(?s)(\\[.*\\])', 1)"
    needles = f"list_transform(list_filter(must, lambda n: {strip('n')} <> ''), lambda n: lower(n))"
    return f"""
        with t as (select id, {_FENCED('raw')} as t from {rows}),
        a as (select id, case when json_valid({inner}) then json_extract({inner}, '$[*]') else [] end as a from t),
        e as (select id, generate_subscripts(a, 1) as place, unnest(a) as e from a),
        f as (select id, place, {strip("coalesce(e->>'$.query', '')")} as query, json_extract_string(e, '$.must_contain[*]') as must from e where json_type(e, '$.must_contain') = 'ARRAY')
        select id, row_number() over (partition by id order by place) - 1 as n, query, array_to_string({needles}, ',') as needles from f where query <> '' and len(must) > 0"""


def _recall(k: int, asking: str = "documents") -> str:
    asked = f"select doc_id || '-' || query_no as query_id, query, must_contain from ({_fallback(asking)})"
    worded = _tf(f"(select query_id, query || ' ' || array_to_string(must_contain, ' ') as text from ({asked}))", "query_id")
    parts = []
    for m in REGISTRY:
        source = globals()[m](_ALL_DOCS) if m in ("format_aware", "hierarchical") else unnested(_ALL_DOCS, CHUNKS[m], "chunk_ord")
        chunks = f"select doc_id || '-{m}-' || chunk_ord as id, text from ({source})"
        parts.append(f"""
            select '{m}' as method, round(hits / total, 6) as recall_at_k, num_chunks, {k} as k, total as total_queries, hits from
            (select count(distinct h.query_id) as hits from {_topk(_tf(f'({chunks})', 'id'), 'id', worded, k)} h join ({chunks}) c using (id) join ({asked}) a using (query_id)
                where len(list_filter(a.must_contain, lambda n: n <> '' and contains({_MATCH('c.text')}, {_MATCH('n')}))) > 0),
            (select count(*) as total from ({asked})), (select count(*) as num_chunks from ({chunks}))""")
    return " union all ".join(parts)
