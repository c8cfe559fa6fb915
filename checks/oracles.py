"""The registered queries as SQL for an independent engine."""

from __future__ import annotations

from checks.queries import ALWAYS, MODEL_LIMIT
from lorekeep.functions import prompts
from lorekeep.functions.text import INSTRUCTION_PHRASES
from lorekeep.operators.conversations import MAX_STEPS_ANSWER
from lorekeep.operators.search import NOTHING_FOUND, _planes

_SPACES = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_NL = "chr(10)"


def _quoted(text: str) -> str:
    """A Python string as an SQL expression; line ends become chr(10)."""
    parts = ["'" + part.replace("'", "''") + "'" for part in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _strip(text: str) -> str:
    return f"trim({text}, {_SPACES})"


def _last(window: str, separator: str) -> str:
    """Offset of the last occurrence, or -1."""
    found = f"position(reverse({separator}) in reverse({window}))"
    return f"(case when {found} = 0 then -1 else length({window}) - {found} + 1 - length({separator}) end)"


def _cut(window: str, size: int, rules: list[tuple[str, int]]) -> str:
    """Length kept of a full window: the first separator whose last hit lies far enough in."""
    branches = " ".join(
        f"when {_last(window, separator)} > {beyond} then {_last(window, separator)} + length({separator})"
        for separator, beyond in rules
    )
    return f"(case {branches} else {size} end)"


# The tables hold no fences, headings or rules, so only these separators can cut; `chunk_markdown` has the rest.
_CHUNK_RULES = [
    (f"({_NL} || {_NL})", 2000),
    (f"('. ' || {_NL})", 2000),
    (f"('.' || {_NL})", 2000),
    ("'. '", 2000),
    ("'! '", 2000),
    (f"('?' || {_NL})", 2000),
    (_NL, 1333),
]
_SUB_RULES = [
    ("'. '", 600),
    (f"('.' || {_NL})", 600),
    ("'! '", 600),
    (f"('?' || {_NL})", 600),
    (f"({_NL} || {_NL})", 600),
]


def _walk(name: str, source: str, size: int, overlap: int, rules: list[tuple[str, int]]) -> str:
    """CTEs cutting ``source(key, text)`` into ``<name>(key, pos, start_at, end_at, text)``."""

    def end(start: str) -> str:
        window = f"substr(d.text, {start} + 1, {size})"
        return f"case when {start} + {size} >= length(d.text) then length(d.text) else {start} + {_cut(window, size, rules)} end"

    return f"""
{name}_walk(key, step, s, e) as (
  select d.key, 0, 0::bigint, ({end('0')})::bigint from {source} d where length(d.text) > 0
  union all
  select w.key, w.step + 1, w.e - {overlap}, ({end(f'(w.e - {overlap})')})::bigint
  from {name}_walk w join {source} d on d.key = w.key where w.e < length(d.text)
),
{name} as (
  select p.key, row_number() over (partition by p.key order by p.s) - 1 as pos, p.s as start_at, p.e as end_at, p.text
  from (select w.key, w.s, w.e, {_strip('substr(d.text, w.s + 1, w.e - w.s)')} as text
        from {name}_walk w join {source} d on d.key = w.key) p
  where p.text <> ''
)"""


_DOCS = "docs as (select doc_id as key, text, source from documents)"
_CHUNKS = f"with recursive {_DOCS},{_walk('chunks', 'docs', 4000, 400, _CHUNK_RULES)}"
_FRESH = """
hashed as (select c.key as doc_id, c.pos, d.source, length(c.text) as length, md5(c.text) as hash
           from chunks c join docs d on d.key = c.key),
fresh as (select * from hashed
          qualify row_number() over (partition by hash order by source, doc_id::varchar, pos) = 1)"""
_FIRST_CHUNKS = f"{_CHUNKS},{_FRESH}"


def _statements(text: str) -> str:
    """List of all statements of a text."""
    phrases = " or ".join(f"contains(lower(x), '{phrase}')" for phrase in INSTRUCTION_PHRASES)
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: {_strip('x')})"
    kept = f"list_filter({lines}, lambda x: x <> '' and not ({phrases}))"
    bare = _strip("ltrim(x, '0123456789.)-•*# ')")
    clean = _strip(f"rtrim({_strip(f"regexp_replace({bare}, '^[0-9a-zA-Z]+[.)]\\s+', '')")}, '?')")
    words = r"len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))"
    return f"list_filter(list_transform({kept}, lambda x: {clean}), lambda x: {words} >= 10)"


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"

# Chunks with the list of their statements: two per piece, pieces only for long chunks.
_SUMMARIES = f"""{_CHUNKS},
numbered as (select key * 1000 + pos as key, key as doc_id, pos, text from chunks),
longer as (select key, text from numbered where length(text) > 1200),
{_walk('pieces', 'longer', 1200, 200, _SUB_RULES)},
every_piece as (
  select key, pos, text from pieces
  union all select key, 0, text from numbered where length(text) <= 1200
),
told as (select key, pos, unnest({_statements('text')}[1:2]) as statement,
                generate_subscripts({_statements('text')}[1:2], 1) as place from every_piece),
summaries as (select key, list(statement order by pos, place) as found from told group by key)"""


# What the stand-in for a model says of every piece: nothing, one statement, or one in each of two calls.
_SAID = "'The passage has ' || length(text) || ' characters and the prompt that came with it asked for %d statements about what it says.'"
_BY_MODEL = _SUMMARIES[: _SUMMARIES.index("told as (")] + f"""
told as (
  select key, pos, {_SAID % 2} as statement, 1 as place from every_piece where length(text) % 7 <> 0
  union all
  select key, pos, {_SAID % 1}, 2 from every_piece where length(text) % 7 <> 0 and length(text) % 5 <> 0
),
summaries as (select key, list(statement order by pos, place) as found from told group by key)"""


def _unit(rows: str) -> str:
    """Bucket weights of ``rows(key, text)``, as single-precision numbers."""
    return f"""
    select key, bucket, (n / sqrt(sum(n * n) over (partition by key)))::float::double as w from (
      select key, ('0x' || substr(md5(token), 1, 8))::bigint % 256 as bucket, count(*)::double as n
      from (select key, unnest(regexp_split_to_array(lower(text), '\\s+')) as token from {rows}) where token <> ''
      group by 1, 2)"""


_LABELS = """
means as (
  select label as query_id, list(m order by place) as q from (
    select label, place, avg(v) as m from (
      select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as place from embeddings)
    group by 1, 2) group by 1),
held as (select vec_id, embedding::double[] as v from embeddings),
scores as (
  select query_id, vec_id, vec_id // 10 as chunk_id, vec_id // 5 as tool_no,
         round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 9) as sim
  from means, held)"""


def _top_chunks(source: str, k: int) -> str:
    return f"""
  select query_id, row_number() over (partition by query_id order by sim desc, chunk_id) as rank, chunk_id, sim
  from (select query_id, chunk_id, max(sim) as sim from {source} group by 1, 2)
  qualify rank <= {k}"""


_TEXT_SCORES = f"""
docs_k as (select doc_id as key, text from documents),
items_k as (select item_id as key, text from benchmark),
doc_w as ({_unit('docs_k')}),
item_w as ({_unit('items_k')}),
doc_n as (select key, sqrt(sum(w * w)) as n from doc_w group by 1),
item_n as (select key, sqrt(sum(w * w)) as n from item_w group by 1),
scores as (
  select i.key as query_id, d.key as chunk_id, round(coalesce(dot, 0) / (i.n * d.n), 9) as sim
  from item_n i cross join doc_n d
  left join (select a.key as q, b.key as c, sum(a.w * b.w) as dot
             from item_w a join doc_w b using (bucket) group by 1, 2) on q = i.key and c = d.key)"""

def _by_kind(*texts: str) -> str:
    branches = " ".join(f"when event_id % {len(texts)} = {number} then {text}" for number, text in enumerate(texts))
    return f"case {branches} end"


_CALL = """'{"name": "' || event_type || '", "arguments": ' || props || '}'"""
_NAMELESS = """'{"arguments": ' || props || '}'"""
_AS_TEXT = """'{"name": "' || event_type || '", "arguments": "' || replace(props, '"', '\\"') || '"}'"""
_O, _C = "'<tool_call>'", "'</tool_call>'"
_TOOL_MESSAGES = f"""
msgs as (
  select user_id as conv_id, event_id as turn, event_id, event_type, props,
    case event_type when 'view' then 'user' when 'error' then 'tool' else 'assistant' end as role,
    {_by_kind(
        f"{_O} || chr(10) || {_CALL} || chr(10) || {_C}",
        f"{_O} || {_O} || {_CALL} || {_C} || {_C}",
        f"'Let me see. ' || {_O} || 'call: ' || {_CALL} || ' now' || {_C} || ' Done.'",
        f"{_O} || {_NAMELESS} || {_C}",
        f"{_O} || {_CALL}",
        f"{_O} || {_CALL} || {_C} || ' and ' || {_O} || {_CALL} || {_C}",
        f"{_O} || {_AS_TEXT} || {_C}",
        f"{_O} || '{{\"name\": ' || {_C} || {_O} || {_CALL} || {_C}",
    )} as content
  from events)"""
# What each kind of message holds, by construction.
_CALLS = f"""{_TOOL_MESSAGES},
held as (
  select conv_id, turn, event_type, props, place as ordinal, 'call_' || place as id,
    case when event_id % 8 = 3 or (event_id % 8 = 7 and place = 0) then 'dropped'
         when event_id % 8 = 2 then 'recovered' else 'parsed' end as outcome,
    case when event_id % 8 = 6 then props else replace(props, ': ', ':') end as args
  from msgs, (values (0::bigint), (1::bigint)) p(place)
  where event_id % 8 <> 4 and (place = 0 or event_id % 8 in (5, 7))),
calls as (select conv_id, turn, ordinal, id, event_type as name, args as arguments, outcome, props
          from held where outcome <> 'dropped')"""

_BULLET = "'  • '"
_INVALID_CLICK = _quoted(
    "Tool call failed: click\n\nError: {error}\n\nInvalid parameter(s): k\n\nValid parameters for this tool:\n"
    "  • id (optional): Item\n\nPlease call the tool again with only the valid parameters listed above."
)
_MISSING_PURCHASE = _quoted(
    "Tool call failed: purchase\n\nError: {error}\n\nMissing required parameter(s): mode\n\nRequired parameters:\n"
    "  • mode: How\n\nOptional parameters:\n  • k: No description\n\n"
    "Please call the tool again with all required parameters."
)

_TOOLS = """
listed as (
  select p_brand as server, p_brand || '.' || replace(p_name, ' ', '_') || '_' || p_partkey as name,
    '[MCP: ' || p_brand || '] ' || case when p_size % 3 <> 1 then p_type || ' ' || p_name else '' end as description,
    p_size % 3 <> 0 as has_schema, p_size, p_type, p_partkey
  from part)"""

_BATCH = f"""
batch as (
  select doc_id as chunk_id, source, {_statements('text')}[1:2] as found from documents),
counts as (
  select source, count(*) as stored, count(*) filter (len(found) > 0) as complete,
         count(*) filter (len(found) = 0) as failed, sum(len(found))::bigint as questions
  from batch group by 1)"""

_LOG = """
log as (
  select doc_id as chunk_id, 0::bigint as attempt, 'pending' as status, null::varchar as error from labels
  union all select doc_id, 1, 'complete', null from labels where quality = 1
  union all select doc_id, 2, 'failed', 'model error' from labels where toxic = 1),
latest as (select * from log qualify row_number() over (partition by chunk_id order by attempt desc) = 1)"""


def _exchanges(source: str) -> str:
    return f"""
ex as (select *, (sum((role = 'user')::int) over (partition by conv_id order by turn
                  rows unbounded preceding))::bigint as exchange from {source})"""


_ANSWERS = "(select conv_id, exchange, arg_max(content, turn) as final_answer from ex where role = 'assistant' group by 1, 2)"
_MESSAGES = "m as (select conv_id, turn, role, text as content from conversations)"
_HISTORY = f"""with {_MESSAGES},
talk as (select *, row_number() over (partition by conv_id order by turn desc) as back from m where role <> 'system')"""


def _shown(answer: str) -> str:
    """Results as numbered lines."""
    return f"place || '. ' || {answer} || ' (relevance: ' || printf('%.2f', sim) || ')'"


SQL: dict[str, str] = {
    "chunk_documents": f"""{_CHUNKS}
select key as doc_id, pos, start_at, end_at, length(text) as length, md5(text) as hash from chunks""",
    "sub_chunks": f"""with recursive docs as (select doc_id as key, text from documents where length(text) > 1200),
{_walk('pieces', 'docs', 1200, 200, _SUB_RULES)}
select key as doc_id, pos, start_at, end_at, md5(text) as hash from pieces""",
    "dedup_chunks": f"{_FIRST_CHUNKS} select doc_id, pos, source, length, hash from fresh",
    "dedup_against_store": f"""{_FIRST_CHUNKS}
select doc_id, pos, source, hash from fresh
where hash not in (select hash from hashed where doc_id in (select doc_id from labels))""",
    "chunk_ids": f"""{_FIRST_CHUNKS}
select 99 + row_number() over (order by source, doc_id::varchar, pos) as chunk_id, doc_id, pos, hash from fresh""",
    "notes_as_docs": """
select conv_id || '-' || turn as doc_key, 'chat' as source,
       case when role = 'user' then text else role || ': ' || text end as text from conversations""",
    "search_topk_exact": f"""with {_LABELS}, top as ({_top_chunks('scores', 3)})
select query_id::bigint as query_id, rank, chunk_id, round(sim, 6) as similarity from top""",
    "search_topk_capped": f"""with {_LABELS},
near as (select * from scores qualify row_number() over (partition by query_id order by sim desc, vec_id) <= 6),
top as ({_top_chunks('near', 3)})
select query_id::bigint as query_id, rank, chunk_id, round(sim, 6) as similarity from top""",
    "retrieve_with_text": f"""with {_LABELS}, top as ({_top_chunks('scores', 3)})
select query_id::bigint as query_id, rank, chunk_id, round(sim, 6) as similarity, source, text
from top join documents on doc_id = chunk_id where text <> ''""",
    "retrieve_metadata_missing": f"""with {_LABELS}, top as ({_top_chunks('scores', 5)})
select query_id::bigint as query_id, rank, chunk_id, round(sim, 6) as similarity,
       case when l.doc_id is null then 'unknown' else source end as source
from top join documents d on d.doc_id = chunk_id left join labels l on l.doc_id = chunk_id where text <> ''""",
    "render_results": f"""with {_LABELS}, top as ({_top_chunks('scores', 3)}),
shown as (select query_id, row_number() over (partition by query_id order by rank) as place, text, sim
          from top join documents on doc_id = chunk_id where text <> '' and chunk_id % 2 = 0),
asked as (select query_id from means union all select query_id + 1000 from means),
told as (select query_id, string_agg({_shown('text')}, chr(10) order by place) as answer from shown group by 1)
select query_id::bigint as query_id, coalesce(answer, {_quoted(NOTHING_FOUND)}) as answer
from asked left join told using (query_id)""",
    "hash_embed": f"""with docs_k as (select doc_id as key, text from documents)
select key as doc_id, bucket, round(w, 6) as weight from ({_unit('docs_k')})""",
    "vector_functions": f"""with {_LABELS}
select s.vec_id, round(sqrt(list_dot_product(v, v)), 6) as norm,
       round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) as cosine,
       round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) as from_distance
from embeddings s join means on query_id = label join held h on h.vec_id = s.vec_id""",
    "text_search": f"""with {_TEXT_SCORES}, top as ({_top_chunks('scores', 3)})
select query_id, rank, chunk_id, round(sim, 6) as similarity from top""",
    "expand_queries": """
select p_partkey as query_id, p_name as text,
       case when p_size % 2 = 0 then p_name || ' of type ' || p_type
            when length('x') > length(p_name) then 'x' else p_name end as search_text from part
union all
select -item_id - 1, text, case when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 10
                                then text else text || ' and more' end from benchmark""",
    "parse_statements": f"""with found as (select doc_id, {_statements('text')}[1:3] as l from documents)
select doc_id, len(l) as statements, len(l) = 0 as parse_failed, array_to_string(l, chr(10)) as joined from found""",
    "summary_quality": f"""select doc_id, {_WORDS} as words,
       case when {_WORDS} < 10 then 'short' when {_WORDS} > 40 then 'long' else 'ok' end as quality from documents""",
    "extractive_summaries": f"""{_SUMMARIES}
select n.doc_id, n.pos, coalesce(len(found), 0) as questions, coalesce(array_to_string(found, chr(10)), '') as joined,
       case when found is null then 'Failed to generate any summaries' end as error
from numbered n left join summaries using (key)""",
    "question_vectors": f"""{_SUMMARIES}
select 'chunk_' || key || '_q' || (place - 1) as question_id, key as chunk_id, place - 1 as ordinal, question, 1.0::double as norm
from (select key, unnest(found) as question, generate_subscripts(found, 1) as place from summaries)""",
    "summary_prompts": f"""with p as (select doc_id,
  {_quoted(prompts.SUMMARY_PROMPT.split('%s')[0] % 2)} || text || {_quoted(prompts.SUMMARY_PROMPT.split('%s')[1])} as prompt
  from documents)
select doc_id, md5(prompt) as prompt_hash, length(prompt) as prompt_chars from p""",
    "truncated_answers": f"""with t as (select doc_id, case when length(text) > 8000
  then substr(text, 1, 8000) || {_quoted(prompts.TRUNCATION_MARKER)} else text end as cut from documents)
select doc_id, md5(cut) as hash, length(cut) as chars from t""",
    "memory_stats": """select count(*) as total_chunks, count(distinct source) as sources, count(text) as payloads,
       sum(length(text))::bigint as characters from documents""",
    "distinct_sources": "select distinct source from documents",
    "list_by_source": "select source, count(*) as chunks from documents group by 1",
    "list_filtered": """select doc_id as chunk_id, source, length(text) as length from documents
where contains(source, 'src') and contains(source, '1')""",
    "preview": """select doc_id as chunk_id, case when length(text) > 200
  then substr(text, 1, 200) || chr(10) || '... (' || (length(text) - 200) || ' more characters)' else text end as preview
from documents""",
    "find_by_text": "select doc_id as chunk_id, md5(text) as hash from documents where doc_id % 2 = 0",
    "load_report": f"""with {_BATCH}
select source, stored, complete, failed, questions, round(100.0 * complete / stored, 6)::double as success_rate from counts""",
    "load_total": f"""with {_BATCH}
select count(*) as sources, sum(stored)::bigint as stored, sum(complete)::bigint as complete, sum(failed)::bigint as failed,
       sum(questions)::bigint as questions, round(100.0 * sum(complete) / sum(stored), 6)::double as success_rate from counts""",
    "ingest_stats": f"""with {_BATCH},
part_of as (select * from batch where chunk_id in (select doc_id from labels))
select count(*) as chunks_stored, count(*) filter (len(found) > 0) as chunks_complete,
       count(*) filter (len(found) = 0) as chunks_failed, sum(len(found))::bigint as questions_generated,
       (select count(*) from batch) as total_chunks, (select count(*) from batch where len(found) > 0) as total_complete,
       (select count(*) from batch where len(found) = 0) as total_failed from part_of""",
    "failures": f"""with {_BATCH}
select source, chunk_id, 'Failed to generate any summaries...' as error,
       (select count(*) from batch where len(found) = 0) as total_failed
from batch where len(found) = 0 order by source, chunk_id limit 10""",
    "status_latest": f"with {_LOG} select chunk_id, attempt, status, error from latest",
    "status_backfilled": f"""with {_LOG}
select source, coalesce(status, 'complete') as status, count(*) as chunks
from documents left join latest on chunk_id = doc_id group by 1, 2""",
    "pending_chunks": f"""with {_LOG}
select chunk_id, source, attempt from documents join latest on chunk_id = doc_id where status = 'pending'""",
    "orphans": "select doc_id as chunk_id, source from documents where doc_id not in (select doc_id from labels)",
    "without_orphans": "select doc_id as chunk_id, source from documents where doc_id in (select doc_id from labels)",
    "select_tools": f"""with {_LABELS},
best as (select query_id, tool_no, max(sim) as sim, arg_min(vec_id, (-sim, vec_id)) as vec_id from scores group by 1, 2)
select query_id::bigint as query_id, row_number() over (partition by query_id order by sim desc, 'tool_' || tool_no) as rank,
       'tool_' || tool_no as tool, round(sim, 6) as similarity, vec_id % 5 as ordinal, 'summary ' || vec_id as summary
from best qualify rank <= 3""",
    "select_tools_slots": f"""with {_LABELS},
best as (select query_id, 'tool_' || tool_no as tool, max(sim) as sim from scores group by 1, 2),
fixed as (select unnest({sorted(ALWAYS)!r}) as tool, generate_subscripts({sorted(ALWAYS)!r}, 1) as place),
other as (select query_id, row_number() over (partition by query_id order by sim desc, tool) as place, tool, sim
          from best where tool not in (select tool from fixed) qualify place <= 3)
select query_id::bigint as query_id, place as rank, tool, null::double as similarity from means, fixed
union all select query_id::bigint, place + 2, tool, round(sim, 6) from other""",
    "tool_index_stats": """
select 'tool_' || (vec_id // 5) as name, 'About tool_' || (vec_id // 5) as description,
       string_agg('summary ' || vec_id, '|' order by vec_id) as example_queries,
       round(sum(sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as norms
from embeddings group by vec_id // 5""",
    "tool_index_header": """select count(distinct vec_id // 5) as num_tools, max(len(embedding)) as embedding_dim
from embeddings""",
    "index_tools": f"""with {_TOOLS}
select name as tool, 0::bigint as ordinal, 'cached summary' as summary, 1.0::double as norm from listed where server = 'Brand#2'
union all select name, 1, name, 1.0 from listed where server = 'Brand#2'
union all select name, 0, trim(description), 1.0 from listed where server <> 'Brand#2'""",
    "catalog_flatten": f"""with {_TOOLS}
select name, description, server, case when has_schema then 'size,kind' else '' end as params,
       case when has_schema then 'size' else '' end as required from listed""",
    "rpc_result_text": f"""
select event_id, {_by_kind(
        "event_type",
        """'[{"type":"image"}]'""",
        "event_type",
        """'{"value":"' || event_type || '"}'""",
        "'MCP tool call failed: ' || event_type",
        "'MCP tool call failed: Unknown error'",
        "'MCP tool call failed: No response'",
    )} as text, event_id % 7 >= 4 as is_error from events""",
    "tool_wire_json": f"""with {_TOOLS}
select name, '{{"type":"function","function":{{"name":"' || name || '","description":"' || description || '","parameters":' ||
  case when has_schema then '{{"type":"object","properties":{{"size":{{"type":"integer","description":"Up to ' || p_size ||
    '"}},"kind":{{"type":"string","description":"' || p_type || '"}}}},"required":["size"]}}'
  else '{{"type": "object", "properties": {{}}}}' end || '}}}}' as wire from listed""",
    "render_tool_prompt": f"""with {_TOOLS},
blocks as (
  select p_partkey // 3 as query_id, p_partkey % 3 as place,
    chr(10) || name || ': ' || description || chr(10) || '  Parameters:' || chr(10) ||
    case when has_schema then '    size (required): Up to ' || p_size || chr(10) || '    kind: ' || p_type else '' end ||
    chr(10) || '  ' || chr(10) || '  Example usage:' || chr(10) || '  <tool_call>' || chr(10) ||
    '{{' || chr(10) || '  "name": "' || name || '",' || chr(10) || '  "arguments": {{' ||
    case when has_schema then chr(10) || '    "size": "<size_value>"' || chr(10) || '  ' else '' end ||
    '}}' || chr(10) || '}}' || chr(10) || '  </tool_call>' as block
  from listed)
select query_id, 'You are helpful.' || chr(10) || chr(10) || '# Available Tools' || chr(10) ||
  string_agg(block, chr(10) order by place) || chr(10) || chr(10) || {_quoted(prompts.TOOL_PROMPT_CLOSING)} as prompt
from blocks group by 1""",
    "extract_tool_calls": f"""with {_CALLS}
select conv_id, turn, ordinal, id, case when outcome <> 'dropped' then event_type end as name,
       case when outcome <> 'dropped' then args end as arguments, outcome from held""",
    "incomplete_calls": "select user_id as conv_id, event_id as turn from events where event_id % 8 = 4",
    "unknown_tools": f"""with {_CALLS}
select conv_id, turn, ordinal, name, 'Error: Unknown tool ''' || name || '''' as error from calls where name = 'error'""",
    "validate_calls": f"""with {_CALLS}
select conv_id, turn, ordinal, name,
  case name when 'error' then 'unknown' when 'click' then 'invalid' when 'purchase' then 'missing' else 'ok' end as verdict,
  case name when 'error' then null when 'click' then 'k' else '' end as invalid,
  case name when 'error' then null when 'purchase' then 'mode' else '' end as missing,
  case name when 'error' then 'Error: Unknown tool ''error'''
            when 'click' then replace({_INVALID_CLICK}, '{{error}}', 'invalid params')
            when 'purchase' then replace({_MISSING_PURCHASE}, '{{error}}', 'missing required params') end as report
from calls""",
    "batch_tool_execution": f"""with {_CALLS}
select conv_id, turn, ordinal, id as tool_call_id, name, 'tool' as role,
  case name when 'error' then 'Error: Unknown tool ''error'''
            when 'view' then (2 * (props->>'$.k')::int)::varchar
            when 'click' then 'Error executing click: _click() got an unexpected keyword argument ''k'''
            when 'purchase' then replace({_MISSING_PURCHASE}, '{{error}}', 'missing mode')
            else 'Error executing signup: no place for ' || (props->>'$.k') end as content
from calls""",
    "batch_retrieve_calls": f"""with {_TEXT_SCORES}, top as ({_top_chunks('scores', 5)}),
shown as (select query_id, rank as place, text, sim from top join documents on doc_id = chunk_id
          where rank <= query_id % 5 + 1 and text <> '')
select query_id as call_id, string_agg({_shown('text')}, chr(10) order by place) as answer from shown group by 1""",
    "batch_store_calls": f"""
with recursive docs as (select doc_id as key, lang || ': ' || text as text from documents),
{_walk('chunks', 'docs', 4000, 400, _CHUNK_RULES)},
fresh as (select key from chunks qualify row_number() over (partition by md5(text) order by key, pos) = 1),
n as (select docs.key, count(fresh.key) as stored from docs left join fresh using (key) group by 1)
select key as call_id, case stored
  when 0 then 'Information NOT stored - this appears to be a duplicate or already exists in memory. No need to store again.'
  when 1 then 'Stored 1 new chunk in memory successfully.'
  else 'Stored ' || stored || ' new chunks in memory successfully.' end as answer from n""",
    "classify_errors": """
select event_id,
  case when event_id % 5 < 2 and floor(value * 1000) > 32768 * 0.8 then 'context'
       when event_id % 5 < 2 and user_id % 3 > 0 then 'completed'
       when event_id % 5 < 2 then 'decode'
       when event_id % 5 = 2 then 'context' else 'generic' end as kind,
  case when event_id % 5 = 4 then 'invalid_params' when event_id % 5 = 3 then 'missing_params' else 'generic' end as tool_kind
from events""",
    "history_window": f"""{_HISTORY}
select conv_id, turn, role, content, row_number() over (partition by conv_id order by turn) as position from talk where back <= 4""",
    "history_reset": "select conv_id, turn, role, text as content from conversations where role = 'system'",
    "prompt_window": f"""{_HISTORY}
select conv_id, row_number() over (partition by conv_id order by turn) as position, role, content from talk where back <= 3
union all select conv_id, 0, 'system', arg_max(content, turn) from m where role = 'system' group by 1""",
    "digest": f"""{_HISTORY},
lines as (select conv_id, turn, '[' || upper(role) || ']: ' ||
                 case when length(content) > 80 then substr(content, 1, 80) || '...' else content end as line
          from talk where back <= 5)
select conv_id, coalesce(string_agg(line, chr(10) order by turn), 'No messages yet') as digest
from (select distinct conv_id from m) left join lines using (conv_id) group by 1""",
    "exchange_final_answer": f"""with {_MESSAGES},{_exchanges('m')}
select conv_id, turn, role, content, exchange, final_answer from ex left join {_ANSWERS} using (conv_id, exchange)""",
    "exchange_split_turns": f"""with {_TOOL_MESSAGES},{_exchanges('msgs')}
select conv_id, turn, role, content, exchange, final_answer from ex left join {_ANSWERS} using (conv_id, exchange)""",
    "iteration_limit": f"""with {_TOOL_MESSAGES},{_exchanges('msgs')},
steps as (select conv_id, exchange, count(*) filter (role = 'assistant') as iterations,
                 count(*) filter (role = 'assistant' and not contains(content, '<tool_call>')) as free from ex group by 1, 2)
select conv_id, exchange, iterations, iterations >= 5 and free = 0 as limit_reached,
       case when iterations >= 5 and free = 0 then {_quoted(MAX_STEPS_ANSWER)} end as fallback_answer from steps""",
    "context_usage": f"""with {_MESSAGES},
last_user as (select conv_id, coalesce(max(turn) filter (role = 'user'), -1) as t from m group by 1),
sums as (select conv_id, count(*) as messages, sum(length(content))::bigint as total_chars,
  count(*) filter (turn > t and role not in ('user', 'system')) as new_messages,
  coalesce(sum(length(content)) filter (turn > t and role not in ('user', 'system')), 0)::bigint as new_chars
  from m join last_user using (conv_id) group by 1)
select conv_id, messages, new_messages, total_chars - new_chars as history_chars, new_chars, total_chars,
  0::bigint as tool_calls, 0::bigint as tool_responses, (total_chars - new_chars) // 4 as history_tokens,
  new_chars // 4 as new_tokens, total_chars // 4 as total_tokens,
  round((total_chars // 4) * 100.0 / 512, 6)::double as context_percent, total_chars // 4 > 512 * 0.8 as under_pressure
from sums""",
    "export_messages": """select conv_id, turn, role, text as content,
  '{"role":' || to_json(role) || ',"content":' || to_json(text) || '}' as wire from conversations""",
}


def _lsh(dim: int = 64, bits: int = 8, probes: int = 32, seed: int = 7) -> str:
    """Search in the cells nearest to each query, from the same planes."""
    planes = _planes(dim, bits, probes, seed).matrix.T.tolist()
    norm = "sqrt(list_dot_product({0}, {0}))"
    return f"""with {_LABELS},
planes as (select unnest({planes!r}) as p, unnest(range({bits})) as bit),
cells as (select vec_id, sum(case when list_dot_product(v, p) > 0 then 1 << bit else 0 end)::bigint as cell
          from held, planes group by 1),
margins as (select query_id, bit, list_dot_product(q, p) / {norm.format('q')} as m from means, planes),
own as (select query_id, sum(case when m > 0 then 1 << bit else 0 end)::bigint as cell from margins group by 1),
flips as (select unnest(range({1 << bits})) as flip),
costs as (select query_id, flip, sum(case when (flip >> bit) & 1 = 1 then m * m else 0 end) as cost
          from margins, flips group by 1, 2),
probed as (select query_id, xor(own.cell, flip) as cell from costs join own using (query_id)
           qualify row_number() over (partition by query_id order by cost, flip) <= {probes}),
near as (select s.* from scores s join cells using (vec_id) join probed using (query_id, cell)),
top as ({_top_chunks('near', 3)})
select query_id::bigint as query_id, rank, chunk_id, round(sim, 6) as similarity from top"""


def _refined() -> str:
    question = prompts.REFINE_PROMPT % ("Why?", "")
    return f"""select conv_id, turn, case when length(text) + {len(question)} <= {MODEL_LIMIT}
  then '[' || text || ']' else text end as refined from conversations where role = 'assistant'"""


SQL["ingest_documents"] = SQL["ingest_stream"] = f"""{_SUMMARIES},{_FRESH}
select row_number() over (order by source, doc_id::varchar, pos) - 1 as chunk_id, source, length, hash, hash as text_hash,
       case when found is null then 'failed' else 'complete' end as status,
       case when found is null then 3 else 1 end::bigint as attempt, coalesce(len(found), 0) as vectors
from fresh left join summaries on summaries.key = fresh.doc_id * 1000 + fresh.pos"""
SQL["store_cleared"] = SQL["ingest_documents"]
SQL["summaries_by_model"] = SQL["extractive_summaries"].replace(_SUMMARIES, _BY_MODEL).replace(
    "Failed to generate any summaries", "model down"
)
SQL["ingest_failures"] = SQL["ingest_documents"].replace(_SUMMARIES, _BY_MODEL).replace("then 3 else", "then 2 else")
SQL["ingest_twice"] = f"""{_SUMMARIES},
hashed as (select c.key as doc_id, c.pos, d.source, length(c.text) as length, md5(c.text) as hash, c.key % 3 = 2 as later
           from chunks c join docs d on d.key = c.key),
fresh as (select * from hashed
          qualify row_number() over (partition by hash order by later, source, doc_id::varchar, pos) = 1)
select row_number() over (order by later, source, doc_id::varchar, pos) - 1 as chunk_id, source, length, hash, hash as text_hash,
       case when found is null then 'failed' else 'complete' end as status,
       case when found is null then 3 else 1 end::bigint as attempt, coalesce(len(found), 0) as vectors
from fresh left join summaries on summaries.key = fresh.doc_id * 1000 + fresh.pos"""
SQL["ingest_report"] = f"""{_SUMMARIES},{_FRESH}
select source, count(*) as stored, count(found) as complete, count(*) - count(found) as failed,
       coalesce(sum(len(found)), 0)::bigint as questions, round(100.0 * count(found) / count(*), 6)::double as success_rate
from fresh left join summaries on summaries.key = fresh.doc_id * 1000 + fresh.pos group by 1"""
SQL["tool_index_saved"] = SQL["tool_index_stats"]
SQL["tool_index_keyed"] = SQL["tool_index_stats"]
SQL["search_few_vectors"] = SQL["search_topk_exact"]
SQL["lsh_stored_cells"] = _lsh()
SQL["lsh_recall"] = f"""with near as ({_lsh()}), exact as ({SQL["search_topk_exact"]})
select e.query_id, count(*) as hits, count(n.query_id) as found
from exact e left join near n on e.query_id = n.query_id and e.chunk_id = n.chunk_id group by 1"""
SQL["select_registered_tools"] = f"""with {_LABELS},
best as (select query_id, tool_no, max(sim) as sim from scores where tool_no % 2 = 0 group by 1, 2)
select query_id::bigint as query_id, row_number() over (partition by query_id order by sim desc, 'tool_' || tool_no) as rank,
       'tool_' || tool_no as tool, round(sim, 6) as similarity from best qualify rank <= 3"""
SQL["render_tool_prompt_all"] = """
select p_partkey as query_id, case when p_partkey % 2 = 0 then true end as described, p_partkey % 2 = 1 as whole_catalog,
       'Base.' as without_tools, false as of_none from part"""
SQL["catalog_blocks"] = f"""with {_TOOLS}
select name, md5(block) as hash from (select name,
    chr(10) || name || ': ' || description || chr(10) || '  Parameters:' || chr(10) ||
    case when has_schema then '    size (required): Up to ' || p_size || chr(10) || '    kind: ' || p_type else '' end ||
    chr(10) || '  ' || chr(10) || '  Example usage:' || chr(10) || '  <tool_call>' || chr(10) ||
    '{{' || chr(10) || '  "name": "' || name || '",' || chr(10) || '  "arguments": {{' ||
    case when has_schema then chr(10) || '    "size": "<size_value>"' || chr(10) || '  ' else '' end ||
    '}}' || chr(10) || '}}' || chr(10) || '  </tool_call>' as block from listed)"""
SQL["failed_listings"] = """
select event_id::varchar as server, 'MCP server ''' || event_id || ''' ' || case event_id % 7
  when 4 then 'tools/list failed: ' || event_type when 5 then 'tools/list failed: Unknown error'
  when 6 then 'returned no response for tools/list' else 'listed no tools' end as error from events"""
SQL["markdown_files"] = f"""
select md5(text) as hash, length(text) as n, count(*) as files from documents where {_strip('text')} <> '' group by 1, 2"""
SQL["extract_structured_calls"] = """
select user_id as conv_id, event_id as turn, place as ordinal,
  case when event_id % 3 = 0 then 'id_' || event_id else 'call_0' end as id,
  case when event_id % 3 = 0 then event_type else 'written' end as name,
  case when event_id % 3 = 0 then props else '{}' end as arguments,
  case when event_id % 3 = 0 then 'structured' else 'parsed' end as outcome
from events, (values (0::bigint), (1::bigint)) p(place) where event_id % 3 = 0 or place = 0"""
SQL["validate_undecodable"] = """
select event_id, event_type as name,
  case when event_type = 'error' then 'unknown' when event_id % 2 = 1 then 'undecodable' when event_type = 'click' then 'invalid'
       when event_type = 'purchase' then 'missing' else 'ok' end as verdict,
  case when event_type = 'error' or event_id % 2 = 1 then null when event_type = 'purchase' then 1 else 0 end::bigint as n_missing,
  event_type <> 'error' and event_id % 2 = 0 and event_type not in ('click', 'purchase') as fine from events"""
SQL["registered_function"] = f"""with {_CALLS}
select conv_id, turn, ordinal, 'seen ' || (props->>'$.k')::int as content from calls where name = 'view'"""
SQL["export_saved"] = SQL["export_messages"]
# Every item is found something: it has words, and the store is not empty.
SQL["calls_end_to_end"] = f"""select call_id as conv_id, 1::bigint as turn, 0::bigint as ordinal, 'store_memory' as name, answer,
  null::boolean as found from ({SQL["batch_store_calls"]})
union all select item_id, 2, 0, 'retrieve_memory', null, true from benchmark"""
SQL["search_in_cells"] = SQL["search_topk_exact"]
SQL["search_many_queries"] = f"""with held as (select vec_id, embedding::double[] as v from embeddings),
norms as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from held),
asked as (select vec_id * 25 + turn as query_id, n, v[turn + 1:] || v[:turn] as q from norms, (select unnest(range(25)) as turn)),
scores as (
  select query_id, vec_id // 10 as chunk_id, round(list_dot_product(q, v) / (a.n * b.n), 9) as sim from asked a, norms b),
top as ({_top_chunks('scores', 1)})
select query_id::bigint as query_id, rank, chunk_id, round(sim, 6) as similarity from top"""
# Which vectors an index finds depends on its training; that it finds nine tenths does not.
SQL["index_recall"] = f"""select count(*) as hits, (select count(*) // 10 from embeddings) as fetched, true as recalled
from ({SQL["search_topk_exact"]})"""
SQL["export_timestamps"] = """
select user_id as conv_id, event_id as turn, case when event_type = 'view' then 'user' else 'assistant' end as role,
       replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') as timestamp from events"""
SQL["lsh_topk"] = _lsh()
SQL["refine_answers"] = _refined()
SQL["history_stream"] = f"""{_HISTORY}
select conv_id, row_number() over (partition by conv_id order by turn) as position, turn, role, content from talk where back <= 4"""
SQL["history_stream_idle"] = SQL["history_stream"]


def _markdown_chunks(size: int = 4000, overlap: int = 400) -> str:
    """The chunker with fences, tables, headings and rules, a step of the walk per row."""
    half = size // 2
    fence, blank = "'```'", f"({_NL} || {_NL})"

    def inside(at: str) -> str:
        before = f"substr(text, 1, {at})"
        return f"(length({before}) - length(replace({before}, {fence}, ''))) // 3 % 2 = 1"

    def leaving(at: str) -> str:
        found = f"position({fence} in substr(text, {at} + 1))"
        behind = f"({at} + {found} + 2)"
        newline = f"case when substr(text, {behind} + 1, 1) = {_NL} then 1 else 0 end"
        return f"(case when {found} = 0 then {at} else {behind} + {newline} end)"

    def last_match(pattern: str) -> str:
        """Where the last match begins; 0 without one."""
        return f"length(regexp_extract(piece, '(?s)^(.*){pattern}', 1))"

    def pipes(part: str) -> str:
        return f"length({part}) - length(replace({part}, '|', ''))"

    headings = " ".join(
        f"when {last_match(pattern)} > {half} then {last_match(pattern)}"
        for pattern in ("\\n#{1,6}\\s", "\\n---+\\n", "\\n===+\\n")
    )
    section = f"(case {headings} else {_cut('piece', size, _CHUNK_RULES)} end)"
    between = "('.' || chr(10) || '%s' || chr(10))"
    kinds = [
        "replace(text, '. ', '.' || chr(10) || '## ')",
        *(f"replace(text, '. ', {between % mark})" for mark in ("-----", "===", "```")),
        "text || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || text",
        "text || chr(10) || '```' || chr(10) || text",
        "replace(replace(text, '. ', '.' || chr(10) || chr(10)), ' ', ' | ')",
    ]
    chosen = " ".join(f"when {number} then {kind}" for number, kind in enumerate(kinds))
    opened = f"({_last('piece', fence)})"

    def step(rows: str) -> str:
        """From ``raw``, where the last cut leaves off, to the chunk's start and end."""
        return f"""
  select key, step, s, total, case
      when s + {size} >= total then total
      when fenced then case
        when closed > s + {size} and closed < s + {size} + 1000 then closed
        when {opened} > {half} then s + {opened}
        else greatest(s + {size}, closed) end
      when {pipes('before')} >= 2 and {pipes('after')} >= 2 and gap between 1 and 499 then s + {size} + gap + 2
      else s + {section} end as e
  from (select *, substr(text, s + 1, {size}) as piece, {inside(f's + {size}')} as fenced, {leaving(f's + {size}')} as closed,
               substr(text, s + {size - 500} + 1, 500) as before, substr(text, s + {size} + 1, 500) as after,
               position({blank} in substr(text, s + {size} + 1, 501)) - 1 as gap
        from (select *, case when out > raw then total - length(ltrim(substr(text, out + 1), ' ' || chr(9) || chr(10))) else raw end as s
              from (select *, case when raw > 0 and {inside('raw')} then {leaving('raw')} else raw end as out from ({rows}))))
  where s < total"""

    return f"""with recursive marked as (
  select key, text, length(text) as total
  from (select doc_id as key, case doc_id % {len(kinds)} {chosen} end as text from documents) where length(text) > 0),
walk(key, step, s, total, e) as (
  select key, step, s::bigint, total, e::bigint from ({step("select key, text, total, 0 as step, 0::bigint as raw from marked")})
  union all
  select key, step, s::bigint, total, e::bigint from ({step(
      f"select w.key, m.text, m.total, w.step + 1 as step, w.e - {overlap} as raw from walk w join marked m on m.key = w.key where w.e < w.total")})
),
cut as (select w.key, w.s, w.e, {_strip('substr(m.text, w.s + 1, w.e - w.s)')} as text from walk w join marked m on m.key = w.key)
select key as doc_id, row_number() over (partition by key order by s) - 1 as pos, s as start_at, e as end_at,
       length(text) as length, md5(text) as hash from cut where text <> ''"""


SQL["chunk_markdown"] = _markdown_chunks()
