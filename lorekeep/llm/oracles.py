"""DuckDB SQL for the queries that SQL can express.

The other operators hash texts, learn from results of their own or read tokenizer files; their queries are
tested against plain Python on small tables.
"""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIXING = f"""
with docs as (
  select doc_id, source, (case when source is null then 'n' else 's' end) || coalesce(source, '') as name,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::bigint as size
  from documents
), totals as (
  select source, name, sum(size)::bigint as source_size from docs group by all
), weighted as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from totals
), lined as (
  select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as ratio from weighted
), levels as (
  select *, row_number() over line as place,
    (sum(source_size) over ())::double - coalesce(sum(cap) over (line rows between unbounded preceding and 1 preceding), 0.0) as rest,
    sum(weight) over () - coalesce(sum(weight) over (line rows between unbounded preceding and 1 preceding), 0.0) as open
  from lined window line as (order by ratio, source nulls last)
), first as (
  select min(place) as place from levels where rest / open <= ratio
), targets as (
  select l.source, l.name, l.source_size,
    coalesce(case when l.place < f.place then l.cap
      else l.weight * (select rest / open from levels where place = f.place) end, l.cap) as target
  from levels l, first f
), each as (
  select *, round(case when source_size > 0 then target / source_size else 0.0 end * 268435456.0)::bigint as unit,
    ('0x' || substr(md5('18:' || name), 1, 7))::bigint as start
  from targets
), placed as (
  select d.doc_id, d.source, d.size, e.source_size, e.target, e.unit, e.start,
    row_number() over (partition by d.name order by floor(log2(d.size + 1.0::double) * 4)::int,
      ('0x' || substr(md5('17:' || d.doc_id::varchar), 1, 7))::bigint % (select greatest(1, ceil(count(*) / 20000.0))::bigint from docs),
      d.size, d.doc_id nulls last) as pos
  from docs d join each e on d.name = e.name
)
select doc_id, size, source_size, target, source,
  ((pos * unit + start) >> 28) - ((pos * unit + start - unit) >> 28) as copies,
  (((pos * unit + start) >> 28) - ((pos * unit + start - unit) >> 28)) * size as taken
from placed
"""

_QUALITY = f"""
with docs as (
  select row_number() over () as row, doc_id, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '{WORDS}') as words
  from documents
), lines as (
  select row, line, count(*) as n from
    (select row, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '{WORDS}') group by all
), by_line as (
  select row, sum(n)::bigint as n_lines, sum(n - 1)::bigint as n_dup_lines from lines group by row
), windows as (
  select row, pos, words[pos:pos + 2] as win
  from (select row, words, unnest(generate_series(1, len(words) - 2)) as pos from docs)
), again as (
  select row, win from windows group by all having count(*) > 1
), by_window as (
  select row, count(distinct place)::bigint as n_repeat_words
  from (select w.row, unnest([w.pos, w.pos + 1, w.pos + 2]) as place from windows w join again a on w.row = a.row and w.win = a.win)
  group by row
), measured as (
  select d.row, doc_id, source, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from docs d left join by_line l on d.row = l.row left join by_window w on d.row = w.row
), flagged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 30 * n_lines or 100 * n_repeat_words > 20 * n_words as soft_failed
  from measured
), hosts as (
  select source, count(*) as n, count_if(base_failed or soft_failed) as failures from flagged group by source
), moments as (
  select avg(failures / n) as mean, var_pop(failures / n) as spread from hosts
), prior as (
  select mean, case when spread > 0 and spread < mean * (1 - mean) then mean * (1 - mean) / spread - 1 else 1.0 end as strength
  from moments
), rates as (
  select source, (failures + mean * strength) / (n + strength) as rate from hosts, prior
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (rate > 0.5 and soft_failed) as kept, round(rate, 9) as host_rate, rate > 0.5 as host_bad
from flagged f join rates r on f.source is not distinct from r.source
"""

_DECONTAMINATION = f"""
with docs as (
  select row_number() over () as row, doc_id, regexp_extract_all({_LOWERED}, '{LETTERS}') as words from documents
), items as (
  select coalesce(item_id::varchar, '') as item_id, regexp_extract_all({_LOWERED}, '{LETTERS}') as words from benchmark
), item_windows as (
  select distinct item_id, m, words[pos:pos + m - 1] as win from
    (select *, unnest(generate_series(1, len(words) - m + 1)) as pos from
      (select *, least(len(words), 10) as m from items where len(words) > 0))
), doc_windows as (
  select row, pos, m, words[pos:pos + m - 1] as win from
    (select *, unnest(generate_series(1, len(words) - m + 1)) as pos from docs, (select distinct m from item_windows))
), hits as (
  select d.row, d.pos, d.m, i.item_id from doc_windows d join item_windows i on d.m = i.m and d.win = i.win
), covered as (
  select row, count(distinct place) as n_hit from (select row, unnest(generate_series(pos, pos + m - 1)) as place from hits) group by row
), found as (
  select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as listed
  from (select distinct row, item_id from hits) group by row
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join covered c on d.row = c.row left join found f on d.row = f.row
"""

_TRIE = """
with bits as (
  select [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
    for i in range(256)] as t
), coded as (
  select conv_id, turn, length(coalesce(text, '')) as size,
    sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as code
  from conversations where conv_id is not null
), turns as (
  select *, row_number() over (partition by conv_id order by turn nulls first, code) as pos from coded
), convs as (
  select conv_id, n, conv_id - conv_id % 100 as base,
    xor(list_reduce([4294967295] || [ascii(c)::bigint for c in string_split(conv_id::varchar, '')],
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 as h
  from (select conv_id, count(*) as n from turns group by conv_id), bits
), built as (
  select c.conv_id, c.n as n_own, c.h, least(c.h, coalesce(b.n, 0)) as k from convs c left join convs b on c.base = b.conv_id
), rebuilt as (
  select c.conv_id, t.pos, t.code, t.size from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all
  select t.conv_id, t.pos - b.h + b.k, t.code, t.size from built b join turns t on t.conv_id = b.conv_id and t.pos > b.h
), listed as (
  select b.conv_id, list(code order by pos) filter (where code is not null) as codes, list(size order by pos) filter (where code is not null) as sizes,
    count(code) as n_turns
  from built b left join rebuilt r on b.conv_id = r.conv_id group by b.conv_id
), members as (
  select conv_id, n_turns, depth, sha256(array_to_string(codes[1:depth], ',') || '/' || depth) as node,
    case when depth > 0 then sha256(array_to_string(codes[1:depth - 1], ',') || '/' || (depth - 1)) end as above,
    case when depth > 0 then sizes[depth] else 0 end as size
  from (select *, unnest(range(n_turns + 1)) as depth from listed)
), named as (
  select * replace (case when depth = 0 then 'root' else node end as node, case when depth = 1 then 'root' else above end as above) from members
), nodes as (
  select node, any_value(above) as above, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = n_turns), '')) as ends
  from named group by node
), children as (
  select above, count(*) as n_children from nodes where above is not null group by above
), full_nodes as (
  select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c on n.node = c.above
), subtree as (
  select m.node, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * f.size) as saved
  from full_nodes f join named m on m.conv_id = f.conv_id and m.depth <= f.depth group by m.node
)
select f.conv_id, f.depth::bigint as depth, p.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, f.ends as ends_sha256
from full_nodes f join subtree s on f.node = s.node left join full_nodes p on f.above = p.node
"""

SQL: dict[str, str] = {"op2_mixing": _MIXING, "op5_quality": _QUALITY, "op7_decontaminate": _DECONTAMINATION, "op11_prefix_trie": _TRIE}
