"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

WORDS = "[w for w in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if w <> '']"

QUALITY = f"""
with w as materialized (select doc_id, source, coalesce(text, '') t, {WORDS} ws from documents),
grams as (
  select doc_id, i, list_slice(ws, i, i + 7) g
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
twice as (select doc_id, g from grams group by doc_id, g having count(*) > 1),
hit as (
  select doc_id, count(distinct i + k) n
  from grams join twice using (doc_id, g) cross join (select unnest(range(8)) k) group by doc_id),
dup as (
  select doc_id, sum(n - 1) n from (
    select doc_id, line, count(*) n from (select doc_id, unnest(string_split(t, chr(10))) line from w)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id, line) group by doc_id),
rules as (
  select w.doc_id, source, cast(len(ws) as bigint) n_words,
         cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
         cast(coalesce(dup.n, 0) as bigint) n_dup_lines, cast(coalesce(hit.n, 0) as bigint) n_repeat_words,
         len(ws) < 20 or 100 * coalesce(hit.n, 0) > 30 * len(ws) base_failed
  from w left join hit using (doc_id) left join dup using (doc_id)),
hosts as (
  select source, count(*) pages, count(*) filter (base_failed) failures from rules group by source),
prior as (select avg(failures / pages) m, var_pop(failures / pages) v from hosts),
bad as (
  select source from hosts, prior
  where case when v = 0 then m when v >= m * (1 - m) then failures / pages
             else (failures + m * (m * (1 - m) / v - 1)) / (pages + (m * (1 - m) / v - 1)) end > 0.5)
"""

QUALITY_RULES = f"""{QUALITY}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not exists (select 1 from bad where bad.source is not distinct from rules.source) kept
from rules
"""

LINE_DEDUP = """
with line as materialized (
  select doc_id, source, text, i, line, trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) k
  from (select doc_id, source, text, unnest(string_split(text, chr(10))) line,
               unnest(range(len(string_split(text, chr(10))))) i from documents)),
pages as (select source, count(*) pages from documents group by source),
boiler as (
  select source, k from line join pages using (source) where k <> '' group by source, k, pages
  having count(distinct doc_id) >= 5 and count(distinct doc_id) > 0.1 * pages)
select l.doc_id, count(*) n_lines, count(b.k) n_removed,
       coalesce(string_agg(line, chr(10) order by i) filter (b.k is null), '') text
from line l left join boiler b on b.source = l.source and b.k = l.k
group by l.doc_id
"""

ITEM_WORDS = (
    "[w for w in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if w <> '']"
)

CONTAMINATION = f"""
with dw as materialized (select doc_id, {ITEM_WORDS} ws from documents),
bw as (select item_id, {ITEM_WORDS} ws from benchmark),
items as materialized (
  select distinct item_id, least(len(ws), 13) n, list_slice(ws, i, i + 12) g
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) i from bw where len(ws) > 0)),
grams as (
  select doc_id, n, i, list_slice(ws, i, i + n - 1) g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i
        from dw, (select distinct n from items) where len(ws) >= n)),
places as materialized (select doc_id, i, n, item_id from grams join items using (n, g)),
per_doc as (
  select doc_id, cast(len(list_distinct(flatten(list(range(i, i + n))))) as bigint) n_hit,
         list_sort(list(distinct cast(item_id as varchar))) ids
  from places group by doc_id),
verdict as (
  select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(len(ids), 0) n_items,
         sha256(coalesce(array_to_string(ids, ','), '')) items_sha256,
         coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
  from dw left join per_doc using (doc_id))
"""

DECONTAMINATION = f"{CONTAMINATION}\nselect doc_id, n_words, n_hit, n_items, items_sha256, contaminated from verdict"


SOURCE_DIVERGENCE = """
with d as materialized (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
                        lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) ts
  from documents),
occurs as materialized (select r, lang, source, unnest(ts) term from d),
kept as materialized (select lang, term from occurs group by lang, term having count(distinct r) >= 30),
sizes as (select lang, count(*) v from kept group by lang),
grps as materialized (
  select lang, source, coalesce(v, 0) v from (select distinct lang, source from d) left join sizes using (lang)),
cells as (select lang, source, term, count(*) c from occurs join kept using (lang, term) group by lang, source, term),
full_cells as (
  select g.lang, g.source, k.term, g.v, coalesce(c.c, 0)::hugeint c
  from grps g join kept k using (lang) left join cells c using (lang, source, term)),
p as materialized (
  select lang, source, term, c,
         1 + (1000000000 * (c + 5)) // (sum(c) over (partition by lang, source)::hugeint + 5 * v) p
  from full_cells),
q as (
  select lang, term, 1 + (1000000000 * (c + 5)) // (sum(c) over (partition by lang)::hugeint + 5 * v) p
  from (select lang, term, any_value(v) v, sum(c)::hugeint c from full_cells group by lang, term)),
pairs as (
  select a.lang, a.source, 'pair' part, b.source item,
         coalesce((select sum(abs(x.p - y.p)) from p x join p y using (lang, term)
                   where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) f
  from grps a join grps b on a.lang = b.lang and a.source <> b.source),
terms as (
  select p.lang, p.source, 'term' part, p.term item, p.p - q.p f
  from p join q using (lang, term) where p.c > 0 and p.p > q.p)
select lang, source, part, item, f::bigint "value", n::int rank
from (select *, row_number() over (partition by lang, source, part order by f desc, encode(item)) n
      from (select * from pairs union all select * from terms))
where part = 'pair' or n <= 50
"""
