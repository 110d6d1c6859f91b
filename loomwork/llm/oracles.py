"""DuckDB SQL of the operators that SQL can express, each straight from its definition."""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select distinct item, least(len(w), 10) as size, md5(array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ')) as key
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0)),
s as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p from d, (select distinct size from i) where len(w) >= size),
k as (select doc_id, size, p, md5(array_to_string(list_slice(w, p, p + size - 1), ' ')) as key from s),
h as (select doc_id, p, k.size, item from k join i on i.key = k.key and i.size = k.size),
n as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(p, p + size)) as place from h) group by 1),
t as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list_distinct(list(item))), ',') as items from h group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""

OP3 = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, x, unnest(range(1, length(x) // 2 - 98)) as p from h where length(x) >= 200),
k as (select doc_id, p, md5(substr(x, 2 * p - 1, 200)) as key from w),
r as (select doc_id, p from (select *, row_number() over (partition by key order by doc_id, p) as nth from k) where nth > 1),
g as (select *, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as new from r),
j as (select *, sum(new) over (partition by doc_id order by p) as run from g),
s as (select doc_id, run, min(p) as s, max(p) + 100 as e from j group by 1, 2),
q as (select doc_id, s, coalesce(lag(e) over (partition by doc_id order by s), 1) as before from s),
c as (select h.doc_id, string_agg(substr(x, 2 * before - 1, 2 * (s - before)), '' order by s) as head from q join h using (doc_id) group by 1),
a as (select doc_id, max(e) as last, sum(e - s) as removed, count(*) as spans from s group by 1)
select h.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 1) - 1))) as kept_sha256
from h left join a using (doc_id) left join c using (doc_id)
"""

OP5 = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first, payload_bytes >= 100 as shared from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when shared and page_id <> first then 'revisit' else 'response' end as record_type,
  case when shared and page_id <> first then first end as refers_to
from f
"""

OP9 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(w, p, p + 3), ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 85 * (a.n + b.n - shared)),
r as (select doc_id, doc_id as c from d union select e.y, r.c from r join e on e.x = r.doc_id),
m as (select doc_id, min(c) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from d left join n using (doc_id) join m using (doc_id)
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(k) + 1), lambda i: ascii(k[i])::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"


def _step(state: str, cost: str, letter: str) -> str:
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}'}} end"


def _into(role: str, *states: str) -> str:
    own = f"case when f in ('blank', 'duplicate') then null when i = '{role}' then {{0}} else {{1}} end"
    return ", ".join(own.format(_step(s, "cut", "K"), "null" if role == "s" else _step(s, "1 + cut", "R")) for s in states)


def _insert(*states: str) -> str:
    return ", ".join(_step(s, "5", "I") for s in states)


#: Damage, faults, then the cheapest edits for each state (nothing yet, after s, u, a), row by row, as (cost, edits) pairs; states start with inserted turns.
OP11 = rf"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
z as (select *, ({_CRC}) % 20 as z from k),
d as (select conv_id, turn, case when z = 4 then 'user' else role end as role, case z when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from z, unnest(case z when 0 then [] when 3 then [0, 0] else [0] end)),
r as (select *, left(role, 1) as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t, row_number() over w as n,
  left(lag(role) over w, 1) || left(role, 1) as pair from d window w as (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || ':' || text))),
f as (select *, case when t = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when right(t, 1) not in ('.', '!', '?') then 'truncated' else '' end as f from r),
g as (select *, case f when 'truncated' then 5 else 0 end as cut from f),
v as (select conv_id, 0::bigint as n, {{'c': 0::bigint, 'e': ''}} as a, null::struct(c bigint, e varchar) as b, {{'c': 5::bigint, 'e': 'I'}} as u, {{'c': 10::bigint, 'e': 'II'}} as w from (select distinct conv_id from g)
  union all
  select conv_id, n, a, b, least(u3, {_insert("w3")}) as u, w3 as w from (
    select conv_id, n, a, b, u3, least(w1, {_insert("u3")}) as w3 from (
      select conv_id, n, a, b, w1, least(u1, {_insert("a", "b", "w1")}) as u3 from (
        select g.conv_id, g.n, {_step("v.a", "2", "D")} as a, least({_step("v.b", "2", "D")}, {_into("s", "v.a")}) as b,
          least({_step("v.u", "2", "D")}, {_into("u", "v.a", "v.b", "v.w")}) as u1, least({_step("v.w", "2", "D")}, {_into("a", "v.u")}) as w1
        from v join g on g.conv_id is not distinct from v.conv_id and g.n = v.n + 1)))),
e as (select conv_id, least(a, w) as best from v qualify n = max(n) over (partition by conv_id)),
l as (select conv_id, p, best.e[p] as letter, length(replace(left(best.e, p), 'I', '')) as n, length(replace(left(best.e, p), 'D', '')) as place from e, unnest(range(1, length(best.e) + 1)) as q(p)),
o as (select l.conv_id, place, letter, role, case letter when 'I' then '' else text end as text, max((place = 1 and letter = 'K' and i = 's')::int) over (partition by l.conv_id) as s from l left join g on g.conv_id is not distinct from l.conv_id and g.n = l.n where letter <> 'D'),
h as (select conv_id, string_agg(case when letter = 'K' then role when (place - s) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by place) as whole from o group by 1),
m as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((f = 'blank')::int) as blank, sum((f = 'duplicate')::int) as duplicate, sum((f = 'truncated')::int) as truncated,
  sum((pair is not null and pair not in ('su', 'ua', 'au'))::int) as illegal from g group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.e, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join m on m.conv_id is not distinct from c.conv_id left join e on e.conv_id is not distinct from c.conv_id left join h on h.conv_id is not distinct from c.conv_id
"""
