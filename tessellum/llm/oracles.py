"""SQL for the queries of conversations and secrets (DuckDB)."""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [cast(ascii(ch) as bigint), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295)"


TRIE = f"""
with t as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
  from conversations where conv_id is not null),
n as (select c, count(*) as n, {crc32("cast(c as varchar)")} % 9 as h, c - c % 5 as leader from t group by c),
m as (select n.c, n.n, n.h, n.leader, least(n.h, coalesce(l.n, 0)) as taken from n left join n l on l.c = n.leader),
r as (
  select m.c, t.p as d, t.r, t.x from m join t on t.c = m.leader and t.p <= m.taken
  union all select m.c, t.p - m.h + m.taken, t.r, t.x from m join t on t.c = m.c and t.p > m.h),
k as (select c, d, strlen(x) as b, string_agg(md5(length(r) || ':' || r || x), '') over (partition by c order by d) as k from r union all select c, 0, 0, '' from m),
ends as (select k, string_agg(cast(c as varchar), ',' order by c) as ids from (select c, max_by(k, d) as k from k group by c) group by k),
v as (select k, d, min(c) as c, count(*) as n, any_value(b) as b from k group by k, d),
kids as (select left(k, 32 * (d - 1)) as k, count(*) as n from v where d > 0 group by 1),
f as (select v.*, coalesce(kids.n, 0) as n_children from v left join kids using (k)),
sums as (select left(k, 32 * a) as k, count(*) filter (n_children = 0) as n_leaves, sum((n - 1) * b) as saved from (select *, unnest(range(0, d + 1)) as a from f) group by 1)
select f.c as conv_id, cast(f.d as bigint) as depth, p.c as parent_conv_id, f.n as n_convs, f.n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from f join sums using (k) left join ends using (k) left join v p on f.d > 0 and p.k = left(f.k, 32 * (f.d - 1))
"""


def then(of: str, cost: str, letter: str) -> str:
    """A state `cost in six digits, audit` after one more edit."""
    return f"lpad(cast(cast(left({of}, 6) as int) + {cost} as varchar), 6, '0') || substr({of}, 7) || {letter}"


def stays(before: str, initial: str) -> str:
    return f"case when not dead then {then(before, f'''cut + case when ini = '{initial}' then 0 else 2 end''', f'''case when ini = '{initial}' then 'K' else 'R' end''')} else '950000' end"


REPAIR = f"""
with recursive o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k from conversations),
x as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(0, case when k = 3 then 2 else 1 end)) as copy
  from o where k <> 0),
y as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as ini, regexp_extract(text, '(?s)^.*([^\\x20\\x09-\\x0D])', 1) as final,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text) as prev
  from x),
f as (select *, case when final = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when final not in ('.', '!', '?') then 'truncated' else '' end as fault from y),
g as (select *, fault in ('blank', 'duplicate') as dead, case when fault = 'truncated' then 1 else 0 end as cut from f),
dp as (
  select distinct conv_id, 0 as i, '000000' as s, '900000' as sy, '000002I' as u, '000004II' as a from x
  union all
  select conv_id, i, s, sy, least(u, {then("s", "2", "'I'")}, {then("sy", "2", "'I'")}, {then("a", "2", "'I'")}), least(a, {then("u", "2", "'I'")}, {then("s", "4", "'II'")}, {then("sy", "4", "'II'")})
  from (
    select g.conv_id, g.i, {then("s", "3", "'D'")} as s, least({then("sy", "3", "'D'")}, case when not dead and ini = 's' then {then("s", "cut", "'K'")} else '950000' end) as sy,
      least({then("u", "3", "'D'")}, {stays("least(s, sy, a)", "u")}) as u, least({then("a", "3", "'D'")}, {stays("u", "a")}) as a
    from dp join g on dp.conv_id is not distinct from g.conv_id and g.i = dp.i + 1)),
best as (select conv_id, cast(left(least(s, a), 6) as bigint) as cost, substr(least(s, a), 7) as audit from dp qualify row_number() over (partition by conv_id order by i desc) = 1),
e as (select conv_id, audit, unnest(range(1, length(audit) + 1)) as p, length(replace(audit, 'D', '')) % 2 as odd from best),
w as (
  select e.conv_id, p, substr(audit, p, 1) as letter, case when (length(replace(left(audit, p - 1), 'D', '')) - odd) % 2 = 0 then 'user' else 'assistant' end as name, length(replace(left(audit, p - 1), 'I', '')) + 1 as i from e),
lines as (
  select w.conv_id, string_agg(case letter when 'I' then name || ':' when 'K' then g.role || ':' || g.text else name || ':' || g.text end, chr(10) order by p) as body
  from w left join g on w.conv_id is not distinct from g.conv_id and w.i = g.i where letter <> 'D' group by w.conv_id),
st as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (prev || ini not in ('su', 'ua', 'au')) as illegal
  from g group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
  coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join st on c.conv_id is not distinct from st.conv_id left join best b on c.conv_id is not distinct from b.conv_id left join lines l on c.conv_id is not distinct from l.conv_id
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RULES = [("assign", 0, _ASSIGN), ("access", 1, "AKIA[A-Z0-9]+"), ("hex", 2, "[0-9a-f]+"), ("owned", 3, "[A-Za-z0-9+/_=-]+")]


def _matches(kind: str, k: int, pattern: str) -> str:
    """Matches with their places: what stands between matches, and the matches before."""
    value = f"regexp_extract(m, '{pattern}', 2)" if kind == "assign" else "m"
    return f"""select row, owner, '{kind}' as kind, {k} as k, b as a, b + length(m) as z, {value} as v from (
      select row, owner, ms[i] as m, list_sum(list_transform(gaps[:i], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda s: length(s))), 0) as b
      from (select *, unnest(range(1, len(ms) + 1)) as i from (select row, owner, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as gaps from d)))"""


# runs too short to count are matched with a length in the pattern: the long ones are the same
_SHORTENED = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "owned": "[A-Za-z0-9+/_=-]{20,}"}

SECRETS = f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner from documents),
found as ({" union all ".join(_matches(kind, k, _SHORTENED.get(kind, pattern)) for kind, k, pattern in _RULES)}),
base as (select * from found where k in (1, 2) or k = 0 and length(v) >= 8),
runs as (
  select * from found r where k = 3 and len(list_distinct(string_split(v, ''))) >= 10 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
    and not exists (select 1 from base b where b.row = r.row and b.a < r.z and b.z > r.a)),
both_kinds as (select * from base union all select * from runs),
held as (select v, count(distinct owner) >= 3 as example from both_kinds group by v),
told as (select b.*, example, kind || ':' || cast(a as varchar) || ':' || cast(z as varchar) as name from both_kinds b join held using (v) where k < 3 or not example),
rows as (
  select row, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, string_agg(name, ',' order by a, k) filter (k < 3) as base,
    string_agg(name, ',' order by a, k) as spans, count(*) filter (k = 3) as n_owned, count(*) filter (not example) as n_live, count(*) filter (example) as n_example
  from told group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_owned, 0) as n_owned, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from d left join rows using (row)
"""
