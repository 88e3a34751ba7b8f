"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

REPEATS = r"""
with split as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select r, t.i, array_to_string(w[t.i : t.i + 34], ' ') as k from split, unnest(range(1, len(w) - 33)) t(i) where len(w) >= 35
), again as (
  select r, i from windows where k in (select k from windows group by k having count(*) > 1)
), gone as (
  select distinct r, t.j from again, unnest(range(i, i + 35)) t(j)
), kept as (
  select p.r, p.j, p.x from (select r, unnest(range(1, len(w) + 1)) as j, unnest(w) as x from split) p anti join gone g on p.r = g.r and p.j = g.j
), joined as (
  select r, count(*) as n, string_agg(x, ' ' order by j) as t from kept group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from split left join joined using (r)
"""

COMPONENTS = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, list_sort(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from split
), classes as (
  select doc_id, len(s) as n, min(doc_id) over (partition by s) as node, s from sets
), shingles as (
  select node, n, unnest(s) as k from classes where node = doc_id and n > 0
), links as (
  select a.node as a, b.node as b from shingles a join shingles b on a.k = b.k and a.node < b.node and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways as (
  select a, b from links union all select b, a from links
), reach(node, low) as (
  select distinct a, a from ways union select ways.b, reach.low from reach join ways on ways.a = reach.node where reach.low < ways.b
), parts as (
  select node, min(low) as component from reach group by node
)
select doc_id, cast(n as bigint) as n_shingles, case when n = 0 then doc_id else coalesce(component, node) end as component_id, case when n = 0 then doc_id else node end as class_id
from classes left join parts using (node)
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"

SEARCH = f"""
with split as (
  select row_number() over () as r, doc_id, {SPLIT} as t from documents
), total as (
  select count(*) filter (len(t) > 0) as nn, sum(len(t))::bigint as ll from split
), counts as (
  select r, term, count(*) as tf from (select r, unnest(t) as term from split) group by r, term
), asked as (
  select item_id, term, count(*) as times from (select item_id, unnest({SPLIT}) as term from (select distinct item_id, text from benchmark)) group by item_id, term
), weights as (
  select term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from counts semi join asked using (term) group by term), total
), scores as (
  select item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * nn) // ll))))::bigint as score
  from asked join counts using (term) join weights using (term) join split using (r), total group by item_id, r
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score from scores join split using (r) where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""


def _spans(kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"select r, '{kind}' as kind, regexp_split_to_array(text, '{quoted}') as g, regexp_extract_all(text, '{quoted}') as m from split"


def _secrets() -> str:
    from .secrets import BLANK, KINDS, LONG, NEAR, SECRET, SHORT, STRONG, WEAK

    value = STRONG["assign"].replace("'", "''")
    named = lambda kinds: ", ".join(f"'{k}'" for k in kinds)
    return rf"""
with split as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), matched as (
  {" union all ".join(_spans(k, p) for k, p in (STRONG | WEAK | {"break": BLANK}).items())}
), placed as (
  select r, kind, m[i] as x, (list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0))::bigint as start
  from (select *, unnest(range(1, len(m) + 1)) as i from matched where len(m) > 0)
), spans as (
  select r, case when kind = 'assign' and length(regexp_extract(x, '{value}', 1)) < {LONG} then 'short' else kind end as kind, start, start + length(x) as "end" from placed
  where case kind when 'assign' then length(regexp_extract(x, '{value}', 1)) >= {SHORT} when 'blob' then regexp_matches(x, '[0-9]') and regexp_matches(x, '[a-z]') and regexp_matches(x, '[A-Z]') else true end
), parts as (
  select s.*, kind in ({named(SECRET)}) as secret, (select count(*) from spans b where b.r = s.r and b.kind = 'break' and b.start < s.start) as scope from spans s where kind <> 'break'
), strong as (
  select * from parts where kind in ({named(STRONG)})
), free as (
  select * from parts p where kind not in ({named(STRONG)}) and not exists (from strong s where s.r = p.r and s.start < p."end" and s."end" > p.start)
), every as (
  select * from strong union all select * from free
), linked as (
  select * from free f where exists (from every o where o.r = f.r and o.scope = f.scope and o.secret <> f.secret and o.start - f."end" <= {NEAR} and f.start - o."end" <= {NEAR})
), written as (
  select *, kind || ':' || start || ':' || "end" as s, list_position([{named(KINDS)}], kind) as k from (select *, true as base from strong union all select *, false from linked)
), gathered as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(s, ',' order by start, k) filter (base) as base, string_agg(s, ',' order by start, k) as spans, count(*) filter (not base) as n_linked from written group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked
from split left join gathered using (r)
"""


ORACLE = {"op3_substring_dedup": REPEATS, "op9_jaccard_join": COMPONENTS, "op11_lexical_search": SEARCH, "op12_secret_scan": _secrets()}
