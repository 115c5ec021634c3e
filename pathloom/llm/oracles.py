"""SQL with the same rows as the queries that SQL can express, for one machine and small tables."""

from __future__ import annotations

import re

from .secret_scan import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as materialized (select doc_id, list_distinct(case when len(ws) < 2 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as s from w),
-- documents with one set are one class
c as materialized (select min(doc_id) as node, list_sort(s) as s from s where len(s) > 0 group by list_sort(s)),
e as materialized (select node, len(s) as n, unnest(s) as x from c),
p as (select a.node as a, b.node as b, any_value(a.n) as m, any_value(b.n) as n, count(*) as shared from e a join e b on a.x = b.x and a.node < b.node and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by a.node, b.node),
l as materialized (select a, b from p where 100 * shared >= 80 * (m + n - shared) union all select b, a from p where 100 * shared >= 80 * (m + n - shared)),
r(a, b) as (select node, node from c union select r.a, l.b from r join l on r.b = l.a),
k as (select a as node, min(b) as component_id from r group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(k.component_id, s.doc_id) as component_id, coalesce(k.component_id, s.doc_id) = s.doc_id as kept
from s left join c on c.s = list_sort(s.s) left join k using (node)
"""

OP4_SQL = """
with b as materialized (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, pos, b[pos + 1:pos + 100] as x from (select doc_id, b, unnest(range(0, octet_length(b) - 99)) as pos from b)),
g as (select doc_id, pos from w qualify row_number() over (partition by x order by doc_id, pos) > 1),
i as (select *, case when pos > max(pos + 100) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from g),
r as (select doc_id, min(pos) as low, max(pos) + 100 as high from (select *, sum(fresh) over (partition by doc_id order by pos) as k from i) group by doc_id, k),
f as (select doc_id, list(low order by low) as lows, list(high order by low) as highs, sum(high - low) as gone from r group by doc_id)
select b.doc_id, octet_length(b)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(len(lows), 0)::bigint as n_spans,
  sha256(case when lows is null then b else unhex(array_to_string(list_transform(range(0, len(lows) + 1), lambda k: hex(b[case when k = 0 then 1 else highs[k] + 1 end : case when k = len(lows) then octet_length(b) else lows[k + 1] end])), '')) end) as kept_sha256
from b left join f using (doc_id)
"""


def plain_case(pattern: str) -> str:
    """Letters in either case, ASCII alone, spelled out; and no bound on a key's body, which this engine's patterns can't state."""
    pattern = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[1]) + ")", pattern)
    return pattern.replace("{0,40000}?", "*?").replace("{0,400}", "*").replace("'", "''")


def op5_sql() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        p = plain_case(rule.pattern)
        parts.append(
            f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, {rule.base} as base, unnest(range(1, len(hits) + 1)) as i, hits, groups, gaps, {rule.least} as least
              from (select doc_id, regexp_extract_all(text, '{p}', 0) as hits, regexp_extract_all(text, '{p}', {rule.group}) as groups, string_split_regex(text, '{p}') as gaps from d where regexp_matches(text, '{p}'))"""
        )
    span = "kind || ':' || a || ':' || z"
    counts = ", ".join(f"(count(*) filter (kind = '{k}'))::bigint as n_{k}" for k in ("assign", "access", "hex"))
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as ({' union all '.join(parts)}),
s as (select doc_id, rank, kind, base, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) as a, length(hits[i]) as n, length(groups[i]) >= least as counts from m),
t as (select *, (a + n)::bigint as z from (select doc_id, rank, kind, base, a::bigint as a, n from s where counts)),
u as (select doc_id, {counts}, string_agg({span}, ',' order by a, rank, z) filter (base) as own, string_agg({span}, ',' order by a, rank, z) as spans from t group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans from d left join u using (doc_id)
"""


OP7_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents
)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""

OP8_SQL = """
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
k as (
  select doc_id, ls, list_transform(ls, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ks
  from l
),
f as (select k from (select distinct doc_id, unnest(ks) as k from k) where k <> '' group by k having count(*) >= 10),
a as (select coalesce(list(k), []) as drop_keys from f),
r as (select doc_id, ls, list_filter(ls, lambda x, i: not list_contains(drop_keys, ks[i])) as kept from k, a)
select doc_id, len(ls)::bigint as n_lines, (len(ls) - len(kept))::bigint as n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) as kept_sha256 from r
"""
