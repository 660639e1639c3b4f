"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX, KINDS, LOGIN, NEEDS, OPAQUE, PART, SCOPE

OP8 = """
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents
), g as (
  select t, min(doc_id) as keep_id, count(*) as group_size from n group by t
)
select n.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
from n join g on n.t = g.t
"""

OP7 = """
with lines as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
  )
), often as (
  select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select l.doc_id, l.pos, l.line, o.key is not null and l.doc_id <> o.keeper as gone from lines l left join often o on l.key = o.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


OP6 = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g
  from words
), sizes as (select doc_id, cast(len(g) as bigint) as n from sets),
members as (select doc_id, unnest(g) as g from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from members a join members b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select s.a, s.b, s.c = x.n and s.c = y.n as same from shared s join sizes x on x.doc_id = s.a join sizes y on y.doc_id = s.b where 100 * s.c >= 90 * (x.n + y.n - s.c)
), reach as (
  select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b
), least as (select a, min(b) as b from reach group by a),
own as (select a, min(b) filter (where same) as b, count(*) filter (where same) as copies, count(*) as n from links group by a)
select d.doc_id, d.n as n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) as component_id, least(d.doc_id, coalesce(o.b, d.doc_id)) as class_id,
       cast(coalesce(o.copies, 0) + 1 as bigint) as class_size, cast(coalesce(o.n, 0) as bigint) as n_links
from sizes d left join least r on r.a = d.doc_id left join own o on o.a = d.doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op2() -> str:
    """Every span of every kind, then each weak one against all others of its document, without bins."""
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, LOGIN, OPAQUE, ENDPOINT), strict=True))
    matches = " union all ".join(
        f"select doc_id, {i} as k, {_quoted(kind)} as kind, {_quoted(PART[kind])} as part, regexp_extract_all(t, {_quoted(pattern)}) as found, regexp_split_to_array(t, {_quoted(pattern)}) as gaps from texts"
        for i, (kind, pattern) in enumerate(patterns.items())
    )
    helps = " or ".join(f"w.kind = {_quoted(kind)} and o.part in ({', '.join(map(_quoted, needs))})" for kind, needs in NEEDS.items())
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents), matches as ({matches}),
each as (
  select doc_id, k, kind, part, unnest(found) as m, unnest(gaps[:len(found)]) as gap, generate_subscripts(found, 1) as i from matches where len(found) > 0
), placed as (
  select *, cast(sum(length(gap) + length(m)) over (partition by doc_id, k order by i) as bigint) as stop from each
), spans as (
  select doc_id, k, kind, part, stop - length(m) as start, stop from placed
  where (kind <> 'assign' or length(regexp_extract(m, {_quoted("^" + ASSIGN)}, 2)) >= 6)
    and (kind <> 'opaque' or (regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')))
), base as (select * from spans where k < 3),
added as (
  select * from spans w where k >= 3
    and exists (select 1 from spans o where o.doc_id = w.doc_id and ({helps}) and w.start - o.stop <= {SCOPE} and o.start - w.stop <= {SCOPE} and not (w.start < o.stop and o.start < w.stop))
    and not exists (select 1 from base b where b.doc_id = w.doc_id and w.start < b.stop and b.start < w.stop)
), listed as (
  select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex, count(*) filter (where k >= 3) as n_linked,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, k, stop) filter (where k < 3) as base_spans, string_agg(kind || ':' || start || ':' || stop, ',' order by start, k, stop) as spans
  from (select * from base union all select * from added) group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base_spans, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked
from documents d left join listed l on l.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_linked_secrets": _op2(), "op6_grouped_jaccard": OP6, "op7_line_dedup": OP7, "op8_exact_dedup": OP8}
