"""DuckDB SQL of the queries that SQL can express, by brute force over all pairs that share something."""

from __future__ import annotations

from papyrine.llm.host_reputation import LOWER, RULES, TWO_LABEL_SUFFIXES, UPPER

_WORDS = r"[^\x20\x09-\x0D]+"
_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"
_SETS = f"""w as (select {{key}} as id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') as w from {{table}}),
s as (select id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end as s from w)"""
#: Links l(a, b) to the smallest node reached, for the nodes of n(id).
_CLOSURE = """u as (select a, b from l union select b, a from l),
c as (select id, id as r from n union select b, r from c join u on a = id),
m as (select id, min(r) as component_id from c group by id)"""

_OP1 = f"""with recursive {_SETS.format(key="doc_id", table="documents")},
n as (select id, len(s) as n from s), e as (select id, unnest(s) as g from s),
p as (select x.id as a, y.id as b, count(*) as k from e x join e y on x.g = y.g and x.id < y.id group by 1, 2),
l as (select a, b from p join n x on x.id = a join n y on y.id = b where 100 * k >= 75 * (x.n + y.n - k)),
{_CLOSURE}
select n.id as doc_id, n.n as n_shingles, component_id, component_id = n.id as kept from n join m on m.id = n.id"""

_OP2 = f"""with recursive n as (select vec_id as id, label, embedding::double[] as v from embeddings),
ok as (select * from n where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select x.id as a, y.id as b from ok x join ok y on x.label = y.label and x.id < y.id where list_cosine_similarity(x.v, y.v) >= 0.98),
{_CLOSURE}, k as (select a, count(*) as k from u group by a)
select n.id as vec_id, coalesce(k, 0) as n_links, component_id, component_id = n.id as kept from n join m on m.id = n.id left join k on k.a = n.id"""


def _strength(level: str, mean: str) -> str:
    return f"""select least(greatest(coalesce(case when units > 1 and lv > uv and sp > uv then (1 - (sp - uv) / (lv - uv)) / ((sp - uv) / (lv - uv)) end, 200.0), 1.0), 200.0) as strength from
(select sum(n * (bad / n::double - {mean}) * (bad / n::double - {mean})) as sp, sum({mean} * (1 - {mean})) as uv, sum(n * {mean} * (1 - {mean})) as lv, count(*) as units from {level} where n > 0)"""


def _rule(column: str) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    whens = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p if column == 'rule' else v}'" for v, h, p in ordered)
    return f"case {whens} end"


_REST = "substr(url, instr(url, '://') + 3)"
_OP3 = f"""with p as (select page_id, coalesce(case when instr(url, '://') > 0 then {_LOW.format(f"regexp_extract({_REST}, '^([^/?#]*)', 1)")} end, '') as host,
coalesce(case when instr(url, '://') > 0 then regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) end, '') as path from pages),
d as (select page_id, host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[^0-9]|$)', 1), '') as bigint) as doc_id from p),
o as (select host, count(*) as n, sum(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from d join labels using (doc_id) where toxic is not null or quality is not null group by host),
h0 as (select p.host, coalesce(any_value(n), 0) as n, coalesce(any_value(bad), 0) as bad, regexp_replace(regexp_replace(p.host, ':[0-9]*$', ''), '\\.$', '') as name from p left join o on o.host = p.host group by p.host),
h1 as (select *, regexp_extract(name, '([^.]*\\.)?[^.]*$', 0) as two from h0),
h2 as (select *, case when two in ({", ".join(repr(s) for s in TWO_LABEL_SUFFIXES)}) then two else regexp_extract(name, '[^.]*$', 0) end as suffix from h1),
h as (select host, n, bad, suffix, case when contains(suffix, '.') then regexp_extract(name, '([^.]*\\.)?[^.]*\\.[^.]*$', 0) else two end as domain from h2),
a as (select coalesce((sum(bad) + 1) / (sum(n) + 2)::double, 0.5) as overall, coalesce(sum(n), 0)::double as labels from h),
s0 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(overall) as overall from h, a group by suffix), s1 as ({_strength("s0", "overall")}),
s as (select suffix, (bad + strength * overall) / (n + strength) as suffix_rate from s0, s1),
d0 as (select domain, suffix, sum(n) as n, sum(bad) as bad, any_value(suffix_rate) as suffix_rate from h join s using (suffix) group by domain, suffix), d1 as ({_strength("d0", "suffix_rate")}),
dd as (select domain, suffix, (bad + strength * suffix_rate) / (n + strength) as domain_rate from d0, d1),
x0 as (select h.*, domain_rate from h join dd using (domain, suffix)), x1 as ({_strength("x0", "domain_rate")}),
x as (select host, n, least(strength, labels) as worth, (bad + strength * domain_rate) / (n + strength) as rate from x0, x1, a),
y as (select host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + worth + 1)) as lo from x)
select page_id, host, path, {_rule("rule")} as rule, coalesce({_rule("verdict")}, case when lo > 0.25 then 'block' else 'allow' end) as verdict, round(rate, 9) as host_rate, round(lo, 9) as host_lower from p join y using (host)"""

_OP4 = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, payload_bytes >= 100 and page_id is distinct from min(page_id) over (partition by payload_digest) and min(page_id) over (partition by payload_digest) is not null as again, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to from f"""

_OP5 = f"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) as size from documents),
b as (select *, ('0x' || substr(md5('5|' || coalesce(doc_id::varchar, '-') || '|' || size), 1, 13))::bigint as draw from d),
s as (select source, sum(size)::bigint as source_size from b group by source),
r as (select *, [1.0::double, 2.0, 3.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, source_size * 3 as cap from s),
q as (select *, coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0) as held, sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as open from r),
v as (select arg_min(lvl, ratio) as level from (select ((select sum(source_size) from r) - held) / open as lvl, cap / weight as ratio from q) where lvl < ratio),
t as (select source, source_size, case when level is null then cap else least(cap, level * weight) end::double as target from r, v),
x as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
y as (select b.*, source_size, target, whole, target - whole * source_size as wanted, sum(size) over (partition by b.source order by draw rows unbounded preceding) - size / 2 as middle from b join x on b.source is not distinct from x.source)
select doc_id, size, source_size, target, ((whole + case when middle < wanted then 1 else 0 end) * size)::bigint as taken from y"""

_TRIM = r"[\x20\x09-\x0D]+"
_OP6 = f"""with recursive x as (select doc_id, string_split(text, chr(10)) as l from documents),
o as (select doc_id, i - 1 as line_no, lower(regexp_replace(l[i], '^{_TRIM}|{_TRIM}$', '', 'g')) as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from x)),
k as (select line, row_number() over () as id from (select distinct line from o where line <> '')),
s as (select id, list_distinct([substr(line, i, 8) for i in range(1, greatest(length(line) - 7, 1) + 1)]) as s from k),
n as (select id, len(s) as n from s), e as (select id, unnest(s) as g from s),
p as (select x.id as a, y.id as b, count(*) as k from e x join e y on x.g = y.g and x.id < y.id group by 1, 2),
l as (select a, b from p join n x on x.id = a join n y on y.id = b where 100 * k >= 75 * (x.n + y.n - k)),
{_CLOSURE}, z as (select doc_id, line_no, component_id from o join k using (line) join m on m.id = k.id),
f as (select *, first_value(doc_id) over win as keeper_doc, first_value(line_no) over win as keeper_line from z window win as (partition by component_id order by doc_id, line_no))
select doc_id, line_no::int as line_no, keeper_doc, keeper_line::int as keeper_line, doc_id = keeper_doc and line_no = keeper_line as kept from f"""

_OP9 = f"""with {_SETS.format(key="doc_id", table="documents")}, e as (select id, unnest(s) as g from s),
{_SETS.format(key="item_id", table="benchmark").replace("w as (", "bw as (").replace("s as (select id, case", "bs as (select id, case").replace("from w)", "from bw)")},
b as (select id, len(s) as n, unnest(s) as g from bs)
select e.id as doc_id, b.id as item_id, count(*) as n_shared, any_value(b.n) as n_item from e join b on e.g = b.g group by 1, 2 having count(*) * 100 >= any_value(b.n) * 75"""

_OP12 = f"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
w as (select *, regexp_extract_all(t, '{_WORDS}') as w from d),
k as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
[len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as fails from w left join k using (doc_id)),
x as (select part, list_reduce(list_prepend(0, [fails[i]::int * (1 << (i - 1)) for i in range(1, 6)]), lambda a, b: a + b) as mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
f as (select unnest(range(0, 5)) as i),
o as (select chr((65 + a.i)::int) || chr((65 + b.i)::int) || chr((65 + c.i)::int) || chr((65 + d.i)::int) || chr((65 + e.i)::int) as filter_order, [a.i, b.i, c.i, d.i, e.i] as bits
from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select filter_order, step, 1 << bits[step] as own, coalesce(list_sum([1 << b for b in bits[1:step - 1]]), 0)::bigint as before from o, (select unnest(range(1, 6)) as step)),
r as (select part, filter_order, step, any_value(own) as own, sum(case when mask & (before | own) = 0 then n else 0 end) as kept, sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end) as removed,
sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end) as redundant, sum(case when mask = own then n else 0 end) as unique_fails,
sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end) as good_lost, sum(case when mask & own <> 0 and mask & before = 0 then toxic else 0 end) as toxic_lost from x, s group by part, filter_order, step)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
(sum(removed) over (partition by part, own))::bigint as shapley from r"""


def _op13(rounds: int = 10) -> str:
    """Every round written out: distances of all vectors to all centroids, then whole means rounded down."""
    parts = [
        """v as materialized (select row_number() over () as r, vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "e as materialized (select r, unnest(range(1, 65)) as p, unnest(v) as x from v)",
        "c0 as materialized (select c, unnest(range(1, 65)) as p, unnest(v) as x from (select row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as c, v from v) where c < 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from (select r, c, sum((e.x - k.x) * (e.x - k.x))::bigint as d from e join c{i} k using (p) group by r, c) group by r)")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (select c, p, coalesce(m, k.x) as x from c{i} k left join
(select c, p, (s - ((s % n) + n) % n) // n as m from (select c, p, sum(x)::bigint as s, count(*) as n from e join a{i} using (r) group by c, p)) using (c, p))""")
    return f"""with {", ".join(parts)}, h as (select c, sha256(string_agg(x::varchar, ',' order by p)) as h from c{rounds} group by c)
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256 from a{rounds} join v using (r) join h using (c)"""


SQL: dict[str, str] = {
    "op1_odd_sketch": _OP1,
    "op2_multi_index": _OP2,
    "op3_host_reputation": _OP3,
    "op4_warc_transactions": _OP4,
    "op5_water_filling": _OP5,
    "op6_fuzzy_lines": _OP6,
    "op9_containment_search": _OP9,
    "op12_filter_audit": _OP12,
    "op13_hamerly": _op13(),
}
