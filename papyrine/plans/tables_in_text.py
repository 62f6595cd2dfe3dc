"""Queries: tables that stand in texts, bound to the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions.text import LINE_END, SPACE, SPACES
from papyrine.operators import table_text as T
from papyrine.plans.registry import register
from papyrine.sources.tables import read, spread

#: Cells of the driver's prose are also parted by a comma and a blank, and its bars stand inside lines.
GAP = f"(?:{T.GAP}|, )"

_SPACES = "||".join(f"chr({ord(c)})" for c in SPACES)
_STRIP = f"trim({{}}, {_SPACES})"


def _mode(counts: str) -> str:
    """Struct (n, value) of the commonest number of a list, of equals the one that comes first."""
    return f"list_first(list_sort([{{'n': -len(list_filter({counts}, lambda y: y = v)), 'place': list_position({counts}, v), 'value': v}} for v in list_distinct({counts})]))"


_ALPHA = "len(list_filter({}, lambda c: regexp_matches(c, '[A-Za-z]')))"
_TX16 = f"""with a as (select doc_id, {_STRIP.format("coalesce(text, '')")} as body from documents),
l as (select doc_id, length(body) as chars, list_filter([{_STRIP.format("x")} for x in string_split_regex(body, '{LINE_END}')], lambda x: x <> '') as ls from a),
g as (select *, list_filter([list_filter([{_STRIP.format("c")} for c in string_split_regex(x, '{GAP}')], lambda c: c <> '') for x in ls], lambda cs: len(cs) >= 2) as gs,
list_filter(ls, lambda x: contains(x, '|')) as bs, list_filter(ls, lambda x: contains(x, chr(9))) as ts from l),
k as (select *, [len(x) for x in gs] as ns from g), m as (select *, {_mode("ns")} as mode from k),
p as (select *, case when chars < 20 or len(ls) < 2 then 'unavailable' when len(bs) >= 2 then 'simple'
when len(ns) >= 2 and -mode.n >= 0.6 * len(ns) then case when mode.value <= 30 and len(ls) <= 100 then 'simple' else 'complex' end when len(ts) >= 2 then 'simple' else 'complex' end as gate from m),
r as (select *, list_filter([case when x[1] = '|' then list_filter([{_STRIP.format("c")} for c in string_split(x, '|')], lambda c, i: i > 1 and i < len(string_split(x, '|'))) else [{_STRIP.format("c")} for c in string_split(x, '|')] end for x in bs],
lambda cs: len(list_filter(cs, lambda c: not regexp_full_match(c, '[-:]*'))) > 0) as md, [[{_STRIP.format("c")} for c in string_split(x, chr(9))] for x in ts] as tb, list_filter(gs, lambda cs: len(cs) = mode.value) as al,
flatten(list_filter(gs, lambda cs: len(cs) >= 3)) as fl from p),
h as (select *, [{_ALPHA.format("cs")} for cs in al] as letters from r),
i as (select *, case when list_max(letters) >= 0.3 * mode.value then list_position(letters, list_max(letters)) else 1 end as pos from h),
w as (select *, list_filter([{{'s': -({_ALPHA.format("fl[1:n]")} / n::double + least((len(fl) // n - 1) * 0.1, 0.5)), 'n': n, 'ok': (len(fl) % n = 0 or len(fl) % n >= n - 2) and {_ALPHA.format("fl[1:n]")} / n::double >= 0.3 and len(fl) // n >= 2}} for n in range(3, least(12, len(fl) // 2) + 1)], lambda x: x.ok) as widths from i),
f as (select *, case when len(fl) >= 6 and len(widths) > 0 then list_first(list_sort(widths)).n end as n from w),
z as (select *, case when gate <> 'simple' then null when len(md) >= 2 and len(md[1]) >= 2 then 'markdown_like' when len(tb) >= 2 and len(tb[1]) >= 2 then 'tab_delimited' when len(al) >= 2 then 'whitespace_aligned' when n is not null then 'whitespace_flat' end as method from f),
t as (select *, case method when 'markdown_like' then md[1] when 'tab_delimited' then tb[1] when 'whitespace_aligned' then al[pos] when 'whitespace_flat' then fl[1:n] end as header,
case method when 'markdown_like' then md[2:] when 'tab_delimited' then tb[2:] when 'whitespace_aligned' then list_filter(al, lambda x, j: j <> pos) when 'whitespace_flat' then [fl[j * n + 1:(j + 1) * n] for j in range(1, least(len(fl) // n, 101))] end as cells from z),
q as (select *, [len(list_distinct(list_concat(header[1:least(len(c), len(header))], ['col_' || j for j in range(len(header), len(c))]))) for c in cells] as names from t),
s as (select *, case when {_ALPHA.format("header")} >= 0.5 * len(header) then 2 else 0 end + case when -{_mode("names")}.n = len(cells) then 2 when -{_mode("names")}.n >= 0.8 * len(cells) then 1 else 0 end + case when len(cells) >= 10 then 1 else 0 end + case when method in ('markdown_like', 'tab_delimited') then 1 else 0 end as score from q)
select doc_id, case when gate = 'unavailable' then 'structure_pending' when method is null then 'complex_structure_skipped' else 'simple_structure_extracted' end as status,
coalesce(method, case when gate = 'unavailable' then 'unavailable' else 'skipped_complex' end) as method, case when method is null then 'none' when score >= 4 then 'high' when score >= 2 then 'medium' else 'low' end as confidence,
array_to_string(header, chr(31)) as header, array_to_string([array_to_string(c, chr(31)) for c in cells], chr(30)) as cells, greatest(len(header), list_max([len(c) for c in cells])) as width,
len(list_filter(cells, lambda c: len(list_filter(c, lambda x: x <> '')) = 0)) as empty_rows from s"""


@register("tx16_table_text", _TX16)
def tx16(spark, sf):
    """Table structure of every whole document; header and cells are joined by unit and record separators for comparison."""
    found = T.table_structure(spread(read(spark, sf, "documents").select("doc_id", "text")), "text", gap=GAP, bare_pipes=True)
    cells = F.array_join(F.transform("cells", lambda c: F.array_join(c, "\x1f")), "\x1e")
    return found.select("doc_id", "status", "method", "confidence", F.array_join("header", "\x1f").alias("header"), cells.alias("cells"), F.col("width").cast("bigint").alias("width"), F.col("empty_rows").cast("bigint").alias("empty_rows"))


_COUNT = "(length(text) - length(replace(text, {c}, '')))"
#: No field of the driver's documents begins with a quote, so the SQL splits at each delimiter.
_SRC8 = f"""with a as (select doc_id, coalesce(text, '') as text from documents),
b as (select *, case when {_COUNT.format(c="chr(9)")} > {_COUNT.format(c="','")} and {_COUNT.format(c="chr(9)")} > {_COUNT.format(c="';'")} then chr(9) when {_COUNT.format(c="';'")} > {_COUNT.format(c="','")} then ';' else ',' end as d from a),
c as (select *, case when text = '' then [] else list_transform(string_split(case when text[-1] = chr(10) then text[:-2] else text end, chr(10)), lambda x: case when x = '' then [] else string_split(x, d) end) end as rs from b),
e as (select *, [len(list_filter(r, lambda c: {_STRIP.format("c")} <> '')) > 0 for r in rs] as full_rows from c),
h as (select *, list_position(full_rows, true) as pos from e)
select doc_id, case when text = '' then 'empty' else 'parsed' end as status, d as delimiter, len(rs)::bigint as n_rows, coalesce(list_max([len(r) for r in rs]), 0)::bigint as n_columns,
coalesce(array_to_string([{_STRIP.format("c")} for c in rs[pos]][:50], chr(31)), '') as header, len(list_filter(full_rows, lambda f: not f))::bigint as empty_rows, coalesce(array_to_string([array_to_string(r, chr(31)) for r in rs[pos + 1:pos + 20]], chr(30)), '') as shown from h"""


@register("src8_table_structure", _SRC8)
def src8(spark, sf):
    """Delimiter, header, width and blank rows of every whole document as a delimited text."""
    found = T.delimited_structure(spread(read(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")
    shown = F.array_join(F.transform("shown", lambda c: F.array_join(c, "\x1f")), "\x1e")
    return found.withColumns({"header": F.array_join("header", "\x1f"), "shown": shown})
