"""Queries: labels matched to assets.  Parts stand for assets, forty of them for a paper's; a part's noun and size make a label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators import matching as M
from papyrine.plans.registry import register
from papyrine.sources.tables import read, spread

ASSETS = 40
#: Kinds with a type of their own; labels of the other kinds take assets of every type.
TYPES = {"ECONOMY": "ECONOMY", "SMALL": "SMALL", "LARGE": "LARGE", "STANDARD": "STANDARD"}

_NOUN = "upper(split_part(p_name, ' ', -1)[1]) || split_part(p_name, ' ', -1)[2:]"
_LABEL = f"{_NOUN} || ' ' || p_size"


def _parts(spark, sf) -> DataFrame:
    noun = F.substring_index("p_name", " ", -1)
    label = F.concat(F.upper(F.substring(noun, 1, 1)), F.substring(noun, 2, 1 << 30), F.lit(" "), F.col("p_size").cast("string"))
    return read(spark, sf, "part").withColumns({"paper": F.floor(F.col("p_partkey") / ASSETS), "label": label})


def _tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, k = _parts(spark, sf), F.col("p_partkey")
    mentions = p.select("p_partkey", "paper", "label", F.col("p_type").alias("kind"))
    original = F.when(k % 2 == 0, F.concat("p_name", F.lit("_"), F.col("p_size").cast("string"), F.lit(".csv")))
    assets = p.select("paper", k.alias("asset"), F.col("p_type").alias("type"), F.col("p_name").alias("filename"), original.alias("original"), F.concat_ws(" ", "p_brand", "label").alias("notes"), k.alias("place"))
    notes = p.where(k % 5 == 0).select("paper", "label", F.concat_ws(" ", "label", F.lit("in"), "p_name").alias("line"))
    return mentions, assets, notes


_VARIANTS = """[label, h || '_' || n, h || '-' || n, h || n, lower(h) || '_' || n, lower(h) || '-' || n, lower(h) || n, h || '_' || n, h || '-' || n, h || n, h || '._' || n, h || '.' || n, h || ' ' || n, n]"""
_TARGET = f"case when kind in ({', '.join(repr(k) for k in TYPES)}) then kind else '' end"

_JN16 = f"""with p as (select *, p_partkey // {ASSETS} as paper, {_LABEL} as label from part),
m as (select distinct paper, label, p_type as kind from p),
v as (select *, {_TARGET} as target, split_part(label, ' ', 1) as h, split_part(label, ' ', 2) as n from m),
w as (select *, [lower(x) for x in {_VARIANTS}] as vs from v),
a as (select paper, p_partkey as asset, p_type as type, [lower(x) for x in case when p_partkey % 2 = 0 then [p_name, p_name || '_' || p_size || '.csv'] else [p_name] end] as names, p_brand || ' ' || label as notes from p),
t as (select paper, label, max(label || ' in ' || p_name) as line from p where p_partkey % 5 = 0 group by 1, 2),
j as (select w.*, a.asset, a.type, a.names, a.notes, t.line from w join a using (paper) left join t on t.paper = w.paper and t.label = w.label),
k as (select *, target = '' or type = target as fits, list_max(flatten([[len(list_intersect(list_distinct(regexp_extract_all(x, '[a-z0-9]+')), list_distinct(regexp_extract_all(y, '[a-z0-9]+')))) / len(list_distinct(regexp_extract_all(x, '[a-z0-9]+')))::double for y in names] for x in vs])) as token,
len(list_filter(vs, lambda x: len(list_filter(names, lambda y: contains(y, x))) > 0)) > 0 as part from j),
s as (select paper, label, kind, asset, 'notes' as method, 1 as step, case when len(list_filter(names, lambda y: contains(lower(line), y))) > 0 then 0.95 when type = target then 0.85 end as raw, 0.95 as cap from k where line is not null
union all select paper, label, kind, asset, 'filename', 2, case when part then 0.9 when token >= 0.5 then token end, case when part then 0.9 else 0.85 end from k where fits
union all select paper, label, kind, asset, 'caption', 3, case when fits and contains(lower(notes), lower(label)) then 0.8 end, 0.8 from k),
b as (select *, row_number() over (partition by paper, label, kind order by least(raw, cap) desc, step, case when step = 2 and cap = 0.9 then 0.9 else raw end desc, asset) as r from s where raw is not null),
f as (select * from b where r = 1 and least(raw, cap) >= 0.5)
select p_partkey, asset, coalesce(method, 'none') as method, coalesce(round(least(raw, cap)::double, 2), 0.0) as confidence, case when least(raw, cap) >= 0.7 then 'matched' when method is not null then 'low_confidence' else 'unmatched' end as status
from p left join f on f.paper = p.paper and f.label = p.label and f.kind = p.p_type"""


@register("jn16_best_match", _JN16)
def jn16(spark, sf):
    """The steps by notes, names, tokens and captions."""
    return M.match_labels(*_tables(spark, sf), types=TYPES, like=False).select("p_partkey", "asset", "method", "confidence", "status")


@register("jn16b_like_match")
def jn16b(spark, sf):
    """All five steps; ``difflib``'s ratio has no SQL."""
    return M.match_labels(*_tables(spark, sf), types=TYPES).select("p_partkey", "asset", "method", "confidence", "status")


@register("fn18_label_variants", f"""with p as (select p_partkey, {_NOUN} || ' S' || p_size as label from part), v as (select p_partkey, label, split_part(label, ' ', 1) as h, split_part(label, ' ', 2) as n, split_part(label, ' ', 2)[2:] as b from p),
x as (select p_partkey, list_concat({_VARIANTS}, [h || '_' || b, h || '-' || b, h || ' ' || b, h || '_' || b, h || '.' || b, b]) as vs from v) select p_partkey, i::int as place, vs[i + 1] as variant from (select p_partkey, vs, unnest(range(0, len(vs))) as i from x)""")
def fn18(spark, sf):
    noun = F.substring_index("p_name", " ", -1)
    label = F.concat(F.upper(F.substring(noun, 1, 1)), F.substring(noun, 2, 1 << 30), F.lit(" S"), F.col("p_size").cast("string"))
    # a part's few bytes make twenty rows, so the table is dealt before they are made
    return spread(read(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", F.posexplode(M.search_variants(label)).alias("place", "variant"))


@register("fn22_sequence_ratio")
def fn22(spark, sf):
    """``difflib``'s ratio of each part's name and type, which SQL cannot say."""
    return read(spark, sf, "part").select("p_partkey", F.round(M.likeness(F.array("p_name"), F.lower("p_type")), 6).alias("ratio"))
