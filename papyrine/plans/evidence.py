"""Queries: evidence of papers, questions and table statistics with all rules, bound to the driver's tables.

The rule tables are those of ``evidence_rules``; words of the invented prose are added as further terms, so that the
rules are met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import evidence as E
from papyrine.functions import evidence_rules as R
from papyrine.functions import type_tables as T
from papyrine.functions.rule_tables import Rules
from papyrine.functions.text import SPACE, SPACES
from papyrine.plans.registry import register
from papyrine.sources.tables import read, spread

HEADINGS = ("license", "thanea", "attion", "eriner", "thanedble", "with")
SECTIONS: Rules = tuple((name, (*patterns, HEADINGS[i])) for i, (name, patterns) in enumerate(R.SECTIONS))
TURNS = ("thatin", "ononst", "rewh", "orre", "inoran")
DIRECTIONS: Rules = tuple((label, (*words, TURNS[i])) for i, (label, words) in enumerate(R.DIRECTIONS))
REPORTS = (*R.RESULT_WORDS, "hehely", "that", "pour")
PHRASES = (*R.CONCLUDING, "(?:hehely|orantion)")
TERMS = (*R.METHOD_TERMS, "thatin", "ononst", "inoran", "orantion", "rewh", "orre")
AROUND = (*R.METHOD_PHRASES, r"(?:with|from|avec|para)\s+(\w+(?:\s+\w+){0,5})")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(text: str, terms: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {_q(t)})" for t in terms) + ")"


def _matches(text: str, patterns: Sequence[str], flags: str = "") -> str:
    return "(" + " or ".join(f"regexp_matches({text}, {_q(flags + p)})" for p in patterns) + ")"


def _cascade(text: str, rules: Rules) -> str:
    return " ".join(f"when {_has(text, terms)} then {_q(label)}" for label, terms in rules)


BLANKS = " || ".join(f"chr({ord(c)})" for c in SPACES)


def _split(text: str) -> str:
    return f"list_transform(string_split(regexp_replace({text}, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {BLANKS}))"


def _heading(line: str, rules: Rules) -> str:
    other = {"results": "discussion", "discussion": "result"}
    labels = [(f"case when contains(lower({line}), '{other[n]}') then '{R.COMBINED}' else '{n}' end" if n in other else f"'{n}'", ps) for n, ps in rules]
    found = " ".join(f"when {_matches(line, ps, '(?i)')} then {label}" for label, ps in labels)
    return f"case when length({line}) < 80 or (length({line}) < 100 and regexp_matches({line}, '^(?:[0-9]+\\.?{SPACE}*)?[A-Z](?:[A-Za-z&]|{SPACE})+$')) then case {found} end end"


NAMES = [n for n, _ in R.SECTIONS]
_OWN = ", ".join(f"array_to_string(list_transform(list_filter(ps, lambda p: p.k = '{n}' and p.t <> ''), lambda p: p.t), ' ') as o_{n}" for n in [*NAMES, R.COMBINED, "body"])
_SHARED = f" when length(o_{R.COMBINED}) > 80 then "
SECTION_SQL = f"""raw as (select doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '') as raw from documents),
marked as (select doc_id, raw, 'body' || chr(2) || array_to_string(list_transform(list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(x, {BLANKS})), lambda x: x <> ''), lambda x: coalesce(chr(1) || ({_heading("x", SECTIONS)}) || chr(2), x)), ' ') as joined from raw),
cut as (select doc_id, raw, list_transform(string_split(joined, chr(1)), lambda p: {{'k': split_part(p, chr(2), 1), 't': trim(split_part(p, chr(2), 2), ' ')}}) as ps from marked),
own as (select doc_id, raw, {_OWN} from cut),
f as (select *, case when trim(raw, {BLANKS}) = '' then '' when length(o_body) < 500 then raw else o_body end as whole from own),
secs as (select doc_id, {", ".join(f"case when length(o_{n}) > 80 then o_{n}{_SHARED + 'o_' + R.COMBINED if n in ('results', 'discussion') else ''} when whole <> '' then whole else o_{n} end as {n}, case when length(o_{n}) > 80 then 'found'{_SHARED + chr(39) + 'combined' + chr(39) if n in ('results', 'discussion') else ''} when whole <> '' then 'fallback_full' else 'missing' end as q_{n}" for n in NAMES)},
o_{R.COMBINED} as {R.COMBINED}, case when length(o_{R.COMBINED}) > 80 then 'found' else 'missing' end as q_{R.COMBINED} from f)"""
ALL = [*NAMES, R.COMBINED]


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", E.sections(F.col("text"), SECTIONS).alias("sections"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """One column for each section."""
    found = _sections(spark, sf).withColumn("m", E.section_texts(F.col("sections")))
    return found.select("doc_id", *[F.col("m")[n].alias(n) for n in ALL])


def _rows(docs: DataFrame, found: Column, field: str) -> DataFrame:
    """A row for each struct; the outer form with a filter behind it, as the plain one computes the array twice."""
    return docs.select("doc_id", F.inline_outer(found)).where(F.col(field).isNotNull())


@register("tx4_sections", f"with {SECTION_SQL} " + " union all ".join(f"select doc_id, '{n}' as section, q_{n} as quality, cast(length({n}) as bigint) as chars, md5({n}) as digest from secs" for n in ALL))
def tx4(spark, sf):
    rows = _rows(_sections(spark, sf), F.col("sections"), "section")
    return rows.select("doc_id", "section", "quality", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


_STEPS = [("results", "Results", 8, False, "length(results) > 200"), ("discussion", "Discussion", 5, True, "length(discussion) > 200"), ("both_", "Abstract_Conclusion", 4, False, "length(both_) > 50"), ("everything", "Full_text", 5, False, "everything <> ''")]


def _long(names: Sequence[str], least: int) -> str:
    return f"array_to_string(list_filter([{', '.join(names)}], lambda t: length(t) > {least}), ' ')"


_TOLD = f"regexp_matches(low, {_q(E.whole_word(REPORTS))})"
_TURNED = _has("low", [w for _, ws in DIRECTIONS for w in ws])
_DIRECTION = " ".join(f"when contains(low, {_q(w)}) then '{label}'" for w, label in sorted(((w, label) for label, ws in DIRECTIONS for w in ws), key=lambda x: -len(x[0])))
RESULT_SQL = f"""texts as (select *, {_long(["abstract", "conclusion"], 50)} as both_, {_long(ALL, 100)} as everything from secs),
chain as ({" union all ".join(f"select doc_id, {i} as step, '{label}' as section, {most} as most, {str(directed).lower()} as directed, {column} as t from texts where {when}" for i, (column, label, most, directed, when) in enumerate(_STEPS))}),
sents as (select doc_id, step, section, most, directed, i - 1 as place, x[i] as s, lower(x[i]) as low from (select *, unnest(range(1, len(x) + 1)) as i from (select *, {_split("t")} as x from chain))),
rated as (select *, {_TOLD} as told, {_TURNED} as turned from sents where length(s) between 30 and 600),
picked as (select *, row_number() over (partition by doc_id, step order by place) as r, min(step) over (partition by doc_id) as first from rated where case when directed then turned else told or turned end),
results_ as (select doc_id, place, substr(s, 1, 300) as result, substr(s, 1, 240) as quote, case {_DIRECTION} else 'descriptive' end as direction, section, case when told and turned then 'high' when told then 'medium' else 'low' end as confidence from picked where step = first and r <= most)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    texts = _texts(spark, sf)
    return texts.withColumn("key_results", E.chained_results({n: F.col(n) for n in ALL}, DIRECTIONS, REPORTS))


@register("tx7_key_results", f"with {SECTION_SQL}, {RESULT_SQL} select * from results_")
def tx7(spark, sf):
    return _rows(_results(spark, sf), F.col("key_results"), "place").withColumn("place", F.col("place").cast("bigint"))


FINDING_SQL = f"""told_ as (select doc_id, 0 as src, 'Conclusion' as section, conclusion as t from secs where length(conclusion) >= 50 union all select doc_id, 1, 'Abstract', abstract from secs where length(abstract) >= 50),
fs as (select doc_id, src, section, i - 1 as place, len(x) as n, x[i] as s from (select *, unnest(range(1, len(x) + 1)) as i from (select *, {_split("t")} as x from told_))),
fr as (select *, {_matches("s", PHRASES, "(?i)")} as told from fs where length(s) between 30 and 500),
fd as (select *, row_number() over (partition by doc_id, lower(substr(s, 1, 60)) order by src, place) as copy from fr where told or place > 0.7e0 * n),
own_ as (select doc_id, src, place, section, s as finding, s as quote, case when told then 'medium' else 'low' end as confidence, lower(substr(s, 1, 60)) as key from fd where copy = 1),
few as (select d.doc_id, count(o.doc_id) as n from secs d left join own_ o on o.doc_id = d.doc_id group by d.doc_id),
sure as (select doc_id, 2 as src, place, 'Results' as section, result as finding, quote, 'medium' as confidence, lower(substr(result, 1, 60)) as key, row_number() over (partition by doc_id order by place) as r from results_ where confidence = 'high'),
allf as (select doc_id, src, place, section, finding, quote, confidence, key from own_ union all select s.doc_id, src, place, section, finding, quote, confidence, key from sure s join few on few.doc_id = s.doc_id and few.n < 2 where r <= 2),
onef as (select *, row_number() over (partition by doc_id, key order by src, place) as copy from allf),
findings_ as (select doc_id, substr(finding, 1, 300) as finding, substr(quote, 1, 200) as quote, section, confidence from (select *, row_number() over (partition by doc_id order by src, place) as r from onef where copy = 1) where r <= 3)"""


def _findings() -> Column:
    return E.core_findings(F.col("conclusion"), F.col("abstract"), F.col("key_results"), PHRASES)


@register("tx9_core_findings", f"with {SECTION_SQL}, {RESULT_SQL}, {FINDING_SQL} select * from findings_")
def tx9(spark, sf):
    return _rows(_results(spark, sf), _findings(), "finding")


_ORDERED = sorted(set(TERMS), key=lambda t: (-len(t), t))


def _term_sql(i: int, t: str) -> str:
    quote = f"trim(substr(raw, greatest(instr(low, {_q(t)}) - 60, 1), instr(low, {_q(t)}) + {len(t) + 60} - greatest(instr(low, {_q(t)}) - 60, 1)), {BLANKS})"
    return f"select doc_id, {i} as place, {_q(t)} as name, '{E.method_type(t)}' as kind, substr({quote}, 1, 200) as quote, 'medium' as confidence from m where contains(low, {_q(t)})"


_PHRASE_SQL = " union all ".join(f"select doc_id, {1000 + i} as fam, unnest(range(1, len(x) + 1)) as j, x from (select doc_id, regexp_extract_all(raw, {_q('(?i)' + E.any_letter(p))}, 0) as x from m)" for i, p in enumerate(AROUND))


@register("tx6_methods", f"""with m as (select doc_id, coalesce(text, '') as raw, lower(coalesce(text, '')) as low from documents),
t as ({" union all ".join(_term_sql(i, t) for i, t in enumerate(_ORDERED))}),
p as (select doc_id, fam, j, trim(x[j], {BLANKS}) as s from ({_PHRASE_SQL})),
k as (select *, row_number() over (partition by doc_id, lower(substr(s, 1, 40)) order by fam, j) as copy from p where length(s) > 15),
u as (select doc_id, place, 0 as j, name, kind, quote, confidence from t union all select doc_id, fam, j, substr(s, 1, 200), 'experiment', substr(s, 1, 200), 'low' from k where copy = 1),
n as (select *, row_number() over (partition by doc_id, substr(regexp_replace(lower(name), '\\s+', ' ', 'g'), 1, 30) order by place, j) as copy from u),
r as (select *, row_number() over (partition by doc_id order by place, j) as r from n where copy = 1) select doc_id, name, kind, quote, confidence from r where r <= 12""")
def tx6(spark, sf):
    return _rows(spread(read(spark, sf, "documents").select("doc_id", "text")), E.methods(F.col("text"), TERMS, AROUND), "name")


GENERIC, SPECIFIC = (*R.GENERIC_METHODS, "with", "pour"), (*R.SPECIFIC_METHODS, "thatin", "rewh", "orre")


@register("flt16_method_noise", f"""select conv_id, turn, not {_has("low", SPECIFIC)} as noise, array_to_string(list_filter([case when {_has("low", GENERIC)} then 'generic_method_phrase' end, case when not {_has("low", SPECIFIC)} then 'missing_specific_method_name' end, case when length(trim(low, {BLANKS})) < 50 then 'low_information_method' end], lambda x: x is not null), ',') as flags from (select conv_id, turn, lower(coalesce(text, '')) as low from conversations)""")
def flt16(spark, sf):
    noise, flags = E.method_noise(F.col("text"), GENERIC, SPECIFIC)
    return read(spark, sf, "conversations").select("conv_id", "turn", noise.alias("noise"), F.array_join(flags, ",").alias("flags"))


OUTSIDE, INSIDE = (*R.OUT_OF_SCOPE, "with", "from", "pour"), (*R.IN_SCOPE, "thatin", "this", "elle")


@register("flt12_out_of_scope", f"select conv_id, turn from (select conv_id, turn, lower(coalesce(text, '')) as low from conversations) where {_has('low', OUTSIDE)} and not {_has('low', INSIDE)}")
def flt12(spark, sf):
    return read(spark, sf, "conversations").where(E.out_of_scope(F.col("text"), OUTSIDE, INSIDE)).select("conv_id", "turn")


ROUTES: Rules = tuple((label, (*words, ("thatin", "ononst", "inoran", "orantion", "hehely", "anea", "enre", "erwh")[i])) for i, (label, words) in enumerate(R.LITERATURE_INTENTS))
LATE: Rules = tuple((label, (*words, "that")) for label, words in R.LATE_INTENTS)
_NAMED = f"(len(list_filter(regexp_extract_all(t, {_q(R.ENTITY_NAME)}), lambda n: n not in ({', '.join(map(_q, R.NOT_ENTITIES))}))) > 0 and ({_has('low', R.SUPPLEMENT_WORDS + R.ENTITY_WORDS)} or {_matches('t', [E.any_letter(p) for p in R.PLACE_PHRASES], '(?i)')}))"


@register("cl7_intent_cascade", f"""select page_id, case {_cascade("low", ROUTES)} when named and {_has("low", R.COMPARING)} then 'supplementary_entity_comparison_query' when named then 'supplementary_entity_query' {_cascade("low", LATE)} else 'hybrid_search' end as intent
from (select *, {_NAMED} as named from (select page_id, t, lower(t) as low from (select page_id, coalesce(url, '') || ' ' || coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as t from pages)))""")
def cl7(spark, sf):
    """A page's address and title are the question."""
    asked = F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")))
    return read(spark, sf, "pages").select("page_id", E.literature_intent(asked, ROUTES, LATE).alias("intent"))


# Types of tables and figures; their words are a parameter, here those of the driver's tables.
PART_WORDS = ("widget", "bolt", "economy", "promo", "small", "large", "cold", "red", "ring", "standard", "blue", "brand", "hot", "green", "gear", "pin")
PROSE = ("thatin", "ononst", "inoran", "orantion", "rewh", "orre", "hehely", "anea", "elle", "enre", "tion", "ment", "keit", "pour", "dans", "para", "nicht", "thon", "lich")


def _dealt(rules: T.Tiers, words: Sequence[str]) -> T.Tiers:
    """The rules with a strong pair and four weak words of the driver's tables each, dealt in turn."""
    n = len(words)
    return tuple((t, (*high, f"{words[i % n]} {words[(i + 3) % n]}", words[(i * 5) % n] + words[(i + 7) % n]), (*low, *[words[(i + j) % n] for j in range(4)])) for i, (t, high, low) in enumerate(rules))


TABLES, FIGURES = _dealt(T.TABLE_TYPES, PART_WORDS), _dealt(T.FIGURE_TYPES, PROSE)


def _why_sql(rules: T.Tiers, least: int, told: Sequence[str]) -> str:
    """Reason of a type in rows with ``words`` and ``label``."""

    def of(place: int) -> str:
        return "case label " + " ".join(f"when '{r[0]}' then [{', '.join(map(_q, r[place]))}]" for r in rules) + " else [] end"

    high, low = (f"list_filter({of(i)}, lambda t: contains(words, lower(t)))" for i in (1, 2))
    return f"case when len({high}) > 0 then '{told[0]}' || array_to_string({high}[1:5], ', ') when len({low}) >= {least} then '{told[1]}' || array_to_string({low}[1:5], ', ') when len({low}) > 0 then '{told[2]}' || {low}[1] else '{told[3]}' end"


_SUBTYPE_SQL = "case " + " ".join(f"when label = '{name}' then case {' '.join(f'when contains(words, {_q(w)}) then {_q(k)}' for w, k in kinds)} else '' end" for name, kinds in T.SUBTYPES) + " else '' end"


def _tier_sql(words: str, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]], strong: str, fair: str, weak: float, least: int) -> str:
    """Rows (k, i, label, c) of the types with a word."""

    def n(terms: Sequence[str]) -> str:
        return " + ".join(f"cast(contains({words}, {_q(t.lower())}) as int)" for t in terms)

    rows = " union all ".join(f"select k, {i} as i, '{label}' as label, {n(high)} as n, {n(low)} as m from w" for i, (label, high, low) in enumerate(rules))
    return f"select k, i, label, round(case when n > 0 then {strong.format('n')} when m >= {least} then {fair.format('m')} when m > 0 then {weak}e0 end, 6) as c from ({rows}) where n + m > 0"


_TYPE_SQL = """select *, c > coalesce(max(c) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as top from s),
b as (select *, row_number() over (partition by k order by c desc, i) as rank, min(case when top then i end) over (partition by k order by i rows between 1 following and unbounded following) as next_top from t),
a as (select k, string_agg(label, ',' order by lost) as alternatives from (select k, label, lost, row_number() over (partition by k order by lost) as r from (select k, label, case when top then next_top else i end as lost from b where rank > 1 and c > 0.3)) where r <= 3 group by k)"""


_PART_HEADERS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@register("cl9_table_type", f"""with w as (select p_partkey as k, regexp_replace(lower('{" ".join(_PART_HEADERS)} ' || coalesce(p_brand, '') || ' ' || coalesce(p_name, '') || ' ' || coalesce(p_type, '')), '[_.-]', ' ', 'g') as words from part),
s as ({_tier_sql("words", TABLES, "least(0.70e0 + 0.10e0 * {0}, 0.95e0)", "least(0.50e0 + 0.08e0 * {0}, 0.70e0)", 0.35, 3)}), t as ({_TYPE_SQL}, z as (select w.k as p_partkey, words, coalesce(label, 'unknown') as label, coalesce(c, 0e0) as confidence from w left join b on b.k = w.k and rank = 1)
select p_partkey, label, confidence, {_why_sql(TABLES, 3, T.TABLE_REASONS)} as reason, '' as keys from z""")
def cl9(spark, sf):
    """A part is a table of one row; its columns are the headers."""
    words = F.regexp_replace(F.lower(F.concat_ws(" ", F.lit(" ".join(_PART_HEADERS)), F.coalesce("p_brand", F.lit("")), F.coalesce("p_name", F.lit("")), F.coalesce("p_type", F.lit("")))), r"[_.\-]", " ")
    parts = spread(read(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type"))
    typed = parts.select("p_partkey", words.alias("words")).withColumn("b", E.best_type(E.two_tiers(F.col("words"), TABLES, *T.TABLE_TIERS)))
    keys = E.key_columns(F.col("b.label"), F.array(*map(F.lit, _PART_HEADERS)))
    listed = F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k["key"], F.array_join(k["columns"], "+"))), ",")
    return typed.select("p_partkey", "b.label", "b.confidence", E.reason(F.col("words"), F.col("b.label"), TABLES, 3, T.TABLE_REASONS).alias("reason"), listed.alias("keys"))


@register("cl11_figure_type", f"""with w as (select doc_id as k, regexp_replace(lower(coalesce(text, '')), '[_.-]', ' ', 'g') as words from documents),
s as ({_tier_sql("words", FIGURES, "least(0.70e0 + 0.15e0 * {0}, 0.98e0)", "least(0.40e0 + 0.10e0 * {0}, 0.65e0)", 0.30, 2)}), t as ({_TYPE_SQL}, z as (select w.k as doc_id, words, coalesce(label, 'unknown') as label, coalesce(c, 0e0) as confidence, coalesce(alternatives, '') as alternatives from w left join b on b.k = w.k and rank = 1 left join a on a.k = w.k)
select doc_id, label, confidence, alternatives, {_SUBTYPE_SQL} as subtype, {_why_sql(FIGURES, 2, T.FIGURE_REASONS)} as reason from z""")
def cl11(spark, sf):
    """A document is a figure's caption."""
    words = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[_.\-]", " ")
    docs = spread(read(spark, sf, "documents").select("doc_id", "text"))
    typed = docs.select("doc_id", words.alias("words")).withColumn("b", E.best_type(E.two_tiers(F.col("words"), FIGURES, *T.FIGURE_TIERS)))
    return typed.select("doc_id", "b.label", "b.confidence", F.array_join("b.alternatives", ",").alias("alternatives"), E.subtype(F.col("words"), F.col("b.label")).alias("subtype"), E.reason(F.col("words"), F.col("b.label"), FIGURES, 2, T.FIGURE_REASONS).alias("reason"))


_HEADERS = ("'l_quantity'", "case l_returnflag when 'A' then 'FDR' when 'R' then 'p-adj.' else 'l_p_value' end", "'Std_Dev'", "'l_shipdate'")


def _hit_sql(words: Sequence[str]) -> str:
    return f"list_filter(headers, lambda h: {_has('regexp_replace(lower(h), ' + _q('[_.-]') + ', ' + _q(' ') + ', ' + _q('g') + ')', words)})"


@register("cl10_stat_fields", f"""with l as (select l_orderkey, l_returnflag, [{", ".join(_HEADERS)}] as headers, l_discount, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey) as r from lineitem),
g as (select l_orderkey, l_returnflag, any_value(headers) as headers, list(l_discount) filter (r <= 20 and l_discount between 0 and 1) as v from l group by 1, 2),
h as (select *, list_filter([{", ".join(f"{{'field': '{n}', 'columns': {_hit_sql(ws)}}}" for n, _, ws in R.STAT_FIELDS)}], lambda f: len(f.columns) > 0) as fields, len({_hit_sql(R.P_COLUMNS)}) > 0 as has_p from g)
select l_orderkey, l_returnflag, array_to_string(list_transform(fields, lambda f: f.field), ',') as fields, round(least(0.3e0 + 0.1e0 * len(fields), 0.9e0), 2) as confidence, case when has_p then list_min(v) end as low, case when has_p then list_max(v) end as high,
case when has_p then len(list_filter(v, lambda x: x < 0.05))::int end as below_05, case when has_p then len(list_filter(v, lambda x: x < 0.01))::int end as below_01, case when has_p then len(list_filter(v, lambda x: x < 0.001))::int end as below_001 from h""")
def cl10(spark, sf):
    """The lines of an order with one return flag are a table, whose second column is a p value under three names."""
    flag = F.col("l_returnflag")
    second = F.when(flag == "A", "FDR").when(flag == "R", "p-adj.").otherwise("l_p_value")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    tables = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    cells = F.transform("rows", lambda r: F.array(*[r[c].cast("string") for c in ("l_quantity", "l_discount", "l_tax", "l_shipdate")]))
    headers = F.array(F.lit("l_quantity"), second, F.lit("Std_Dev"), F.lit("l_shipdate"))
    shaped = tables.select("l_orderkey", "l_returnflag", headers.alias("headers"), cells.alias("cells"))
    told = shaped.select("l_orderkey", "l_returnflag", E.stat_fields(F.col("headers")).alias("fields"), E.p_thresholds(F.col("headers"), F.col("cells")).alias("p"))
    names = F.array_join(F.transform("fields", lambda f: f["field"]), ",")
    return told.select("l_orderkey", "l_returnflag", names.alias("fields"), E.stat_confidence(F.col("fields")).alias("confidence"), "p.*")
