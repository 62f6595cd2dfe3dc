"""Queries: classifiers and rubrics with all rules, bound to the driver's tables.

The rule tables are those of ``rule_tables``; words of the invented prose are added to each rule as further terms, so that
every branch is met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions import classify as C
from papyrine.functions import rule_tables as R
from papyrine.functions.text import SPACE, SPACES
from papyrine.plans.registry import register
from papyrine.sources.tables import read

BLANKS = " || ".join(f"chr({ord(c)})" for c in SPACES)
WORDS = ("thatin", "ononst", "inoran", "orantion", "rewh", "orre", "thention", "erwh", "anea", "enre", "tionst")
PART_WORDS = ("widget", "bolt", "economy", "promo", "small", "large", "cold", "red", "ring", "standard", "blue")


def with_words(rules: R.Rules, words: Sequence[str]) -> R.Rules:
    """Rules with two further terms each, dealt in turn."""
    return tuple((name, (*terms, words[i % len(words)], words[(i + 1) % len(words)])) for i, (name, terms) in enumerate(rules))


INTENTS, AGENT, TYPES = with_words(R.QUERY_INTENTS, WORDS), with_words(R.AGENT_INTENTS, WORDS), with_words(R.DATASET_TYPES, PART_WORDS)
ROLES, RELATIONS = with_words(R.SECTION_ROLES, WORDS), with_words(R.RELATIONS, WORDS)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(text: str, term: str, literal: bool = False) -> str:
    return f"{'contains' if literal else 'regexp_matches'}({text}, {_quoted(term)})"


def _count(text: str, terms: Sequence[str], literal: bool = False) -> str:
    return " + ".join(f"cast({_found(text, t, literal)} as int)" for t in terms)


def _any(text: str, terms: Sequence[str], literal: bool = False) -> str:
    return "(" + " or ".join(_found(text, t, literal) for t in terms) + ")"


def _best(text: str, rules: R.Rules, most: int, literal: bool = False) -> str:
    found = [f"{{'n': least({most}, {_count(text, terms, literal)}), 'i': {-i}, 'label': {_quoted(name)}}}" for i, (name, terms) in enumerate(rules)]
    return f"list_sort([{', '.join(found)}], 'DESC')[1]"


def _scored(base: float, step: float, most: float, default: str, least: float) -> str:
    score = f"round(least({base} + {step} * b.n, {most}), 2)"
    return f"case when b.n > 0 then b.label else {_quoted(default)} end as label, case when b.n > 0 then {score} else {least} end::double as confidence"


def _cascade(text: str, rules: R.Rules, literal: bool) -> str:
    return " ".join(f"when {_any(text, terms, literal)} then {_quoted(name)}" for name, terms in rules)


@register("cl2_section_role", f"select page_id, case when h = '' then 'unknown' {_cascade('h', ROLES, False)} else 'raw_text' end as role from (select page_id, lower(trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '^[^:]*:', ''), '[ \\t\\n\\r\\f]+', ' ', 'g'))) as h from pages)")
def cl2(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read(spark, sf, "pages").select("page_id", C.section_role(F.lit("html"), title, ROLES).alias("role"))


@register("cl5_query_intent", f"select conv_id, turn, {_scored(0.4, 0.2, 0.95, 'evidence_search', 0.3)} from (select conv_id, turn, {_best('lower(text)', INTENTS, 3)} as b from conversations)")
def cl5(spark, sf):
    label, score = C.scored(F.col("b"), 0.4, 0.2, 0.95, "evidence_search", 0.3)
    return read(spark, sf, "conversations").select("conv_id", "turn", C.intent(F.col("text"), INTENTS).alias("b")).select("conv_id", "turn", label.alias("label"), score.alias("confidence"))


PLAN_SQL = "case label " + " ".join(f"when '{name}' then '{','.join(tools)}'" for name, tools in R.TOOL_PLANS) + " else 'cross_asset_query' end"


@register("cl6_tool_plan", f"select *, {PLAN_SQL} as tools from (select conv_id, turn, {_scored(0.4, 0.2, 0.95, 'literature_question', 0.3)} from (select conv_id, turn, {_best('lower(text)', AGENT, 3)} as b from conversations where role = 'user'))")
def cl6(spark, sf):
    label, score = C.scored(F.col("b"), 0.4, 0.2, 0.95, "literature_question", 0.3)
    asked = read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", C.intent(F.col("text"), AGENT).alias("b"))
    named = asked.select("conv_id", "turn", label.alias("label"), score.alias("confidence"))
    return named.withColumn("tools", F.array_join(C.tool_plan(F.col("label")), ","))


HEADERS = ("p_partkey", "p_name", "p_type", "p_size")
HEADER_LIST = "[" + ", ".join(map(_quoted, HEADERS)) + "]"
TERMS_SQL = "case label " + " ".join(f"when {_quoted(n)} then [{', '.join(map(_quoted, t))}]" for n, t in TYPES) + " else [] end"


@register("cl8_dataset_type", f"""with top as (select *, row_number() over (partition by p_brand order by p_partkey) as r from part),
w as (select p_brand, regexp_replace(lower('{" ".join(HEADERS)} ' || coalesce(p_brand, '') || ' ' || string_agg(p_name || ' ' || p_type, ' ' order by p_partkey)), '[_.-]', ' ', 'g') as words from top where r <= 10 group by p_brand),
l as (select p_brand, words, {_scored(0.7, 0.05, 0.95, 'unknown', 0.0)} from (select *, {_best('words', TYPES, 5, True)} as b from w)),
m as (select *, list_filter({TERMS_SQL}, lambda t: contains(words, t))[1:5] as matched from l)
select p_brand, label, confidence, array_to_string(matched, ', ') as matched, array_to_string(list_filter(matched, lambda t: len(list_filter({HEADER_LIST}, lambda h: contains(lower(h), t))) > 0), ', ') as key_columns from m""")
def cl8(spark, sf):
    top = read(spark, sf, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("r <= 10")
    rows = top.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("rows"))
    headers = F.array(*map(F.lit, HEADERS))
    cells = F.transform("rows", lambda r: F.concat_ws(" ", r["p_name"], r["p_type"]))
    words = rows.select("p_brand", C.dataset_words(headers, cells, F.col("p_brand")).alias("words"))
    label, score = C.scored(F.col("b"), 0.7, 0.05, 0.95, "unknown", 0.0)
    named = words.withColumn("b", C.dataset_type(F.col("words"), TYPES)).select("p_brand", "words", label.alias("label"), score.alias("confidence"))
    found = named.withColumn("terms", C.matched_keywords(F.col("words"), F.col("label"), TYPES))
    keys = F.transform(C.key_columns(headers, F.col("terms")), lambda p: p["keyword"])
    return found.select("p_brand", "label", "confidence", F.array_join("terms", ", ").alias("matched"), F.array_join(keys, ", ").alias("key_columns"))


@register("cl13_evidence_role", """select conv_id, turn, case when boiler then 'boilerplate' when kind = 'claim' and (conf = 'low' or (conf = 'medium' and not links)) then 'weak_claim' when kind = 'claim' then 'claim' when kind = 'result' then 'supporting_result'
when kind = 'figure' then 'figure_context' when conf = 'low' then 'weak_evidence' when conf = 'high' then 'direct_evidence' else 'background' end as evidence_role
from (select conv_id, turn, case when role = 'assistant' then 'claim' when role = 'system' then 'figure' when contains(text, '?') then 'result' else 'note' end as kind, case when length(text) > 400 then 'high' when length(text) > 100 then 'medium' else 'low' end as conf, contains(lower(text), 'license') as boiler, regexp_matches(text, '[0-9]') as links from conversations)""")
def cl13(spark, sf):
    text, n = F.col("text"), F.length("text")
    kind = F.when(F.col("role") == "assistant", "claim").when(F.col("role") == "system", "figure").when(text.contains("?"), "result").otherwise("note")
    sure = F.when(n > 400, "high").when(n > 100, "medium").otherwise("low")
    role = C.evidence_role(kind, sure, F.lower(text).contains("license"), text.rlike("[0-9]"))
    return read(spark, sf, "conversations").select("conv_id", "turn", role.alias("evidence_role"))


@register("cl14_relation", f"select conv_id, turn, case {_cascade('c', RELATIONS, True)} else 'unknown' end as relation from (select conv_id, turn, lower(coalesce(text, '') || ' ' || coalesce(role, '')) as c from conversations)")
def cl14(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", C.relation(F.col("text"), F.col("role"), RELATIONS).alias("relation"))


NOVELTY_SQL = "case kind " + " ".join(f"when '{k}' then {v}e0" for k, v in R.GAP_NOVELTY) + " else 0.6e0 end"
KINDS = (("en", "unknown"), ("fr", "mechanistic"), ("de", "contradiction"), ("es", "evidence"))
KIND_SQL = "case lang " + " ".join(f"when '{a}' then '{b}'" for a, b in KINDS) + " end"


def _points(condition: str, points: float) -> str:
    return f"case when {condition} then {points}e0 else 0e0 end"


def _clipped(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


@register("ql1_gap_quality", f"""with x as (select doc_id, {KIND_SQL} as kind, least(n_chars / 3000e0, 1e0) as sure, string_split(text, chr(10)) as x from documents),
y as (select doc_id, kind, sure, coalesce(x[1], '') as said, length(coalesce(x[2], '')) < 10 or length(coalesce(x[3], '')) < 10 as thin, len(x[4:]) as n, len(list_filter(x[4:], lambda e: length(e) < 20)) as short from x),
z as (select doc_id, sure, {_clipped("case when n = 0 then 0.1e0 when n = 1 then 0.5e0 when n = 2 then 0.7e0 else 0.9e0 end - case when short > 0 then 0.2e0 * short / n else 0e0 end")} as g,
{_clipped(f"case when length(said) < 30 then 0.2e0 when length(said) > 100 then 0.8e0 else 0.5e0 end + {_points(_any('lower(said)', R.VAGUE_GAPS), -0.3)} + ({_points(_found('said', R.GAP_ENTITY), 0.15)}) + {_points(_found('lower(said)', R.GAP_PATHWAY), 0.1)}")} as s,
{_clipped(f"{NOVELTY_SQL} + {_points('thin', -0.2)}")} as v from y)
select doc_id, round(g, 6) as grounding, round(s, 6) as specificity, round(v, 6) as novelty, case when (sure > 0.85 and g < 0.4) or (sure > 0.7 and g < 0.3) then 'high' when (sure > 0.8 and g < 0.6) or (sure > 0.7 and g < 0.5) then 'medium' else 'low' end as overclaim, round(0.40e0 * g + 0.35e0 * s + 0.25e0 * v, 6) as score from z""")
def ql1(spark, sf):
    """Gap statement, missing information and reason are a text's first three lines, its evidence all others."""
    x = F.col("x")
    lines = read(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.split("text", "\n").alias("x"))
    kind = F.create_map(*[F.lit(v) for pair in KINDS for v in pair])
    kind = F.when(F.col("lang").isNotNull(), F.try_element_at(kind, "lang"))
    sure = F.least(F.col("n_chars") / 3000, F.lit(1.0))
    parts = C.gap_quality(F.slice(x, 4, F.greatest(F.size(x), F.lit(0))), F.get(x, 0), sure, kind, F.get(x, 1), F.get(x, 2))
    scored = lines.select("doc_id", *[c.alias(n) for n, c in parts.items()])
    names = ["grounding", "specificity", "novelty"]
    score = C.weighted([F.col(n) for n in names], R.GAP_WEIGHTS, 6)
    return scored.select("doc_id", *[F.round(n, 6).alias(n) for n in names], "overclaim", score.alias("score"))


@register("ql2_hypothesis_quality", f"""with x as (select doc_id, string_split(text, chr(10)) as x, doc_id in (select doc_id from labels) as linked from documents),
y as (select doc_id, linked, coalesce(x[1], '') as told, coalesce(x[2], '') as ground, coalesce(x[3], '') as done, len(x[4:]) as n from x),
z as (select doc_id, {_clipped(f"case when length(told) > 80 then 0.8e0 when length(told) > 30 then 0.6e0 else 0.3e0 end + {_points(_found('lower(told)', R.DIRECTION), 0.1)} + {_points(_found('lower(told)', R.MEASURABLE), 0.1)}")} as t,
{_clipped("case when length(ground) > 80 then 0.7e0 when length(ground) > 30 then 0.5e0 else 0.3e0 end + " + _points('n >= 2', 0.15) + " + " + _points('n >= 1', 0.1) + " + " + _points('linked', 0.1))} as r,
{_clipped(f"case when length(done) > 100 then 0.7e0 when length(done) > 40 then 0.5e0 else 0.3e0 end + {_points(_found('done', R.TECHNIQUE), 0.15)} + {_points(_found('lower(done)', R.MODEL_SYSTEM), 0.1)}")} as f,
{_count('done', R.OVER_SPECIFIC)} as o, {_count("' ' || done || ' ' || told", R.DANGEROUS)} as w from y)
select doc_id, round(t, 6) as testability, round(r, 6) as rationale, round(f, 6) as feasibility, case when o >= 2 then 'high' when o = 1 then 'medium' else 'low' end as over_specific, w as warnings, round(0.35e0 * t + 0.30e0 * r + 0.35e0 * f, 6) as score from z""")
def ql2(spark, sf):
    """Prediction, rationale and experiment are a text's first three lines, its support all others; labels are the known gaps."""
    x = F.col("x")
    known = read(spark, sf, "labels").select("doc_id", F.lit(True).alias("linked")).distinct()
    lines = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("x")).join(known, "doc_id", "left")
    support = F.slice(x, 4, F.greatest(F.size(x), F.lit(0)))
    parts = C.hypothesis_quality(F.get(x, 0), F.get(x, 2), F.get(x, 1), support, F.coalesce("linked", F.lit(False)), F.lit(""))
    scored = lines.select("doc_id", *[c.alias(n) for n, c in parts.items()])
    names = ["testability", "rationale", "feasibility"]
    score = C.weighted([F.col(n) for n in names], R.HYPOTHESIS_WEIGHTS, 6)
    return scored.select("doc_id", *[F.round(n, 6).alias(n) for n in names], "over_specific", F.size("warnings").alias("warnings"), score.alias("score"))


POINTS = tuple((name, (*terms, WORDS[i], WORDS[i + 3])) for i, (name, terms) in enumerate(R.DISCUSSION))


def _points_sql() -> str:
    counts = ", ".join("{'n': " + " + ".join(f"len(regexp_extract_all(lower(s), {_quoted(t)}))" for t in terms) + f", 'i': {-i}, 'kind': '{name}'}}" for i, (name, terms) in enumerate(POINTS))
    return f"list_sort([{counts}], 'DESC')[1]"


@register("tx8_discussion_types", f"""with x as (select doc_id, string_split(regexp_replace(text, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)) as x from documents),
s as (select doc_id, i - 1 as place, trim(x[i], {BLANKS}) as s from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from x)),
d as (select *, row_number() over (partition by doc_id, lower(substr(s, 1, 60)) order by place) as copy from s where length(s) between 30 and 500),
t as (select *, row_number() over (partition by doc_id order by place) as r from d where copy = 1),
b as (select doc_id, place, s, {_points_sql()} as b from t where r <= 10)
select doc_id, place, substr(s, 1, 300) as point, substr(s, 1, 200) as quote, case when b.n > 0 then b.kind else 'interpretation' end as kind, case when b.n >= 2 then 'medium' else 'low' end as confidence from b""")
def tx8(spark, sf):
    points = F.inline(C.discussion_points(F.col("text"), POINTS))
    return read(spark, sf, "documents").select("doc_id", points).withColumn("place", F.col("place").cast("bigint"))


STRONG = (*R.OVERCLAIM, *WORDS[:6], "that", "with")


@register("ql11_guardrails", f"""with r as (select conv_id, count(*) as n, count(case when not regexp_matches(text, '[0-9]') then 1 end) as bare, count(case when length(text) < 60 then 1 end) as lost from conversations where role = 'user' group by conv_id),
f as (select c.conv_id, turn, {_count("lower(coalesce(text, ''))", STRONG, True)} as strong, coalesce(n, 0) as n, coalesce(bare, 0) as bare, coalesce(lost, 0) as lost from conversations c left join r on r.conv_id = c.conv_id where role = 'assistant'),
i as (select conv_id, turn, list_concat(list_filter([case when strong >= 2 and n <= 2 then 'overclaim_risk' end, case when n = 0 then 'no_references' end, case when bare > 0 then 'missing_provenance' end], lambda x: x is not null), list_transform(range(lost), lambda x: 'no_source_path')) as issues from f)
select conv_id, turn, array_to_string(issues, ',') as issues, case when len(issues) >= 3 then 'high' when len(issues) > 0 then 'medium' else 'low' end as risk from i""")
def ql11(spark, sf):
    """An answer's references are the user's turns of its conversation: without provenance if without a digit, without path if short."""
    text, turns = F.col("text"), read(spark, sf, "conversations")
    user = turns.where("role = 'user'").groupBy("conv_id")
    refs = user.agg(F.count(F.lit(1)).alias("n"), F.count_if(~text.rlike("[0-9]")).alias("bare"), F.count_if(F.length(text) < 60).alias("lost"))
    issues, risk = C.guardrails(text, F.col("n"), F.col("bare"), F.col("lost"), STRONG)
    answers = turns.where("role = 'assistant'").join(refs, "conv_id", "left")
    return answers.select("conv_id", "turn", F.array_join(issues, ",").alias("issues"), risk.alias("risk"))


FIGURES, TABLES = with_words(R.FIGURE_KINDS, WORDS), with_words(R.TABLE_KINDS, PART_WORDS)


@register("cl12_caption_type", f"""select 'figure' as asset, page_id as id, case {_cascade('c', FIGURES, True)} else 'unknown' end as kind from (select page_id, lower(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') || ' ' || coalesce(regexp_extract(html, '<p>([^<]*)</p>', 1), '')) as c from pages)
union all select 'table', p_partkey, case {_cascade('c', TABLES, True)} else 'unknown' end from (select p_partkey, lower(coalesce(p_name, '') || ' ' || coalesce(p_type, '')) as c from part)""")
def cl12(spark, sf):
    """Captions are titles, mentioned in the first paragraph, and names of parts, mentioned by their type."""
    title, paragraph = (F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1) for tag in ("title", "p"))
    figures = read(spark, sf, "pages").select(F.lit("figure").alias("asset"), F.col("page_id").alias("id"), C.caption_kind(title, paragraph, FIGURES).alias("kind"))
    tables = C.caption_kind(F.col("p_name"), F.col("p_type"), TABLES)
    return figures.unionByName(read(spark, sf, "part").select(F.lit("table").alias("asset"), F.col("p_partkey").alias("id"), tables.alias("kind")))
