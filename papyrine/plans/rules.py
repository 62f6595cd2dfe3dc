"""Queries: text tables, rule classifiers and quality rubrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions.rules import keyword_hits, rubric
from papyrine.functions.text import clip
from papyrine.operators import chunking as C
from papyrine.operators.tagging import TagRule, score_tags, tag_hits
from papyrine.plans.registry import register
from papyrine.sources.tables import read, spread

SPLIT = "string_split(regexp_replace(text, '([.!?])[ \\n\\t]+', '\\1' || chr(1), 'g'), chr(1))"
SENTS = f"s as (select doc_id, lang, i - 1 as place, trim(x[i], ' ') as sentence, len(x) as total from (select doc_id, lang, x, unnest(range(1, len(x) + 1)) as i from (select doc_id, lang, {SPLIT} as x from documents)))"


def _docs(spark, sf):
    return read(spark, sf, "documents")


def _sentences(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", F.split("text", r"(?<=[.!?])[ \n\t]+").alias("x"))
    return d.select("doc_id", "lang", F.posexplode("x").alias("place", "sentence"), F.size("x").alias("total")).withColumn("sentence", F.btrim("sentence", F.lit(" ")))


@register("tx1_paragraph_chunks")
def tx1(spark, sf):
    return C.paragraph_chunks(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text")


@register("tx2_fixed_windows", "select doc_id, i as chunk, substr(text, i * 1420 + 1, 1600) as chunk_text from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil((length(text) - 180) / 1420.0) as bigint)))) as i from documents)")
def tx2(spark, sf):
    return C.windows(_docs(spark, sf), "doc_id", "text", 1600, 180)


@register("tx3_sliding_windows", "select doc_id, i as chunk, substr(text, i * 1050 + 1, 1200) as chunk_text from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil((length(text) - 150) / 1050.0) as bigint)))) as i from documents)")
def tx3(spark, sf):
    return C.windows(_docs(spark, sf), "doc_id", "text", 1200, 150)


@register("tx5_header_adjacency", """with l as (select doc_id, i, x[i] as line from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from (select doc_id, string_split(text, chr(10)) as x from documents))),
h as (select doc_id, i, line, i - lag(i) over (partition by doc_id order by i) as gap from l where length(line) between 1 and 80) select doc_id, i - 1 as line_no, case when gap is null or gap > 3 then 0.85 when gap > 1 then 0.6 else 0.5 end::double as confidence from h""")
def tx5(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("length(line) between 1 and 80")
    gap = F.col("i") - F.lag("i").over(Window.partitionBy("doc_id").orderBy("i"))
    c = F.when(gap.isNull() | (gap > 3), 0.85).when(gap > 1, 0.6).otherwise(0.5)
    return lines.select("doc_id", F.col("i").cast("bigint").alias("line_no"), c.alias("confidence"))


@register("tx10_evidence_assembly", "select conv_id, count(*) as items, string_agg(role || ':' || length(text), '|' order by turn) as evidence from conversations group by conv_id")
def tx10(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id")
    items = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    joined = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["role"], x["n"].cast("string"))), "|")
    return c.agg(F.count(F.lit(1)).alias("items"), joined.alias("evidence"))


@register("tx11_flat_chunks", f"with {SENTS} select doc_id, place, substr(sentence, 1, 1200) as chunk, 'doc:' || doc_id || ':' || lpad(cast(place as varchar), 4, '0') as chunk_id from s where length(sentence) >= 15")
def tx11(spark, sf):
    s = _sentences(spark, sf).where("length(sentence) >= 15")
    cid = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit(":"), F.lpad(F.col("place").cast("string"), 4, "0"))
    return s.select("doc_id", F.col("place").cast("bigint").alias("place"), F.substring("sentence", 1, 1200).alias("chunk"), cid.alias("chunk_id"))


@register("tx12_paragraph_evidence", """select doc_id, i - 1 as place, round(least(0.9, 0.40 + 0.15 * n), 6)::double as score from (select doc_id, i, len(regexp_extract_all(lower(x[i]), 'thatin|rewh|orre')) as n, length(x[i]) as c from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from (select doc_id, string_split(text, chr(10)) as x from documents))) where c >= 50 and n > 0""")
def tx12(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).where("length(line) >= 50")
    n = F.regexp_count(F.lower("line"), F.lit("thatin|rewh|orre"))
    return lines.withColumn("n", n).where("n > 0").select("doc_id", F.col("place").cast("bigint").alias("place"), F.round(F.least(F.lit(0.9), 0.40 + 0.15 * F.col("n")), 6).alias("score"))


@register("tx17_entity_patterns", "select distinct doc_id, kind, m as name from (select doc_id, 'caps' as kind, unnest(regexp_extract_all(text, '[A-Z]{4,}')) as m from documents union all select doc_id, 'number', unnest(regexp_extract_all(text, '[0-9]{3,}')) from documents)")
def tx17(spark, sf):
    patterns = {"caps": "[A-Z]{4,}", "number": "[0-9]{3,}"}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), 0).alias("m")) for k, p in patterns.items()])
    e = _docs(spark, sf).select("doc_id", F.inline(kinds))
    return e.select("doc_id", "kind", F.explode(F.array_distinct("m")).alias("name"))


@register("tx18_asset_builders", "select kind, count(*) as n, cast(sum(chars) as bigint) as chars from (select case when contains(lower(text), 'thatin') then 'method' when n_chars > 3000 then 'section' else 'result' end as kind, least(n_chars, 16000) as chars from documents) group by kind")
def tx18(spark, sf):
    kind = F.when(F.lower("text").contains("thatin"), "method").when(F.col("n_chars") > 3000, "section").otherwise("result")
    return _docs(spark, sf).select(kind.alias("kind"), F.least("n_chars", F.lit(16000)).alias("chars")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


@register("tx19_positional_offsets", "select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 + (select count(*) from nation where n_regionkey = 0) as claim_index from conversations where role = 'assistant'")
def tx19(spark, sf):
    offset = read(spark, sf, "nation").where("n_regionkey = 0").agg(F.count(F.lit(1)).alias("k"))
    c = read(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    e = c.select("conv_id", F.posexplode("t").alias("i", "turn")).join(F.broadcast(offset))  # one row
    return e.select("conv_id", "turn", (F.col("i") + F.col("k")).alias("claim_index"))


@register("tx20_agent_chunks", "select 'doc' as asset, doc_id as id, concat_ws(' | ', lang, source, substr(text, 1, 40)) as chunk from documents union all select 'page', page_id, concat_ws(' | ', 'web', url, substr(html, 1, 15)) from pages")
def tx20(spark, sf):
    d = _docs(spark, sf).select(F.lit("doc").alias("asset"), F.col("doc_id").alias("id"), F.concat_ws(" | ", "lang", "source", F.substring("text", 1, 40)).alias("chunk"))
    p = read(spark, sf, "pages").select(F.lit("page").alias("asset"), F.col("page_id").alias("id"), F.concat_ws(" | ", F.lit("web"), "url", F.substring("html", 1, 15)).alias("chunk"))
    return d.unionByName(p)


@register("tx21_dataset_entities", "select column_name, value from (select column_name, value, row_number() over (partition by column_name order by n desc, value) as r from (select 'p_brand' as column_name, p_brand as value, count(*) as n from part group by 2 union all select 'p_type', p_type, count(*) from part group by 2)) where r <= 5")
def tx21(spark, sf):
    long = read(spark, sf, "part").select(F.explode(F.create_map(F.lit("p_brand"), "p_brand", F.lit("p_type"), "p_type")).alias("column_name", "value"))
    n = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return n.withColumn("r", r).where("r <= 5").select("column_name", "value")


@register("tx22_entity_index", "select lower(p_brand) as entity, count(*) as rows, string_agg(distinct p_type, ',' order by p_type) as types, min(l_orderkey) as first_order from lineitem join part on p_partkey = l_partkey group by 1")
def tx22(spark, sf):
    l = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return l.groupBy(F.lower("p_brand").alias("entity")).agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.min("l_orderkey").alias("first_order"))


@register("tx23_dataset_evidence", "select 'effect' as kind, l_orderkey, l_linenumber, l_discount as value from lineitem where l_discount >= 0.1 union all select 'significance', l_orderkey, l_linenumber, l_tax from lineitem where l_tax < 0.01")
def tx23(spark, sf):
    l = read(spark, sf, "lineitem")
    a = l.where("l_discount >= 0.1").select(F.lit("effect").alias("kind"), "l_orderkey", "l_linenumber", F.col("l_discount").alias("value"))
    return a.unionByName(l.where("l_tax < 0.01").select(F.lit("significance").alias("kind"), "l_orderkey", "l_linenumber", F.col("l_tax").alias("value")))


@register("tx24_evidence_packet", """with u as (select min(doc_id) as doc_id, source, lower(substr(text, 1, 80)) as p from documents where not contains(lower(text), 'license') group by source, p) select source, string_agg(cast(doc_id as varchar), ' ' order by doc_id) as refs from (select *, row_number() over (partition by source order by doc_id) as r from u) where r <= 12 group by source""")
def tx24(spark, sf):
    u = _docs(spark, sf).where(~F.lower("text").contains("license")).groupBy("source", F.lower(F.substring("text", 1, 80)).alias("p")).agg(F.min("doc_id").alias("doc_id"))
    top = u.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("r <= 12").groupBy("source")
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), " ").alias("refs"))


TAGS = (
    TagRule("first", "alpha", ("thatin",), ("that[a-z]+ing",), ("license",), weight=1.0, min_score=3.0),
    TagRule("first", "beta", ("ononst", "this inoran"), weight=2.0, min_score=2.0, required_sections=("title", "results", "raw_text")),
    TagRule("second", "gamma", ("rewh",), ("orre[a-z]*",), weight=0.5, weak_sections=("introduction",)),
)


@register("cl1_dictionary_tags")
def cl1(spark, sf):
    """A document's first line is its title, the rest its text; headings are those of the page of the same number."""
    d = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.split("text", "\n", 2).alias("x"))
    parts = d.select("id", F.inline(F.array(F.struct(F.lit("title").alias("source"), F.get("x", 0).alias("text")), F.struct(F.lit("raw").alias("source"), F.get("x", 1).alias("text")))))
    marked = F.regexp_replace(F.regexp_replace("html", "<h([1-6])[^>]*>", "\n## "), "</h[1-6]>", "\n")
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("source"), marked.alias("text"))
    return score_tags(tag_hits(spread(parts.unionByName(pages)), "id", "source", "text", TAGS), "id", TAGS)


@register("cl1b_span_exclusion")
def cl1b(spark, sf):
    """Tag hits that have no excluded word within 80 characters."""
    return C.hits_without_exclusion(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", "that", "with", 80)


@register("cl3_dictionary_validation", "select distinct p_type as missing from part where p_type not in ('ECONOMY', 'SMALL', 'STANDARD')")
def cl3(spark, sf):
    known = spark.createDataFrame([("ECONOMY",), ("SMALL",), ("STANDARD",)], "p_type string")
    return read(spark, sf, "part").select("p_type").distinct().join(known, "p_type", "left_anti").select(F.col("p_type").alias("missing"))


@register("cl4_retag_changed", "select d.doc_id from documents d where md5(text) <> md5(case when doc_id % 10 = 0 then text || 'x' else text end)")
def cl4(spark, sf):
    d = _docs(spark, sf)
    old = d.select("doc_id", F.md5("text").alias("old"))
    new = d.select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("new"))
    return old.join(new, "doc_id").where("old <> new").select("doc_id")


@register("cl15_subtopic_specificity", "select doc_id, round(s / 3.0, 6)::double as score from (select doc_id, cast(contains(lower(text), 'thatin') as int) * 1.5 + cast(contains(lower(text), 'that') as int) * 0.5 + cast(contains(lower(text), 'rewh') as int) * 1.0 as s, cast(contains(lower(text), 'thatin') as int) + cast(contains(lower(text), 'that') as int) + cast(contains(lower(text), 'rewh') as int) as n from documents) where s / 3.0 >= 0.2 and n >= 2")
def cl15(spark, sf):
    weights = {"thatin": 1.5, "that": 0.5, "rewh": 1.0}
    low = F.lower("text")
    s = sum((low.contains(k).cast("int") * w for k, w in weights.items()), F.lit(0.0)) / 3.0
    return _docs(spark, sf).withColumn("n", keyword_hits(low, list(weights))).withColumn("s", s).where("s >= 0.2 and n >= 2").select("doc_id", F.round("s", 6).alias("score"))


@register("cl16_file_assets", "select page_id, coalesce(nullif(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.([a-z]+)$', 1), ''), 'none') as extension from pages")
def cl16(spark, sf):
    bare = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return read(spark, sf, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract(bare, r"\.([a-z]+)$", 1), F.lit("")), F.lit("none")).alias("extension"))


RUBRIC = [("length(text) < 30", 20, "short"), ("not contains(lower(text), 'th')", 15, "no_source"), ("lang <> 'en'", 10, "unknown_type"), ("n_chars > 10000", 25, "long"), ("regexp_matches(text, '[*#$%&]{3}')", 50, "noise")]


@register("ql3_chunk_rubric", "select doc_id, greatest(100 " + " ".join(f"- case when {c} then {p} else 0 end" for c, p, _ in RUBRIC) + ", 0) as score, array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for c, _, n in RUBRIC) + "], lambda x: x is not null), ',') as notes from documents")
def ql3(spark, sf):
    t = F.col("text")
    rules = [(F.length(t) < 30, -20, "short"), (~F.lower(t).contains("th"), -15, "no_source"), (F.col("lang") != "en", -10, "unknown_type"), (F.col("n_chars") > 10000, -25, "long"), (t.rlike("[*#$%&]{3}"), -50, "noise")]
    score, notes = rubric(100, rules)
    return _docs(spark, sf).select("doc_id", score.alias("score"), notes.alias("notes"))


@register("ql4_claim_rubric", "select conv_id, turn, greatest(100 - case when length(text) < 15 then 20 else 0 end - case when not contains(lower(text), 'that') then 15 else 0 end - case when length(text) < 60 then 15 else 0 end, 0) as score from conversations")
def ql4(spark, sf):
    n = F.length("text")
    score, _ = rubric(100, [(n < 15, -20, "source"), (~F.lower("text").contains("that"), -15, "link"), (n < 60, -15, "short")])
    return read(spark, sf, "conversations").select("conv_id", "turn", score.alias("score"))


@register("ql5_asset_validation", "select source, round(0.5 * p + 0.5 * q, 6)::double as overall, case when 0.5 * p + 0.5 * q >= 0.9 then 'excellent' when 0.5 * p + 0.5 * q >= 0.7 then 'good' when 0.5 * p + 0.5 * q >= 0.5 then 'fair' else 'poor' end as grade from (select source, avg(cast(n_chars > 0 as int)) as p, avg(cast(d.doc_id in (select doc_id from labels) as int)) as q from documents d group by source)")
def ql5(spark, sf):
    l = read(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    d = _docs(spark, sf).select("doc_id", "source", "n_chars").join(l, "doc_id", "left").groupBy("source")
    o = 0.5 * F.avg((F.col("n_chars") > 0).cast("int")) + 0.5 * F.avg(F.coalesce("l", F.lit(0)))
    g = d.agg(o.alias("o"))
    return g.select("source", F.round("o", 6).alias("overall"), F.when(F.col("o") >= 0.9, "excellent").when(F.col("o") >= 0.7, "good").when(F.col("o") >= 0.5, "fair").otherwise("poor").alias("grade"))


@register("ql6_parse_quality", "select doc_id, round(0.25 * cast(source is not null as int) + 0.30 * case when n_chars > 5000 then 1 when n_chars > 1000 then 0.6 else 0.3 end + 0.15 * cast(contains(text, chr(10)) as int) + 0.10 * cast(lang = 'en' as int), 6)::double as quality from documents")
def ql6(spark, sf):
    n = F.col("n_chars")
    q = 0.25 * F.col("source").isNotNull().cast("int") + 0.30 * F.when(n > 5000, 1.0).when(n > 1000, 0.6).otherwise(0.3) + 0.15 * F.contains("text", F.lit("\n")).cast("int") + 0.10 * (F.col("lang") == "en").cast("int")
    return _docs(spark, sf).select("doc_id", F.round(q, 6).alias("quality"))


@register("ql7_source_gate", "select doc_id, case when least(n_chars / 2000.0, 1) >= 0.65 then 'hybrid' else 'fallback' end as chosen from documents")
def ql7(spark, sf):
    return _docs(spark, sf).select("doc_id", F.when(clip(F.col("n_chars") / 2000) >= 0.65, "hybrid").otherwise("fallback").alias("chosen"))


@register("ql8_priority_merge", "select d.doc_id, coalesce(p.url, l.quality::varchar, d.source) as merged from documents d left join pages p on p.page_id = d.doc_id left join labels l on l.doc_id = d.doc_id")
def ql8(spark, sf):
    d = _docs(spark, sf).select("doc_id", "source")
    p = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    l = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("q"))
    return d.join(p, "doc_id", "left").join(l, "doc_id", "left").select("doc_id", F.coalesce("url", "q", "source").alias("merged"))


@register("ql9_dataset_quality", "select p_brand, round((case when n > 10 then 0.9 else 0.2 end + case when t > 2 then 0.9 else 0.2 end + case when s > 20 then 0.8 else 0.3 end) / 3, 2)::double as quality from (select p_brand, count(*) as n, count(distinct p_type) as t, avg(p_size) as s from part group by p_brand)")
def ql9(spark, sf):
    q = (F.when(F.count(F.lit(1)) > 10, 0.9).otherwise(0.2) + F.when(F.count_distinct("p_type") > 2, 0.9).otherwise(0.2) + F.when(F.avg("p_size") > 20, 0.8).otherwise(0.3)) / 3
    return read(spark, sf, "part").groupBy("p_brand").agg(F.round(q, 2).alias("quality"))


@register("ql10_asset_quality", "select page_id, round(0.4 * cast(contains(html, '<title>') as int) + 0.3 * cast(length(html) > 1000 as int) + 0.3 * cast(contains(html, '<p>') as int), 6)::double as quality from pages")
def ql10(spark, sf):
    h = F.col("html")
    q = 0.4 * h.contains("<title>").cast("int") + 0.3 * (F.length(h) > 1000).cast("int") + 0.3 * h.contains("<p>").cast("int")
    return read(spark, sf, "pages").select("page_id", F.round(q, 6).alias("quality"))


@register("ql12_recommendations", "select source, 'P1' as priority, 'few_labels' as reason from documents d left join labels l using (doc_id) group by source having count(l.doc_id) < 20 union all select source, 'P2', 'short' from documents group by source having avg(n_chars) < 2000")
def ql12(spark, sf):
    j = _docs(spark, sf).select("doc_id", "source", "n_chars").join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").groupBy("source")
    g = j.agg(F.count("toxic").alias("n"), F.avg("n_chars").alias("c"))
    a = g.where("n < 20").select("source", F.lit("P1").alias("priority"), F.lit("few_labels").alias("reason"))
    return a.unionByName(g.where("c < 2000").select("source", F.lit("P2").alias("priority"), F.lit("short").alias("reason")))
