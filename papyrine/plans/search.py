"""Queries: filters, projections and ranked search."""

from __future__ import annotations


from pyspark.sql import functions as F

from papyrine.functions.text import clip, occurrences, words
from papyrine.operators import search as S
from papyrine.plans.registry import register
from papyrine.sources.tables import PAPERS_SQL, papers, read

P = f"with {PAPERS_SQL} "


def _count(col: str, term: str) -> str:
    return f"cast((length({col}) - length(replace({col}, '{term}', ''))) / {len(term)} as int)"


@register("flt1_conjunctive", P + "select paper_id, title, year from papers where year >= 2000 and year <= 2015 and contains(lower(lang || ' | ' || journal), 'en') and contains(lower(lang || ' | ' || journal), 'src1')")
def flt1(spark, sf):
    f = S.Filters(year_from=2000, year_to=2015, lists={"tags": ["en", "SRC1"]})
    return S.passes(papers(spark, sf), f).select("paper_id", "title", "year")


@register("flt2_list_matches", P + "select paper_id from papers where contains(lower(lang || ' | ' || journal), 'fr | src') ")
def flt2(spark, sf):
    return papers(spark, sf).where(S.list_matches(F.col("tags"), ["FR | src"])).select("paper_id")


@register("flt3_vector_predicates", "select vec_id, label from embeddings where label = 3 and vec_id >= 10 and vec_id <= 400")
def flt3(spark, sf):
    return read(spark, sf, "embeddings").where((F.col("label") == 3) & F.col("vec_id").between(10, 400)).select("vec_id", "label")


@register("flt4_paged_list", P + "select paper_id, title, year from papers where contains(lower(abstract), 'that') and coalesce(year, 0) >= 1995 and coalesce(year, 9999) <= 2010 and (lang = 'en' or journal = 'src2') order by year desc, paper_id limit 20 offset 20")
def flt4(spark, sf):
    rows = papers(spark, sf).where(F.lower("abstract").contains("that") & (F.col("year") >= 1995) & (F.col("year") <= 2010))
    rows = rows.where(F.exists("tags", lambda t: t.isin("en", "src2")))
    return S.page(rows.select("paper_id", "title", "year"), 2, 20, [F.desc("year"), F.col("paper_id")])


@register("flt5_node_search", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_acctbal >= 1000 and contains(c_name, '1') order by c_custkey limit 25")
def flt5(spark, sf):
    c = read(spark, sf, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") >= 1000) & F.col("c_name").contains("1"))
    return c.orderBy("c_custkey").limit(25).select("c_custkey", "c_name")


@register("flt6_confidence", "select event_id, value from events where value >= 0.7")
def flt6(spark, sf):
    return read(spark, sf, "events").where("value >= 0.7").select("event_id", "value")


@register("flt7_filter_around_topk", """with top as (select doc_id, lang, n_chars from documents order by n_chars desc, doc_id limit 50)
select 'after' as mode, doc_id from top where lang = 'en' union all
(select 'before' as mode, doc_id from documents where lang = 'en' order by n_chars desc, doc_id limit 50)""")
def flt7(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    order = [F.desc("n_chars"), F.col("doc_id")]
    after = d.orderBy(*order).limit(50).where("lang = 'en'")
    before = d.where("lang = 'en'").orderBy(*order).limit(50)
    return after.select(F.lit("after").alias("mode"), "doc_id").unionByName(before.select(F.lit("before").alias("mode"), "doc_id"))


@register("flt8_filter_then_topk", "select conv_id, turn from conversations where role = 'user' order by length(text) desc, conv_id, turn limit 30")
def flt8(spark, sf):
    c = read(spark, sf, "conversations").where("role = 'user'")
    return c.orderBy(F.desc(F.length("text")), "conv_id", "turn").limit(30).select("conv_id", "turn")


@register("flt9_cluster_filters", """select c_nationkey, count(*) as n_customers from customer group by c_nationkey
having count(*) >= 3 and sum(case when c_mktsegment = 'BUILDING' then 1 else 0 end) > 0 and avg(c_acctbal) >= 0""")
def flt9(spark, sf):
    by = read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    maps = by.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"), F.sum("n").alias("n_customers"), F.sum("s").alias("s"))
    kept = maps.where((F.col("n_customers") >= 3) & (F.element_at("m", "BUILDING") > 0) & (F.col("s") / F.col("n_customers") >= 0))
    return kept.select("c_nationkey", "n_customers")


@register("flt10_skip_reason", """select reason, count(*) as n from (select case when trim(text) = '' then 'empty' when length(text) < 200 then 'not_ready' when n_chars < 500 then 'low_quality' else 'index' end as reason from documents) group by reason""")
def flt10(spark, sf):
    reason = F.when(F.trim("text") == "", "empty").when(F.length("text") < 200, "not_ready").when(F.col("n_chars") < 500, "low_quality").otherwise("index")
    return read(spark, sf, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("flt11_boilerplate", "select doc_id from documents where regexp_matches(lower(text), 'license|copyright|all rights reserved') and not regexp_matches(lower(text), 'thatin|ononst')")
def flt11(spark, sf):
    low = F.lower("text")
    return read(spark, sf, "documents").where(low.rlike("license|copyright|all rights reserved") & ~low.rlike("thatin|ononst")).select("doc_id")


@register("flt13_entity_validity", "select p_partkey, p_brand from part where length(p_brand) between 2 and 100 and lower(p_brand) not in ('na', 'n/a', 'none', 'unknown') and not regexp_matches(p_brand, '^[0-9.]+$') and p_size > 5")
def flt13(spark, sf):
    b = F.col("p_brand")
    return read(spark, sf, "part").where(F.length(b).between(2, 100) & ~F.lower(b).isin("na", "n/a", "none", "unknown") & ~b.rlike("^[0-9.]+$") & (F.col("p_size") > 5)).select("p_partkey", "p_brand")


NOISE = """select word, frequency, case when length(word) < 3 then 'short' when regexp_matches(word, '^[0-9]+$') then 'numeric' when word in ('the', 'and', 'that', 'with') then 'stopword' when rn > 1 then 'merged' else 'kept' end as status
from (select word, lower(word) as lw, n, sum(n) over (partition by lower(word)) as frequency, row_number() over (partition by lower(word) order by n desc, word) as rn from
(select word, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as word from documents) group by word))"""


@register("flt14_entity_noise", NOISE.replace("sum(n) over", "cast(sum(n) over").replace("(partition by lower(word)) as frequency", "(partition by lower(word)) as bigint) as frequency"))
def flt14(spark, sf):
    from pyspark.sql import Window

    w = read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)).alias("word"))
    n = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy(F.lower("word"))
    n = n.withColumn("frequency", F.sum("n").over(same)).withColumn("rn", F.row_number().over(same.orderBy(F.desc("n"), "word")))
    status = (
        F.when(F.length("word") < 3, "short").when(F.col("word").rlike("^[0-9]+$"), "numeric").when(F.col("word").isin("the", "and", "that", "with"), "stopword").when(F.col("rn") > 1, "merged").otherwise("kept")
    )
    return n.select("word", "frequency", status.alias("status"))


@register("flt15_link_gate", "select l_orderkey, l_linenumber from lineitem where l_returnflag in ('A', 'R') and l_linestatus = 'F' and l_suppkey is not null and l_quantity > 40")
def flt15(spark, sf):
    return read(spark, sf, "lineitem").where("l_returnflag in ('A', 'R') and l_linestatus = 'F' and l_suppkey is not null and l_quantity > 40").select("l_orderkey", "l_linenumber")


@register("flt17_quality_table", "select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id where l.quality is null or l.quality = 0 order by coalesce(l.quality, -1), d.doc_id limit 40")
def flt17(spark, sf):
    d = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.where("quality is null or quality = 0").orderBy(F.coalesce("quality", F.lit(-1)), "doc_id").limit(40)


@register("flt18_asset_search", "select page_id, url from pages where contains(lower(url), '/en/') and contains(lower(html), 'that') order by page_id limit 25")
def flt18(spark, sf):
    p = read(spark, sf, "pages").where(F.lower("url").contains("/en/") & F.lower("html").contains("that"))
    return p.orderBy("page_id").limit(25).select("page_id", "url")


@register("prj1_result_rows", P + "select paper_id, title, coalesce(cast(year as varchar), 'n.d.') as year_label, journal || ' (' || coalesce(cast(year as varchar), 'n.d.') || ')' as citation from papers")
def prj1(spark, sf):
    label = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    return papers(spark, sf).select("paper_id", "title", label.alias("year_label"), F.concat("journal", F.lit(" ("), label, F.lit(")")).alias("citation"))


@register("prj2_light_payload", "select doc_id, substr(text, 1, 500) as text, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') as head from documents")
def prj2(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.substring("text", 1, 500).alias("text"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("head"))


@register("prj3_capped_items", "select doc_id, i - 1 as place, trim(s[i]) as item from (select doc_id, string_split(text, '.') as s, unnest(range(1, 6)) as i from documents) where i <= len(s) and trim(s[i]) <> ''")
def prj3(spark, sf):
    items = F.transform(F.slice(F.split("text", r"\."), 1, 5), lambda x: F.btrim(x, F.lit(" ")))
    e = read(spark, sf, "documents").select("doc_id", F.posexplode(items).alias("place", "item"))
    return e.where("item <> ''").withColumn("place", F.col("place").cast("bigint"))


@register("prj4_pagination", "select count(*) as total, cast(greatest(1, ceil(count(*) / 25.0)) as bigint) as pages, 3 as page from documents")
def prj4(spark, sf):
    d = read(spark, sf, "documents").agg(F.count(F.lit(1)).alias("total"))
    return d.select("total", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / 25.0)).alias("pages"), F.lit(3).alias("page"))


@register("prj5_metadata_text", P + "select paper_id, concat_ws(chr(10), 'Title: ' || title, 'Year: ' || year, 'Journal: ' || journal) as metadata_text from papers")
def prj5(spark, sf):
    lines = [F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Year: "), F.col("year").cast("string")), F.concat(F.lit("Journal: "), "journal")]
    return papers(spark, sf).select("paper_id", F.concat_ws("\n", *lines).alias("metadata_text"))


#: Fields of a paper in search: the lines after the first are its summary, language and journal its tags, what else is known its metadata.
_FIELDS = {"title": "title", "abstract": "abstract", "summary": "coalesce(string_split(abstract, chr(10))[2], '')", "tags": "lang || ' ' || journal", "metadata": "concat_ws(' ', lang, journal, year, doi)"}
_RK2_SCORE = " + ".join(f"{w} * least({_count(f'lower({_FIELDS[c]})', t)}, 5)" for t in ("that", "with") for c, w in S.FIELD_WEIGHTS.items())
RK2 = P + f""", s as (select paper_id, title, year, {_RK2_SCORE} as kw,
abstract, nullif(instr(lower(abstract), 'that'), 0) as a, nullif(instr(lower(abstract), 'with'), 0) as b from papers where contains(lower(lang || ' | ' || journal), 'en'))
select paper_id, title, year, round(cast(kw + 3.0 as double), 4) as score, substr(abstract, greatest(pos - 160, 1), pos + 260 - greatest(pos - 160, 1)) as excerpt from (select *, coalesce(least(a, b), 1) as pos from s where kw > 0)
order by score desc, coalesce(year, 0) desc, title, paper_id limit 50"""


@register("rk2_keyword_score", RK2)
def rk2(spark, sf):
    """All five fields; the list filter reads the tags before they are joined."""
    p = papers(spark, sf).where(S.list_matches(F.col("tags"), ["en"]))
    metadata = F.concat_ws(" ", "lang", "journal", F.col("year").cast("string"), "doi")
    p = p.withColumns({"summary": F.coalesce(F.get(F.split("abstract", "\n"), 1), F.lit("")), "tags": F.concat_ws(" ", "tags"), "metadata": metadata})
    return S.keyword_search(p, ["that", "with"], weights=S.FIELD_WEIGHTS, top_k=50, added=3.0)


@register("rk1_global_order", P + "select paper_id, year, title from papers order by n_chars desc, coalesce(year, 0) desc, title, paper_id limit 30")
def rk1(spark, sf):
    p = papers(spark, sf)
    return p.orderBy(F.desc("n_chars"), F.desc(F.coalesce("year", F.lit(0))), "title", "paper_id").limit(30).select("paper_id", "year", "title")


@register("rk3_filter_score", P + "select paper_id, cast(3.0 + 2.0 as double) as score from papers where year = 2004 and contains(lower(lang || ' | ' || journal), 'src')")
def rk3(spark, sf):
    f = S.Filters(year=2004, lists={"tags": ["src"]})
    return S.passes(papers(spark, sf), f).select("paper_id", S.filter_score(f).alias("score"))


@register("rk4_field_score", P + "select paper_id, cast(5.0 * (case when contains(lang, 'e') then 1 else 0 end + case when contains(journal, 'e') and journal <> lang then 1 else 0 end) as double) as score from papers where contains(lang, 'e') or contains(journal, 'e')")
def rk4(spark, sf):
    return papers(spark, sf).select("paper_id", S.field_score(F.col("tags"), "e").alias("score")).where("score > 0")


@register("rk5_year_score", P + "select paper_id, cast(case when year = 2010 then 2.0 when abs(year - 2010) <= 2 then 0.5 end as double) as score from papers where abs(year - 2010) <= 2")
def rk5(spark, sf):
    near = papers(spark, sf).where(F.abs(F.col("year") - 2010) <= 2)
    return near.select("paper_id", F.when(F.col("year") == 2010, F.lit(2.0)).otherwise(F.lit(0.5)).alias("score"))


@register("rk6_search_modes", P + f""", kw as (select paper_id, cast(3.0 * least({_count('lower(abstract)', 'from')}, 5) as double) as s from papers where lang = 'en'), f as (select paper_id, 5.0 as s from papers where contains(journal, 'src7') and lang = 'en')
select 'keyword' as mode, paper_id, s as score from kw where s > 0 union all select 'field', paper_id, cast(s as double) from f union all
select 'hybrid', coalesce(kw.paper_id, f.paper_id), cast(coalesce(kw.s, 0) + coalesce(f.s, 0) as double) from (select * from kw where s > 0) kw full outer join f on kw.paper_id = f.paper_id""")
def rk6(spark, sf):
    """One pass over the papers gives all three modes."""
    p = papers(spark, sf).where("lang = 'en'")
    scored = p.select("paper_id", S.keyword_score(["from"], {"abstract": 3.0}).alias("k"), S.field_score(F.col("tags"), "src7").alias("f"))
    modes = {"keyword": F.col("k"), "field": F.col("f"), "hybrid": F.col("k") + F.col("f")}
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("score")) for m, v in modes.items()])
    return scored.select("paper_id", F.inline(F.filter(rows, lambda r: r["score"] > 0))).select("mode", "paper_id", "score")


def _asset_sql(w: dict[str, float], query: str) -> str:
    parts = []
    for c, k in w.items():
        t = f"lower(coalesce({c}, ''))"
        single = " + ".join(f"cast(contains({t}, '{x}') as int)" for x in query.split())
        parts.append(f"case when contains({t}, '{query}') then {3 * k} else ({single}) * {0.5 * k} end")
    return " + ".join(parts)


#: Fields of an asset in cross-asset search and their weights.
ASSET_FIELDS = {"title": 2.0, "text": 1.0, "key_finding": 1.5, "table_summary": 1.0, "evidence_type": 0.5, "table_type": 0.5, "node_type": 0.5}
_ASSETS = """assets as (select 'document' as kind, doc_id as id, string_split(text, chr(10))[1] as title, text, string_split(text, chr(10))[-1] as key_finding, '' as table_summary, lang as evidence_type, '' as table_type, 'paper' as node_type from documents
union all select 'page', page_id, regexp_extract(html, '<title>([^<]*)</title>', 1), html, '', '', '', '', 'web' from pages union all select 'part', p_partkey, p_name, '', '', p_brand || ' ' || p_type, '', p_type, 'table' from part)"""


@register("rk11_cross_asset_keyword", f"with {_ASSETS} select kind, id, cast({_asset_sql(ASSET_FIELDS, 'that with')} as double) as score from assets order by score desc, kind, id limit 40")
def rk11(spark, sf):
    """Documents, pages and parts are assets; conversations would be supplementary chunks, which this search passes over."""
    none = F.lit("")
    lines = F.split("text", "\n")
    d = read(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.get(lines, 0).alias("title"), "text", F.element_at(lines, -1).alias("key_finding"), none.alias("table_summary"), F.col("lang").alias("evidence_type"), none.alias("table_type"), F.lit("paper").alias("node_type"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    p = read(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), title.alias("title"), F.col("html").alias("text"), *[none.alias(c) for c in ("key_finding", "table_summary", "evidence_type", "table_type")], F.lit("web").alias("node_type"))
    t = read(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), none.alias("text"), none.alias("key_finding"), F.concat_ws(" ", "p_brand", "p_type").alias("table_summary"), none.alias("evidence_type"), F.col("p_type").alias("table_type"), F.lit("table").alias("node_type"))
    scored = d.unionByName(p).unionByName(t).select("kind", "id", S.asset_keyword_score("that with", ASSET_FIELDS).alias("score"))
    return scored.orderBy(F.desc("score"), "kind", "id").limit(40)


@register("rk12_constant_score", "select n_nationkey, n_name, cast(0.7 as double) as score from nation where contains(n_name, 'A')")
def rk12(spark, sf):
    return read(spark, sf, "nation").where(F.col("n_name").contains("A")).select("n_nationkey", "n_name", F.lit(0.7).alias("score"))


@register("rk15_final_rank", """select p_partkey, round(p_retailprice / 1000 + least(0.05 * n, 0.15) + 0.1 * (p_size / 50.0) + least(0.03 * k, 0.15), 6) as score from part join
(select l_partkey, count(distinct l_suppkey) as n, count(distinct l_returnflag) as k from lineitem group by l_partkey) on l_partkey = p_partkey order by score desc, p_partkey limit 50""")
def rk15(spark, sf):
    links = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"), F.count_distinct("l_returnflag").alias("k"))
    j = read(spark, sf, "part").join(links, F.col("p_partkey") == F.col("l_partkey"))
    score = F.round(S.final_rank(F.col("p_retailprice") / 1000, F.col("n"), F.col("p_size") / 50.0, F.col("k")), 6)
    return j.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


@register("rk16_paper_lookup_score", P + """select paper_id, cast(case when lower(title) = 'the' then 100 when contains(lower(title), 'the') then 50 when hits > 0 then 20 + 10 * hits else 5 * raw end + 20 * cast(contains(doi, '12') as int) as double) as score from
(select *, len(list_intersect(regexp_extract_all(lower(title), '[a-z]+'), ['that', 'with', 'from'])) as hits, cast(contains(lower(abstract), 'that') as int) as raw from papers) where score > 0""")
def rk16(spark, sf):
    hits = F.size(F.array_intersect(words(F.col("title")), F.array(F.lit("that"), F.lit("with"), F.lit("from"))))
    low = F.lower("title")
    raw = F.lower("abstract").contains("that").cast("int")
    score = F.when(low == "the", 100).when(low.contains("the"), 50).when(hits > 0, 20 + 10 * hits).otherwise(5 * raw)
    return papers(spark, sf).select("paper_id", (score + 20 * F.col("doi").contains("12").cast("int")).cast("double").alias("score")).where("score > 0")


@register("rk23_topic_relevance", """select doc_id, round(cast(least(1.0, greatest(0.0, 0.1 * a + 0.05 * b)) as double), 4) as relevance, case when least(1.0, 0.1 * a + 0.05 * b) >= 0.65 then 'high' when least(1.0, 0.1 * a + 0.05 * b) >= 0.35 then 'medium' else 'low' end as label
from (select doc_id, """ + _count("lower(text)", "that") + " as a, " + _count("lower(text)", "with") + " as b from documents)")
def rk23(spark, sf):
    low = F.lower("text")
    r = clip(0.1 * occurrences(low, "that") + 0.05 * occurrences(low, "with"))
    label = F.when(r >= 0.65, "high").when(r >= 0.35, "medium").otherwise("low")
    return read(spark, sf, "documents").select("doc_id", F.round(r, 4).alias("relevance"), label.alias("label"))


@register("rk24_hot_papers", P + "select paper_id, round(0.35 * least(greatest(year - 2000, 0) / 30.0, 1) + 0.25 * 0.5 + 0.40 * least(n_chars / 15000.0, 1), 6) as hotness from papers where year is not null order by hotness desc, paper_id limit 10")
def rk24(spark, sf):
    h = 0.35 * F.least(F.greatest(F.col("year") - 2000, F.lit(0)) / 30.0, F.lit(1.0)) + 0.125 + 0.40 * F.least(F.col("n_chars") / 15000.0, F.lit(1.0))
    return papers(spark, sf).where("year is not null").select("paper_id", F.round(h, 6).alias("hotness")).orderBy(F.desc("hotness"), "paper_id").limit(10)


@register("rk28_entity_search_order", "select p_partkey, p_name, case when lower(p_name) = 'small ring' then 0 else 1 end as kind from part where contains(lower(p_name), 'ring') order by kind, p_partkey limit 30")
def rk28(spark, sf):
    kind = F.when(F.lower("p_name") == "small ring", 0).otherwise(1)
    return read(spark, sf, "part").where(F.lower("p_name").contains("ring")).select("p_partkey", "p_name", kind.alias("kind")).orderBy("kind", "p_partkey").limit(30)


@register("rk32_sorted_list", P + "select paper_id, title, year from papers order by year asc nulls last, title, paper_id limit 40")
def rk32(spark, sf):
    return papers(spark, sf).orderBy(F.asc_nulls_last("year"), "title", "paper_id").limit(40).select("paper_id", "title", "year")
