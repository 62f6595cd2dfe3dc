"""Queries: aggregations, rollups, windows and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions.text import decimal_comma, words
from papyrine.operators import aggregates as A
from papyrine.operators import representatives as D
from papyrine.operators import vectors as V
from papyrine.plans.registry import register
from papyrine.sources.tables import PAPERS_SQL, papers, read, spread_texts

P = f"with {PAPERS_SQL} "

def rows_n():
    """Number of rows; made when a query is built, since columns need a session."""
    return F.count(F.lit(1))


@register("ag1_library_stats", P + "select 'tag' as kind, cast(lang as varchar) as key, count(*) as n from papers group by lang union all select 'year', cast(year as varchar), count(*) from papers where year is not null group by year union all select 'papers', 'all', count(*) from papers")
def ag1(spark, sf):
    p = papers(spark, sf)
    tags = p.groupBy(F.col("lang").alias("key")).agg(rows_n().alias("n")).select(F.lit("tag").alias("kind"), "key", "n")
    years = p.where("year is not null").groupBy(F.col("year").cast("string").alias("key")).agg(rows_n().alias("n")).select(F.lit("year").alias("kind"), "key", "n")
    return tags.unionByName(years).unionByName(p.agg(rows_n().alias("n")).select(F.lit("papers").alias("kind"), F.lit("all").alias("key"), "n"))


@register("ag2_year_distribution", P + "select year, count(*) as n, count(*) - lag(count(*)) over (order by year) as change from papers where year between 1800 and 2020 group by year")
def ag2(spark, sf):
    by = papers(spark, sf).where("year between 1800 and 2020").groupBy("year").agg(rows_n().alias("n"))
    return by.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("year")))  # one row per year


@register("ag3_graph_stats", "select 'segment' as kind, c_mktsegment as key, count(*) as n, count(distinct c_nationkey) as owners from customer group by 2 union all select 'status', o_orderstatus, count(*), count(distinct o_custkey) from orders group by 2")
def ag3(spark, sf):
    c = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(rows_n().alias("n"), F.count_distinct("c_nationkey").alias("owners"))
    o = read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("key")).agg(rows_n().alias("n"), F.count_distinct("o_custkey").alias("owners"))
    return c.select(F.lit("segment").alias("kind"), "*").unionByName(o.select(F.lit("status").alias("kind"), "*"))


@register("ag4_cluster_profile", """select p_brand, count(*) as members, round(avg(case when p_size <> 0 then p_size end), 6) as mean_size, min(p_size) as low, max(p_size) as high,
case when count(distinct p_type) >= 3 then 'strong' when count(distinct p_type) = 2 then 'multi' else 'single' end as support, string_agg(distinct p_type, ',' order by p_type) as types from part group by p_brand""")
def ag4(spark, sf):
    kinds = F.count_distinct("p_type")
    support = F.when(kinds >= 3, "strong").when(kinds == 2, "multi").otherwise("single")
    return read(spark, sf, "part").groupBy("p_brand").agg(
        rows_n().alias("members"), F.round(A.mean_of_truthy(F.col("p_size")), 6).alias("mean_size"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), support.alias("support"), A.joined_set(F.col("p_type")).alias("types")
    )


@register("ag5_fusion_summary", "with c as (select c_nationkey, count(*) as n from customer group by 1) select count(*) as clusters, round(avg(n), 6) as mean_size, max(n) as largest, cast(count(case when n >= 60 then 1 end) as bigint) as strong from c")
def ag5(spark, sf):
    c = read(spark, sf, "customer").groupBy("c_nationkey").agg(rows_n().alias("n"))
    return c.agg(rows_n().alias("clusters"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("largest"), F.count_if(F.col("n") >= 60).alias("strong"))


@register("ag6_risk_map", "select o_custkey, sum(cast(o_orderstatus = 'F' as bigint))::bigint as f, sum(cast(o_orderstatus = 'O' as bigint))::bigint as o, sum(cast(o_orderstatus = 'P' as bigint))::bigint as p, round(avg(o_totalprice), 4) as mean_total from orders group by o_custkey")
def ag6(spark, sf):
    by = read(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(rows_n().alias("n"), F.sum("o_totalprice").alias("t"))
    m = by.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"), F.round(F.sum("t") / F.sum("n"), 4).alias("mean_total"))
    return m.select("o_custkey", *[F.coalesce(F.element_at("m", s.upper()), F.lit(0)).alias(s) for s in "fop"], "mean_total")


@register("ag7_quality_decision", "select lang, round(avg(quality), 6) as q, case when avg(quality) >= 0.9 then 'accept' when avg(quality) >= 0.5 then 'review' else 'reject' end as decision from documents join labels using (doc_id) group by lang")
def ag7(spark, sf):
    q = F.avg("quality")
    j = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.round(q, 6).alias("q"), F.when(q >= 0.9, "accept").when(q >= 0.5, "review").otherwise("reject").alias("decision"))


@register("ag8_corpus_quality", "select source, count(l.doc_id) as labelled, coalesce(cast(sum(toxic) as bigint), 0) as toxic, round(avg(quality), 6) as quality from documents d left join labels l using (doc_id) group by source")
def ag8(spark, sf):
    j = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id", "left").groupBy("source")
    return j.agg(F.count("quality").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("toxic"), F.round(F.avg("quality"), 6).alias("quality"))


@register("ag9_weighted_quality", """with a as (select source, avg(quality) as g from documents join labels using (doc_id) where lang = 'en' group by source), b as (select source, avg(1 - toxic) as h from documents join labels using (doc_id) where lang <> 'en' group by source)
select coalesce(a.source, b.source) as source, round(0.4 * coalesce(g, 1.0) + 0.6 * coalesce(h, 1.0), 6) as score from a full outer join b on a.source = b.source""")
def ag9(spark, sf):
    j = read(spark, sf, "documents").select("doc_id", "lang", "source").join(read(spark, sf, "labels"), "doc_id").groupBy("source")
    g, h = F.avg(F.when(F.col("lang") == "en", F.col("quality"))), F.avg(F.when(F.col("lang") != "en", 1 - F.col("toxic")))
    return j.agg(F.round(0.4 * F.coalesce(g, F.lit(1.0)) + 0.6 * F.coalesce(h, F.lit(1.0)), 6).alias("score"))


@register("ag10_category_summary", "select p_type, count(*) as n, round(avg(p_retailprice), 4) as mean, min(p_retailprice) as low, max(p_retailprice) as high from part group by p_type")
def ag10(spark, sf):
    c = F.col("p_retailprice")
    return read(spark, sf, "part").groupBy("p_type").agg(rows_n().alias("n"), F.round(F.avg(c), 4).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"))


@register("ag11_usage_grouping_sets", "select event_type, cast(ts as date) as day, count(*) as n, round(sum(value), 4) as total from events where ts >= timestamp '2024-01-10' group by grouping sets ((event_type), (cast(ts as date)), (event_type, cast(ts as date)), ())")
def ag11(spark, sf):
    e = read(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("event_type", F.to_date("ts").alias("day"), "value")
    e.createOrReplaceTempView("__usage")
    return spark.sql("select event_type, day, count(*) as n, round(sum(value), 4) as total from __usage group by grouping sets ((event_type), (day), (event_type, day), ())")


@register("ag12_direction_summary", "select l_suppkey, count(case when l_discount > 0.05 then 1 end) as up, count(case when l_discount < 0.02 then 1 end) as down, count(case when l_discount between 0.02 and 0.05 then 1 end) as mixed from lineitem group by l_suppkey")
def ag12(spark, sf):
    d = F.col("l_discount")
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(*A.count_if_map({"up": d > 0.05, "down": d < 0.02, "mixed": d.between(0.02, 0.05)}))


@register("ag13_value_columns", "select k as column_name, count(*) as n, count(try_cast(v as double)) as numeric_n from (select unnest(['p_name', 'p_size', 'p_brand']) as k, unnest([p_name, cast(p_size as varchar), p_brand]) as v from part) group by k")
def ag13(spark, sf):
    m = F.create_map(F.lit("p_name"), "p_name", F.lit("p_size"), F.col("p_size").cast("string"), F.lit("p_brand"), "p_brand")
    e = read(spark, sf, "part").select(F.explode(m).alias("column_name", "v"))
    return e.groupBy("column_name").agg(rows_n().alias("n"), F.count(decimal_comma(F.col("v"))).alias("numeric_n"))


@register("ag14_distinct_counts", "select count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem")
def ag14(spark, sf):
    return read(spark, sf, "lineitem").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@register("ag15_dedup_merge", """select l_partkey, l_returnflag, count(*) as links, string_agg(distinct l_linestatus, ',' order by l_linestatus) as items, array_to_string(list_slice(list_sort(list_distinct(list(l_suppkey))), 1, 5), ',') as first_values from lineitem group by l_partkey, l_returnflag""")
def ag15(spark, sf):
    return A.dedup_merge(read(spark, sf, "lineitem"), ["l_partkey", "l_returnflag"], "l_linestatus", "l_suppkey")


@register("ag16_index_stats", "with l as (select l_partkey, count(distinct l_suppkey) as n from lineitem group by 1) select count(*) as entities, max(n) as most, count(case when n > 1 then 1 end) as multi from l")
def ag16(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return l.agg(rows_n().alias("entities"), F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("multi"))


#: Document ids that one row of the inverted index spans.
POSTINGS_BLOCK = 65_536


@register("ag17_inverted_index", "select w as word, doc_id // 65536 as block, count(*) as postings, string_agg(cast(doc_id as varchar), ',' order by doc_id) as docs from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) as w from documents where doc_id is not null) group by 1, 2")
def ag17(spark, sf):
    """Postings of all words of all documents, in blocks of document ids so that no list grows with the table."""
    d = read(spark, sf, "documents").where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(words(F.col("text"), 8))).alias("word"))
    ids = d.groupBy("word", F.floor(F.col("doc_id") / POSTINGS_BLOCK).alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    return ids.select("word", "block", F.size("ids").cast("bigint").alias("postings"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("docs"))


@register("ag18_type_counts", "select event_type, count(*) as n from events group by event_type")
def ag18(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(rows_n().alias("n"))


@register("ag19_numeric_profile", " union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(min({c}), 6) as low, round(max({c}), 6) as high, round(avg({c}), 4) as mean from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def ag19(spark, sf):
    return A.numeric_profile(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("ag20_top_types", "select p_type, n from (select p_type, count(*) as n from part group by 1) order by n desc, p_type limit 5")
def ag20(spark, sf):
    return A.top_counts(read(spark, sf, "part"), F.col("p_type"), 5, "p_type")


@register("ag21_facet_distribution", "select facet, count(*) as n, round(count(*) / cast((select count(*) from documents) as double), 6) as ratio from (select unnest([lang, source]) as facet from documents) group by facet")
def ag21(spark, sf):
    d = read(spark, sf, "documents")
    total = d.agg(rows_n().alias("t"))
    by = d.select(F.explode(F.array("lang", "source")).alias("facet")).groupBy("facet").agg(rows_n().alias("n"))
    return by.join(F.broadcast(total)).select("facet", "n", F.round(F.col("n") / F.col("t"), 6).alias("ratio"))  # one row


@register("ag22_signal_totals", "select role, sum(len(regexp_extract_all(lower(text), 'that|with')))::bigint as signals from conversations group by role")
def ag22(spark, sf):
    return read(spark, sf, "conversations").groupBy("role").agg(F.sum(F.regexp_count(F.lower("text"), F.lit("that|with"))).alias("signals"))


@register("ag23_emerging_facets", P + """, m as (select lang, max(year) as y from papers group by lang), r as (select p.lang, journal, count(*) as n, count(case when year >= y - 5 then 1 end) as recent from papers p join m on m.lang = p.lang group by 1, 2)
select lang, journal, round(recent / cast(n as double), 6) as recent_ratio, case when recent / cast(n as double) >= 0.4 then 'emerging' when recent / cast(n as double) >= 0.2 then 'active' else 'stable' end as label from r""")
def ag23(spark, sf):
    p = papers(spark, sf).select("lang", "journal", "year")
    latest = p.groupBy("lang").agg(F.max("year").alias("y"))
    ratio = F.count_if(F.col("year") >= F.col("y") - 5) / rows_n()
    by = p.join(latest, "lang").groupBy("lang", "journal").agg(ratio.alias("x"))
    label = F.when(F.col("x") >= 0.4, "emerging").when(F.col("x") >= 0.2, "active").otherwise("stable")
    return by.select("lang", "journal", F.round("x", 6).alias("recent_ratio"), label.alias("label"))


@register("ag24_growth_score", P + """, a as (select journal, count(*) as n, count(case when year >= 2015 then 1 end) as r, max(year) as y, count(case when n_chars > 2000 then 1 end) as e from papers group by journal)
select journal, round(g, 6) as growth, case when g >= 0.65 then 'hot' when g >= 0.45 then 'active' when g >= 0.25 then 'stable' else 'cold' end as label from (select journal, 0.45 * r / n + 0.25 * least(r / cast(n as double), 1) + 0.20 * least(e / cast(n as double), 1) + 0.10 * least(y / 2030.0, 1) as g from a)""")
def ag24(spark, sf):
    a = papers(spark, sf).groupBy("journal").agg(rows_n().alias("n"), F.count_if(F.col("year") >= 2015).alias("r"), F.max("year").alias("y"), F.count_if(F.col("n_chars") > 2000).alias("e"))
    share = lambda x: F.least(x / F.col("n"), F.lit(1.0))
    g = 0.45 * F.col("r") / F.col("n") + 0.25 * share(F.col("r")) + 0.20 * share(F.col("e")) + 0.10 * F.least(F.col("y") / 2030, F.lit(1.0))
    label = F.when(F.col("g") >= 0.65, "hot").when(F.col("g") >= 0.45, "active").when(F.col("g") >= 0.25, "stable").otherwise("cold")
    return a.withColumn("g", g).select("journal", F.round("g", 6).alias("growth"), label.alias("label"))


@register("ag25_report_rollup", "select lang, source, count(*) as n, round(avg(n_chars), 4) as mean_chars from documents group by rollup (lang, source)")
def ag25(spark, sf):
    return read(spark, sf, "documents").rollup("lang", "source").agg(rows_n().alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@register("ag25b_cube", "select c_mktsegment, n_regionkey, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on n_nationkey = c_nationkey group by cube (c_mktsegment, n_regionkey)")
def ag25b(spark, sf):
    j = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.cube("c_mktsegment", "n_regionkey").agg(rows_n().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("ag26_mean_of_ratios", "select round(avg(r), 6) as mean_ratio, round(max(r), 6) as top_ratio from (select source, count(case when n_chars > 1500 then 1 end) / cast(count(*) as double) as r from documents group by source)")
def ag26(spark, sf):
    r = read(spark, sf, "documents").groupBy("source").agg((F.count_if(F.col("n_chars") > 1500) / rows_n()).alias("r"))
    return r.agg(F.round(F.avg("r"), 6).alias("mean_ratio"), F.round(F.max("r"), 6).alias("top_ratio"))


@register("ag27_quality_per_group", "select source, round(avg(n_chars), 4) as mean, min(n_chars) as low, max(n_chars) as high, round(count(case when n_chars >= 500 then 1 end) / cast(count(*) as double), 6) as ready from documents group by source")
def ag27(spark, sf):
    c = F.col("n_chars")
    return read(spark, sf, "documents").groupBy("source").agg(F.round(F.avg(c), 4).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.count_if(c >= 500) / rows_n(), 6).alias("ready"))


@register("ag28_claim_quality", "select conv_id, round(avg(length(text)), 6) as mean_length, count(case when length(text) < 50 then 1 end) as short from conversations group by conv_id")
def ag28(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.count_if(F.length("text") < 50).alias("short"))


@register("ag29_stage_completeness", """with s as (select doc_id, length(text) > 0 as a, n_chars > 500 as b, lang = 'en' as c, doc_id in (select doc_id from labels) as d from documents)
select stage, count(case when ok then 1 end) as done, count(*) as total, count(case when ok then 1 end) / cast(count(*) as double) > 0.3 as fine from (select unnest(['text', 'long', 'english', 'labelled']) as stage, unnest([a, b, c, d]) as ok from s) group by stage""")
def ag29(spark, sf):
    l = read(spark, sf, "labels").select("doc_id", F.lit(True).alias("l")).distinct()
    d = read(spark, sf, "documents").join(l, "doc_id", "left")
    flags = {"text": F.length("text") > 0, "long": F.col("n_chars") > 500, "english": F.col("lang") == "en", "labelled": F.col("l").isNotNull()}
    long = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), v.alias("ok")) for k, v in flags.items()])).alias("x")).select("x.*")
    done = F.count_if("ok")
    return long.groupBy("stage").agg(done.alias("done"), rows_n().alias("total"), (done / rows_n() > 0.3).alias("fine"))


@register("ag30_completion", "select doc_id, (cast(length(text) > 100 as int) + cast(lang = 'en' as int) + cast(n_chars > 1000 as int) + cast(doc_id in (select doc_id from labels) as int)) / 4.0::double as completion from documents")
def ag30(spark, sf):
    l = read(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    d = read(spark, sf, "documents").join(l, "doc_id", "left")
    flags = (F.length("text") > 100).cast("int") + (F.col("lang") == "en").cast("int") + (F.col("n_chars") > 1000).cast("int") + F.coalesce("l", F.lit(0))
    return d.select("doc_id", (flags / 4.0).alias("completion"))


@register("ag31_retag_stats", "select c_mktsegment, count(case when c_acctbal > 5000 and c_nationkey < 12 then 1 end) as unchanged, count(case when c_acctbal > 5000 and c_nationkey >= 12 then 1 end) as added, count(case when c_acctbal <= 5000 and c_nationkey < 12 then 1 end) as removed from customer group by c_mktsegment")
def ag31(spark, sf):
    new, old = F.col("c_acctbal") > 5000, F.col("c_nationkey") < 12
    return read(spark, sf, "customer").groupBy("c_mktsegment").agg(*A.count_if_map({"unchanged": new & old, "added": new & ~old, "removed": ~new & old}))


@register("ag32_keyword_top", "select word, n from (select w as word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as w from documents) where w not in ('that', 'with', 'this', 'from') group by w) order by n desc, word limit 30")
def ag32(spark, sf):
    w = read(spark, sf, "documents").select(F.explode(words(F.col("text"), 4)).alias("word"))
    return A.top_counts(w.where(~F.col("word").isin("that", "with", "this", "from")), F.col("word"), 30, "word")


@register("ag33_bigrams", "select bigram, n from (select w[i] || ' ' || w[i + 1] as bigram, count(*) as n from (select w, unnest(range(1, len(w))) as i from (select regexp_extract_all(lower(text), '[a-z]{3,}') as w from documents)) group by 1) order by n desc, bigram limit 20")
def ag33(spark, sf):
    # a split of a compressed file holds many texts, whose different pairs fill one task's table
    d = spread_texts(read(spark, sf, "documents").select("text")).select(words(F.col("text"), 3).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return A.top_counts(d.select(F.explode(pairs).alias("bigram")).where("bigram is not null"), F.col("bigram"), 20, "bigram")


@register("ag34_pivot_registry", "select c_nationkey, count(case when c_mktsegment = 'AUTOMOBILE' then 1 end) as automobile, count(case when c_mktsegment = 'BUILDING' then 1 end) as building, count(case when c_mktsegment = 'MACHINERY' then 1 end) as machinery from customer group by c_nationkey")
def ag34(spark, sf):
    names = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
    p = read(spark, sf, "customer").groupBy("c_nationkey").pivot("c_mktsegment", names).agg(rows_n())
    return p.select("c_nationkey", *[F.coalesce(n, F.lit(0)).alias(n.lower()) for n in names])


@register("ag35_link_counts", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def ag35(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(rows_n().alias("n"))


@register("ag36_summary_counters", "select lang, count(*) as docs, count(case when contains(text, 'Table') or contains(text, 'Fig') then 1 end) as with_refs, sum(n_chars)::bigint as chars from documents group by lang")
def ag36(spark, sf):
    refs = F.contains("text", F.lit("Table")) | F.contains("text", F.lit("Fig"))
    return read(spark, sf, "documents").groupBy("lang").agg(rows_n().alias("docs"), F.count_if(refs).alias("with_refs"), F.sum("n_chars").alias("chars"))


@register("ag37_eval_metrics", "select source, count(*) as hits, count(distinct lang) as langs, round(count(case when lang = 'en' then 1 end) / cast(count(*) as double), 6) as balance from documents group by source")
def ag37(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(rows_n().alias("hits"), F.count_distinct("lang").alias("langs"), F.round(F.count_if(F.col("lang") == "en") / rows_n(), 6).alias("balance"))


@register("ag38_distinct_exact", "select count(distinct user_id) as users, count(distinct event_type) as types from events")
def ag38(spark, sf):
    return read(spark, sf, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


@register("ag38b_distinct_approx")
def ag38b(spark, sf):
    """Distinct users by a sketch whose size does not grow with the data."""
    return read(spark, sf, "events").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.hll_sketch_estimate(F.hll_sketch_agg("event_type")).alias("types"))


@register("rk18_bucket_diversity", P + """, v as (select vec_id as paper_id, embedding::double[] as v from embeddings), x as (select p.paper_id, journal, year, v from papers p left join v using (paper_id)),
s as (select journal, arg_min(v, paper_id) as seed from x where v is not null group by journal),
r as (select paper_id, x.journal, year, coalesce(0.4 * list_cosine_similarity(v, seed), 0) + 0.15 + case when coalesce(year, 0) <> 0 then 0.05 else 0 end as score, coalesce(year // 5, 0) as bucket from x left join s using (journal)),
b as (select *, row_number() over (partition by journal, bucket order by score desc, paper_id) as rb, row_number() over (partition by journal order by score desc, paper_id) as ra from r),
c as (select *, case when rb <= 2 then 0 else 1 end as spread, count(*) filter (rb <= 2) over (partition by journal) as n from b),
d as (select *, row_number() over (partition by journal order by spread, score desc, paper_id) as place from c where spread = 0 or n < 3)
select journal, paper_id, year, round(score, 6) as score, place::int as place from d where place <= 5""")
def rk18(spark, sf):
    """Representatives of each journal; its seed is the first paper that has a vector."""
    e = V.as_vectors(read(spark, sf, "embeddings")).select(F.col("vec_id").alias("paper_id"), "v")
    p = papers(spark, sf).select("paper_id", "journal", "year", "tags").join(e, "paper_id", "left")
    seeds = p.where("v is not null").groupBy("journal").agg(F.min_by("v", "paper_id").alias("seed"))
    rated = p.join(seeds, "journal", "left").withColumn("score", D.score(1 - V.cosine_distance(F.col("v"), F.col("seed")), F.col("tags"), F.col("year")))
    return D.representatives(rated.select("journal", "paper_id", "year", "score"), "journal", "paper_id").select("journal", "paper_id", "year", F.round("score", 6).alias("score"), "place")


@register("rk19_representative", "select p_brand, arg_max(p_partkey, {'s': p_retailprice * 0.4 + p_size * 0.4, 'k': p_partkey}) as representative from part group by p_brand")
def rk19(spark, sf):
    score = F.struct((F.col("p_retailprice") * 0.4 + F.col("p_size") * 0.4).alias("s"), F.col("p_partkey").alias("k"))
    return read(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_partkey", score).alias("representative"))


@register("rk20_representative_lowest", "select s_nationkey, arg_min(s_suppkey, {'s': -round(0.35 * s_acctbal, 4), 'k': s_suppkey}) as representative from supplier group by s_nationkey")
def rk20(spark, sf):
    score = F.struct((-F.round(0.35 * F.col("s_acctbal"), 4)).alias("s"), F.col("s_suppkey").alias("k"))
    return read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", score).alias("representative"))


OPP = """with c as (select c_nationkey, count(*) as papers, avg(greatest(c_acctbal, 0)) / 10000 as confidence, count(distinct c_mktsegment) as kinds from customer group by 1),
o as (select c_nationkey, count(*) as n_hyp, count(case when o_orderstatus = 'F' then 1 end) as low, count(case when o_orderstatus = 'P' then 1 end) as med, count(case when o_orderstatus = 'O' then 1 end) as high, avg(case when o_totalprice > 200000 then 0.8 else 0.4 end) as hyp_quality from customer join orders on o_custkey = c_custkey group by 1),
a as (select c.c_nationkey, papers, confidence, papers as gaps, case when kinds >= 3 then 'strong' when kinds = 2 then 'multi' else 'single' end as support, coalesce(n_hyp, 0) as n_hyp, coalesce(low, 0) as low, coalesce(med, 0) as med, coalesce(high, 0) as high, hyp_quality, 1 as has_pred, 0 as has_exp, 0.9 as novelty_type, 0.85 as impact_type, papers * 3 as why_length, 2 as overclaims from c left join o on c.c_nationkey = o.c_nationkey),
s as (select *, greatest(0, least(1, 0.35 * least(1, papers / 15.0) + 0.25 * confidence + 0.15 * coalesce(hyp_quality, 0.5) + least(0.15, 0.005 * gaps) + case support when 'strong' then 0.15 when 'multi' then 0.08 else 0 end)) as evidence,
case when n_hyp = 0 then 0.3 else greatest(0, least(1, 0.5 * (low / cast(n_hyp as double) + 0.6 * med / n_hyp + 0.15 * high / n_hyp) + 0.1 * has_pred + 0.1 * has_exp + 0.2)) end as feasibility,
greatest(0, least(1, 0.7 * novelty_type + least(0.3, 0.02 * papers))) as novelty,
greatest(0, least(1, 0.25 * least(1, papers / 12.0) + 0.3 * case support when 'strong' then 1 when 'multi' then 0.7 else 0.3 end + 0.15 * case when why_length = 0 then 0.3 else least(1, why_length / 200.0) end + 0.3 * impact_type)) as impact,
0.4 * confidence + 0.6 * coalesce(hyp_quality, 0.5) as certainty, case when n_hyp = 0 then 0.15 else least(0.5, 0.4 * high / cast(n_hyp as double) + least(0.15, 0.03 * overclaims)) end as risk from a),
t as (select *, 0.30 * evidence + 0.25 * feasibility + 0.20 * novelty + 0.15 * impact + 0.10 * certainty - 0.10 * risk as total from s) """


def _opportunities(spark, sf):
    c = read(spark, sf, "customer")
    base = c.groupBy("c_nationkey").agg(rows_n().alias("papers"), (F.avg(F.greatest("c_acctbal", F.lit(0))) / 10000).alias("confidence"), F.count_distinct("c_mktsegment").alias("kinds"))
    st = F.col("o_orderstatus")
    o = c.join(read(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey")
    o = o.agg(rows_n().alias("n_hyp"), *A.count_if_map({"low": st == "F", "med": st == "P", "high": st == "O"}), F.avg(F.when(F.col("o_totalprice") > 200000, 0.8).otherwise(0.4)).alias("hyp_quality"))
    j = base.join(o, "c_nationkey", "left").fillna(0, ["n_hyp", "low", "med", "high"])
    support = F.when(F.col("kinds") >= 3, "strong").when(F.col("kinds") == 2, "multi").otherwise("single")
    j = j.withColumns({"gaps": F.col("papers"), "support": support, "has_pred": F.lit(1), "has_exp": F.lit(0), "novelty_type": F.lit(0.9), "impact_type": F.lit(0.85), "why_length": F.col("papers") * 3, "overclaims": F.lit(2)})
    return j.withColumns(A.opportunity_scores()).withColumn("total", A.opportunity_total())


@register("rk21_opportunity_scores", OPP + "select c_nationkey, round(evidence, 3) as evidence, round(feasibility, 3) as feasibility, round(cast(novelty as double), 3) as novelty, round(cast(impact as double), 3) as impact, round(certainty, 3) as certainty, round(risk, 3) as risk, round(total, 3) as total, dense_rank() over (order by round(total, 9) desc) as rank from t")
def rk21(spark, sf):
    o = _opportunities(spark, sf)
    rank = F.dense_rank().over(Window.orderBy(F.desc(F.round("total", 9)))).cast("bigint")  # one row per cluster
    return o.select("c_nationkey", *[F.round(c, 3).alias(c) for c in ("evidence", "feasibility", "novelty", "impact", "certainty", "risk", "total")], rank.alias("rank"))


@register("rk22_opportunity_category", OPP + """select c_nationkey, case when support = 'multi' then 'mechanistic' when total >= 0.7 and feasibility >= 0.7 and papers >= 2 then 'ready' when evidence >= 0.6 and novelty >= 0.7 then 'novel' when novelty >= 0.8 and evidence < 0.5 then 'speculative' else 'open_question' end as category,
case when high / cast(greatest(n_hyp, 1) as double) > 0.3 then 'high' when med / cast(greatest(n_hyp, 1) as double) > 0.5 then 'medium' else 'low' end as risk_level from t""")
def rk22(spark, sf):
    c = F.col
    category = F.when(c("support") == "multi", "mechanistic").when((c("total") >= 0.7) & (c("feasibility") >= 0.7) & (c("papers") >= 2), "ready").when((c("evidence") >= 0.6) & (c("novelty") >= 0.7), "novel").when((c("novelty") >= 0.8) & (c("evidence") < 0.5), "speculative").otherwise("open_question")
    n = F.greatest("n_hyp", F.lit(1))
    level = F.when(c("high") / n > 0.3, "high").when(c("med") / n > 0.5, "medium").otherwise("low")
    return _opportunities(spark, sf).select("c_nationkey", category.alias("category"), level.alias("risk_level"))


@register("rk25_facet_classification", """with s as (select * from (values ('that', 1.0), ('with', 2.0), ('from', 1.0)) v(signal, w)), h as (select doc_id, signal, least(1.0, 0.08 * w * len(regexp_extract_all(lower(text), signal))) as score from documents cross join s)
select doc_id, signal, round(cast(score as double), 6) as score, r from (select *, row_number() over (partition by doc_id order by score desc, signal) as r from h where score > 0.02) where r <= 2""")
def rk25(spark, sf):
    signals = {"that": 1.0, "with": 2.0, "from": 1.0}
    low = F.lower("text")
    scores = F.array(*[F.struct(F.lit(s).alias("signal"), F.least(F.lit(1.0), 0.08 * w * F.regexp_count(low, F.lit(s))).alias("score")) for s, w in signals.items()])
    h = read(spark, sf, "documents").select("doc_id", F.inline(scores)).where("score > 0.02")
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "signal")).cast("bigint")
    return h.withColumn("r", r).where("r <= 2").withColumn("score", F.round("score", 6))


@register("rk26_top_positive_negative", "select 'top' as side, c_custkey, c_acctbal from (select * from customer where c_acctbal > 0 order by c_acctbal desc, c_custkey limit 5) union all select 'bottom', c_custkey, c_acctbal from (select * from customer where c_acctbal < 0 order by c_acctbal, c_custkey limit 5)")
def rk26(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    top = c.where("c_acctbal > 0").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5)
    low = c.where("c_acctbal < 0").orderBy("c_acctbal", "c_custkey").limit(5)
    return top.select(F.lit("top").alias("side"), "*").unionByName(low.select(F.lit("bottom").alias("side"), "*"))


@register("rk29_top_per_phase", "select y as phase, o_orderkey, r from (select year(o_orderdate)::int as y, o_orderkey, row_number() over (partition by year(o_orderdate) order by o_totalprice desc, o_orderkey) as r from orders) where r <= 5")
def rk29(spark, sf):
    r = F.row_number().over(Window.partitionBy(F.year("o_orderdate")).orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint")
    return read(spark, sf, "orders").select(F.year("o_orderdate").alias("phase"), "o_orderkey", r.alias("r")).where("r <= 5")


@register("rk30_round_robin", "select doc_id, cast((row_number() over (partition by source order by n_chars desc, doc_id) - 1) % least(4, greatest(2, c // 8)) as bigint) as part from (select *, count(*) over (partition by source) as c from documents)")
def rk30(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    k = F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.count(F.lit(1)).over(Window.partitionBy("source")) / 8)))
    return d.withColumn("k", k).select("doc_id", A.round_robin(d, ["source"], [F.desc("n_chars"), F.col("doc_id")], F.col("k")).cast("bigint").alias("part"))


@register("rk31_running_budget", "select doc_id, used from (select doc_id, cast(sum(n_chars) over (partition by source order by n_chars, doc_id rows unbounded preceding) as bigint) as used from documents) where used <= 20000")
def rk31(spark, sf):
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf, "documents").select("doc_id", F.sum("n_chars").over(w).alias("used")).where("used <= 20000")


@register("rk33_rerank_cap", """with s as (select conv_id, turn, 3 * cast(role = 'assistant' as int) + 2 * cast(contains(lower(text), 'that') as int) - 2 * cast(length(text) < 80 as int) as score from conversations),
t as (select * from s order by score desc, conv_id, turn limit 60) select conv_id, turn, score from (select *, row_number() over (partition by conv_id order by score desc, turn) as r from t) where r <= 3""")
def rk33(spark, sf):
    score = 3 * (F.col("role") == "assistant").cast("int") + 2 * F.lower("text").contains("that").cast("int") - 2 * (F.length("text") < 80).cast("int")
    t = read(spark, sf, "conversations").select("conv_id", "turn", score.alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(60)
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn"))
    return t.withColumn("r", r).where("r <= 3").drop("r")


@register("rk34_categorised_extract", """with c as (select doc_id, case when contains(lower(text), 'ononst') then 'a' when contains(lower(text), 'thatin') then 'b' when contains(lower(text), 'rewh') then 'c' else 'other' end as category, lower(substr(text, 1, 60)) as prefix from documents),
u as (select category, prefix, min(doc_id) as doc_id from c group by 1, 2) select category, doc_id from (select *, row_number() over (partition by category order by doc_id) as r from u) where r <= 4""")
def rk34(spark, sf):
    low = F.lower("text")
    category = F.when(low.contains("ononst"), "a").when(low.contains("thatin"), "b").when(low.contains("rewh"), "c").otherwise("other")
    c = read(spark, sf, "documents").select("doc_id", category.alias("category"), F.lower(F.substring("text", 1, 60)).alias("prefix"))
    u = c.groupBy("category", "prefix").agg(F.min("doc_id").alias("doc_id"))
    r = F.row_number().over(Window.partitionBy("category").orderBy("doc_id"))
    return u.withColumn("r", r).where("r <= 4").select("category", "doc_id")
