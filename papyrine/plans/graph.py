"""Queries: property graph, trends, composites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.operators import graph as G
from papyrine.operators import trends as T
from papyrine.operators.chunking import windows
from papyrine.plans.registry import register
from papyrine.sources.tables import PAPERS_SQL, papers, read

P = f"with {PAPERS_SQL} "

def rows_n():
    """Number of rows; made when a query is built, since columns need a session."""
    return F.count(F.lit(1))
NODES = """nodes as (select 'r' || r_regionkey as node_id, 'region' as node_type, r_name as title, 0.9::double as confidence from region union all select 'n' || n_nationkey, 'nation', n_name, 0.8 from nation union all select 's' || s_suppkey, 'supplier', s_name, s_acctbal / 10000 from supplier)"""
EDGES = """edges as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'in_region' as edge_type from nation union all select 's' || s_suppkey, 'n' || s_nationkey, 'in_nation' from supplier)"""
BOTH = f"with recursive {NODES}, {EDGES}, und as (select src, dst from edges union all select dst, src from edges)"


@register("gr6_nodes", f"with {NODES} select node_id, node_type, title, round(confidence, 6) as confidence, node_type || '_' || lpad(cast(row_number() over (partition by node_type order by node_id) as varchar), 5, '0') as graph_id from nodes")
def gr6(spark, sf):
    n = G.nodes(spark, sf)
    rn = F.row_number().over(Window.partitionBy("node_type").orderBy("node_id")).cast("string")
    return n.select("node_id", "node_type", "title", F.round("confidence", 6).alias("confidence"), F.concat("node_type", F.lit("_"), F.lpad(rn, 5, "0")).alias("graph_id"))


@register("gr7_edges", f"with {EDGES} select src, dst, edge_type, sha256(src || '|' || edge_type || '|' || dst) as edge_id from edges")
def gr7(spark, sf):
    return G.edges(spark, sf)


@register("gr8_bfs", BOTH + ", w as (select 'n3' as node, 0 as depth union select dst, depth + 1 from w join und on src = node where depth < 2) select node as node_id, min(depth) as depth from w group by node")
def gr8(spark, sf):
    return G.within(G.edges(spark, sf), spark.createDataFrame([("n3",)], "node_id string"), 2)


@register("gr9_subgraph", f"with {NODES}, {EDGES} select src, dst from edges where src in (select node_id from nodes where node_type = 'nation' and confidence > 0.5) or dst in (select node_id from nodes where node_type = 'nation')")
def gr9(spark, sf):
    ids = G.nodes(spark, sf).where("node_type = 'nation'").select("node_id")
    return G.touching(G.edges(spark, sf), ids).select("src", "dst")


@register("gr10_support_chain", BOTH + ", w as (select 's5' as node, 0 as depth union all select dst, depth + 1 from w join edges on src = node where depth < 4) select node as node_id, min(depth) as depth from w group by node")
def gr10(spark, sf):
    start = spark.createDataFrame([("s5",)], "node_id string")
    return G.follow(G.edges(spark, sf), start, ["in_nation", "in_region"], 4)


@register("gr11_typed_chain", BOTH + ", w as (select 'r1' as node, 0 as depth union all select src, depth + 1 from w join edges on dst = node where depth < 2) select node as node_id, min(depth) as depth from w group by node")
def gr11(spark, sf):
    e = G.edges(spark, sf)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")
    return G.follow(back, spark.createDataFrame([("r1",)], "node_id string"), ["in_nation", "in_region"], 2)


@register("gr12_validation", f"""with {NODES}, {EDGES} select 'orphan' as issue, node_id as id from nodes where node_id not in (select src from edges union select dst from edges) union all
select 'low_confidence', node_id from nodes where confidence < 0.3 union all select 'dangling', src || '>' || dst from edges where dst not in (select node_id from nodes) union all
select 'duplicate', min(node_id) from nodes group by node_type, substr(title, 1, 8) having count(*) > 1""")
def gr12(spark, sf):
    return G.validate(G.nodes(spark, sf), G.edges(spark, sf), 8)


@register("gr13_asset_graph", "select l_orderkey as paper, 'mentions' as edge, 'part:' || l_partkey as asset from lineitem union select l_orderkey, 'supplied_by', 'supplier:' || l_suppkey from lineitem")
def gr13(spark, sf):
    l = read(spark, sf, "lineitem")
    pairs = F.array(
        F.struct(F.lit("mentions").alias("edge"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("asset")),
        F.struct(F.lit("supplied_by").alias("edge"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("asset")),
    )
    return l.select(F.col("l_orderkey").alias("paper"), F.inline(pairs)).distinct()


@register("gr14_network_topk", "with top as (select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 25) select l_partkey, l_orderkey from (select l.l_partkey, l_orderkey, row_number() over (partition by l.l_partkey order by l_orderkey) as r from (select distinct l_partkey, l_orderkey from lineitem) l join top using (l_partkey)) where r <= 8")
def gr14(spark, sf):
    l = read(spark, sf, "lineitem").select("l_partkey", "l_orderkey")
    top = l.groupBy("l_partkey").agg(rows_n().alias("n")).orderBy(F.desc("n"), "l_partkey").limit(25)
    edges = l.join(F.broadcast(top.select("l_partkey")), "l_partkey").distinct()  # 25 rows
    r = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey"))
    return edges.withColumn("r", r).where("r <= 8").drop("r")


@register("gr15_support_chains", "with h as (select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5) select o_orderkey, l_linenumber, l_partkey from (select o_orderkey, l_linenumber, l_partkey, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey) as r from h join lineitem on l_orderkey = o_orderkey) where r = 1")
def gr15(spark, sf):
    h = read(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey")
    j = read(spark, sf, "lineitem").join(F.broadcast(h), F.col("l_orderkey") == F.col("o_orderkey"))  # 5 rows
    r = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey"))
    return j.withColumn("r", r).where("r = 1").select("o_orderkey", "l_linenumber", "l_partkey")


@register("gr16_evidence_chain", "select conv_id, max(case when role = 'system' then r end) as system_turn, max(case when role = 'user' then r end) as user_turn, max(case when role = 'assistant' then r end) as assistant_turn from (select conv_id, role, min(turn) as r from conversations group by 1, 2) group by conv_id")
def gr16(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id")
    return c.agg(*[F.min(F.when(F.col("role") == r, F.col("turn"))).alias(f"{r}_turn") for r in ("system", "user", "assistant")])


@register("gr5_facet_hierarchy", "select lang, source, count(*) as n, case when count(*) < 8 then 'other' else source end as subtopic from documents group by lang, source")
def gr5(spark, sf):
    by = read(spark, sf, "documents").groupBy("lang", "source").agg(rows_n().alias("n"))
    return by.withColumn("subtopic", F.when(F.col("n") < 8, "other").otherwise(F.col("source")))


YEARS = "y as (select year(o_orderdate)::int as year, * from orders)"


@register("tm1_phases", f"with {YEARS}, b as (select min(year) as lo, max(year) as hi from y) select cast((year - lo) // case when hi - lo >= 15 then 5 else 3 end as bigint) as phase, min(year) as first_year, max(year) as last_year, count(*) as n from y, b group by 1")
def tm1(spark, sf):
    return T.fixed_phases(read(spark, sf, "orders").select(F.year("o_orderdate").alias("year")), "year")


@register("tm1b_merged_phases")
def tm1b(spark, sf):
    """Phases of all dated papers merged from the left until each holds 60 (the reference's default is 3); one row per phase is scanned in order."""
    return T.merged_phases(papers(spark, sf).where("year is not null").select("year"), "year", 60)


@register("tm2_three_way", f"with {YEARS}, b as (select min(year) as lo, max(year) as hi from y) select case when year <= lo + (hi - lo) / 3.0 then 'early' when year <= lo + 2 * (hi - lo) / 3.0 then 'middle' else 'recent' end as period, count(*) as n from y, b group by 1")
def tm2(spark, sf):
    return T.three_way(read(spark, sf, "orders").select(F.year("o_orderdate").alias("year")), "year").groupBy("period").agg(rows_n().alias("n"))


TREND = f"with {YEARS}, c as (select o_custkey % 40 as cluster, (year - 1995) // 3 as phase, count(*) as n from y group by 1, 2), f as (select cluster, min(phase) as p0, max(phase) as p1, count(*) as active, arg_min(n, phase) as first_n, arg_max(n, phase) as last_n from c group by cluster)"


@register("tm3_gap_evolution", TREND + " select cluster, case when active = 1 then 'single_period' when last_n > 1.3 * first_n and p1 = 2 then 'emerging' when first_n > 1.3 * last_n and p1 < 2 then 'declining' else 'persistent' end as trend, round(active / 3.0, 6)::double as persistence from f")
def tm3(spark, sf):
    y = read(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("cluster"), F.floor((F.year("o_orderdate") - 1995) / 3).alias("phase"))
    return T.evolution(y, "cluster", "phase", 3, 1.3)


@register("tm4_hypothesis_evolution", TREND + " select cluster, case when active = 1 then 'single_period' when last_n > first_n and p1 = 2 then 'emerging' when first_n > last_n and p1 < 2 then 'declining' else 'persistent' end as trend, round(active / 3.0, 6)::double as persistence from f")
def tm4(spark, sf):
    y = read(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("cluster"), F.floor((F.year("o_orderdate") - 1995) / 3).alias("phase"))
    return T.evolution(y, "cluster", "phase", 3, 1.0)


@register("tm5_opportunity_evolution", f"with {YEARS}, s as (select o_custkey % 40 as cluster, list_sort(list(year)) as ys from y group by 1), m as (select cluster, ys[len(ys) // 2 + 1] as mid from s) select cluster, mid, case when l > 1.3 * e then 'rising' when e > 1.3 * l then 'falling' else 'steady' end as trend from (select m.cluster, mid, count(case when year < mid then 1 end) as e, count(case when year >= mid then 1 end) as l from m join y on y.o_custkey % 40 = m.cluster group by 1, 2)")
def tm5(spark, sf):
    y = read(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("cluster"), F.year("o_orderdate").alias("year"))
    return T.median_split(y, "cluster", "year", 1.3)


@register("tm6_phase_content", "select phase, word, n from (select phase, word, n, row_number() over (partition by phase order by n desc, word) as r from (select phase, w as word, count(*) as n from (select cast((year - 1990) // 12 as bigint) as phase, unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) as w from (select case when doc_id % 11 = 0 then null else 1990 + doc_id % 35 end as year, substr(text, 1, 80) as title from documents) where year is not null) group by 1, 2)) where r <= 5")
def tm6(spark, sf):
    from papyrine.functions.text import words

    p = papers(spark, sf).where("year is not null").select(F.floor((F.col("year") - 1990) / 12).alias("phase"), F.explode(words(F.col("title"), 4)).alias("word"))
    n = p.groupBy("phase", "word").agg(rows_n().alias("n"))
    r = F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("n"), "word"))
    return n.withColumn("r", r).where("r <= 5").drop("r")


@register("tm7_method_shift", f"with {YEARS}, s as (select o_orderpriority, list_distinct(list(o_custkey % 50) filter (year < 1998)) as old, list_distinct(list(o_custkey % 50) filter (year >= 1998)) as new from y group by 1) select o_orderpriority, len(list_filter(new, lambda x: not list_contains(old, x))) as added, len(list_intersect(old, new)) as stable from s")
def tm7(spark, sf):
    y = read(spark, sf, "orders").select("o_orderpriority", (F.col("o_custkey") % 50).alias("m"), F.year("o_orderdate").alias("year"))
    s = y.groupBy("o_orderpriority").agg(F.collect_set(F.when(F.col("year") < 1998, F.col("m"))).alias("old"), F.collect_set(F.when(F.col("year") >= 1998, F.col("m"))).alias("new"))
    return s.select("o_orderpriority", F.size(F.array_except("new", "old")).cast("bigint").alias("added"), F.size(F.array_intersect("old", "new")).cast("bigint").alias("stable"))


@register("tm8_recency", f"with {YEARS}, m as (select max(year) as hi from y) select o_orderstatus, round(count(case when year >= hi - 2 then 1 end) / cast(count(*) as double), 6) as recent_ratio from y, m group by 1")
def tm8(spark, sf):
    y = read(spark, sf, "orders").select("o_orderstatus", F.year("o_orderdate").alias("year"))
    j = y.join(F.broadcast(y.agg(F.max("year").alias("hi"))))  # one row
    return j.groupBy("o_orderstatus").agg(F.round(F.count_if(F.col("year") >= F.col("hi") - 2) / rows_n(), 6).alias("recent_ratio"))


@register("cp1_context", "select p.p_partkey, p.p_name, count(distinct l.l_orderkey) as mentions, count(distinct s.s_nationkey) as nations, count(l.l_orderkey) > 0 as complete from part p left join lineitem l on l.l_partkey = p.p_partkey left join supplier s on s.s_suppkey = l.l_suppkey group by 1, 2")
def cp1(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name").distinct()
    l = read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey").where("l_partkey is not null")
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    # one distinct count at a time, by numbers alone: two at once give two rows for each line, which carry the name
    lines = l.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("mentions"))
    nations = l.join(s, "l_suppkey").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("s_nationkey").alias("nations"))
    j = p.join(lines, "p_partkey", "left").join(nations, "p_partkey", "left").fillna(0, ["mentions", "nations"])
    return j.select("p_partkey", "p_name", "mentions", "nations", (F.col("mentions") > 0).alias("complete"))


@register("cp2_table_context", "select o_custkey, count(*) as orders, count(distinct o_orderpriority) as priorities, max(o_totalprice) as best from orders group by o_custkey having count(*) > 5")
def cp2(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(rows_n().alias("orders"), F.count_distinct("o_orderpriority").alias("priorities"), F.max("o_totalprice").alias("best"))
    return o.where("orders > 5")


@register("cp3_cards", "select c_custkey, c_name || ' [' || c_mktsegment || '] ' || n_name as card from customer join nation on n_nationkey = c_nationkey")
def cp3(spark, sf):
    j = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    card = F.struct("c_name", "c_mktsegment", "n_name")
    return j.select("c_custkey", card.alias("x")).select("c_custkey", F.concat("x.c_name", F.lit(" ["), "x.c_mktsegment", F.lit("] "), "x.n_name").alias("card"))


@register("cp4_evidence_strength", "select doc_id, case when s >= 4 then 'strong' when s >= 2 then 'moderate' when s >= 1 then 'weak' else 'none' end as strength from (select doc_id, cast(contains(text, 'th') as int) + cast(lang = 'en' as int) + 2 * cast(n_chars > 2000 as int) + cast(source = 'src1' as int) as s from documents)")
def cp4(spark, sf):
    s = F.contains("text", F.lit("th")).cast("int") + (F.col("lang") == "en").cast("int") + 2 * (F.col("n_chars") > 2000).cast("int") + (F.col("source") == "src1").cast("int")
    return read(spark, sf, "documents").withColumn("s", s).select("doc_id", F.when(F.col("s") >= 4, "strong").when(F.col("s") >= 2, "moderate").when(F.col("s") >= 1, "weak").otherwise("none").alias("strength"))


@register("cp5_answer_summary", "select 'Found ' || count(*) || ' documents in ' || count(distinct source) || ' sources; longest ' || arg_max(doc_id, n_chars * 1000000 - doc_id) as answer, round(least(0.3 + 0.1 * 2 + 0.05 * least(count(*), 7), 0.85), 6)::double as confidence from documents where contains(lower(text), 'that')")
def cp5(spark, sf):
    d = read(spark, sf, "documents").where(F.lower("text").contains("that"))
    a = d.agg(rows_n().alias("n"), F.count_distinct("source").alias("s"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best"))
    text = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" documents in "), F.col("s").cast("string"), F.lit(" sources; longest "), F.col("best").cast("string"))
    return a.select(text.alias("answer"), F.round(F.least(0.5 + 0.05 * F.least("n", F.lit(7)), F.lit(0.85)), 6).alias("confidence"))


@register("cp6_intent_targets", "select doc_id from documents where lang in ('en', 'de') and source in ('src1', 'src2')")
def cp6(spark, sf):
    targets = {"compare": (["en", "de"], ["src1", "src2"])}
    langs, sources = targets["compare"]
    return read(spark, sf, "documents").where(F.col("lang").isin(langs) & F.col("source").isin(sources)).select("doc_id")


@register("cp7_next_steps", "select p_partkey, array_to_string(list_slice(list_filter([case when p_size > 30 then 'shrink' end, case when p_retailprice > 1000 then 'discount' end, 'review'], lambda x: x is not null), 1, 4), ',') as steps from part")
def cp7(spark, sf):
    steps = F.array(F.when(F.col("p_size") > 30, "shrink"), F.when(F.col("p_retailprice") > 1000, "discount"), F.lit("review"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.slice(F.array_compact(steps), 1, 4), ",").alias("steps"))


@register("cp8_review_summary", "select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as low, max(o_totalprice) as high from (select o.* from orders o join customer c on c_custkey = o_custkey where c_acctbal > 5000) group by 1")
def cp8(spark, sf):
    c = read(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    o = read(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("o_orderstatus")
    t = F.col("o_totalprice")
    return o.agg(rows_n().alias("n"), F.round(F.avg(t), 4).alias("mean"), F.min(t).alias("low"), F.max(t).alias("high"))


@register("cp9_version_compare", "select l.doc_id, d.n_chars - l.n as delta from documents d join (select doc_id, length(replace(text, ' ', '')) as n from documents) l using (doc_id)")
def cp9(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", (F.col("n_chars") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("delta"))


@register("cp10_seeded_sample", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5('7|' || doc_id), doc_id) as r from documents) where r <= 5")
def cp10(spark, sf):
    order = F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string")))
    r = F.row_number().over(Window.partitionBy("source").orderBy(order, "doc_id"))
    return read(spark, sf, "documents").select("source", "doc_id", r.alias("r")).where("r <= 5").drop("r")


@register("cp11_sample_flags", "select doc_id, array_to_string(list_filter([case when n_chars < 300 then 'short' end, case when contains(text, '@') then 'mail' end], lambda x: x is not null), ',') as flags from documents")
def cp11(spark, sf):
    f = F.array_compact(F.array(F.when(F.col("n_chars") < 300, "short"), F.when(F.contains("text", F.lit("@")), "mail")))
    return read(spark, sf, "documents").select("doc_id", F.array_join(f, ",").alias("flags"))


@register("cp12_embedding_records", "select 'metadata' as level, doc_id, 0::bigint as chunk, concat_ws(' ', lang, source) as record from documents union all select 'summary', doc_id, 0, text from documents where length(text) > 0 union all select 'text', doc_id, i, substr(text, i * 1420 + 1, 1600) from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil((length(text) - 180) / 1420.0) as bigint)))) as i from documents where length(text) > 0)")
def cp12(spark, sf):
    """Records to embed: metadata, the whole text in place of a summary, and all windows of the text."""
    d = read(spark, sf, "documents")
    levels = F.array_compact(F.array(
        F.struct(F.lit("metadata").alias("level"), F.concat_ws(" ", "lang", "source").alias("record")),
        F.when(F.length("text") > 0, F.struct(F.lit("summary").alias("level"), F.col("text").alias("record"))),
    ))
    whole = d.select("doc_id", F.inline(levels)).select("level", "doc_id", F.lit(0).cast("bigint").alias("chunk"), "record")
    chunks = windows(d.where("length(text) > 0"), "doc_id", "text", 1600, 180)
    return whole.unionByName(chunks.select(F.lit("text").alias("level"), "doc_id", "chunk", F.col("chunk_text").alias("record")))


@register("cp13_plan_counts", "select label as level, count(*) as planned from embeddings group by label")
def cp13(spark, sf):
    return read(spark, sf, "embeddings").groupBy(F.col("label").alias("level")).agg(rows_n().alias("planned"))


@register("cp14_update_by_key", "select doc_id, case when doc_id % 5 = 0 then 'updated' else lang end as tag from documents")
def cp14(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang")
    changes = d.where("doc_id % 5 = 0").select("doc_id", F.lit("updated").alias("new_tag"))
    return d.join(changes, "doc_id", "left").select("doc_id", F.coalesce("new_tag", "lang").alias("tag"))


@register("cp15_register_assets", "select min(page_id) as page_id, sha256(html) as sha256, count(*) - 1 as skipped from pages group by sha256(html)")
def cp15(spark, sf):
    return read(spark, sf, "pages").groupBy(F.sha2("html", 256).alias("sha256")).agg(F.min("page_id").alias("page_id"), (rows_n() - 1).alias("skipped"))


@register("cp16_mention_sources", "select origin, count(*) as n from (select 'documents' as origin from documents where contains(lower(text), 'thatin') union all select 'conversations' from conversations where contains(lower(text), 'thatin') union all select 'pages' from pages where contains(lower(html), 'thatin')) group by origin")
def cp16(spark, sf):
    parts = [read(spark, sf, t).where(F.lower(c).contains("thatin")).select(F.lit(t).alias("origin")) for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(rows_n().alias("n"))


@register("cp17_file_inventory", "select split_part(split_part(url, '://', 2), '/', 1) as host, count(*) as n from pages where not regexp_matches(url, '\\.html$') group by 1")
def cp17(spark, sf):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return read(spark, sf, "pages").where(~F.rlike("url", F.lit(r"\.html$"))).groupBy(host.alias("host")).agg(rows_n().alias("n"))


@register("cp19_notes_map", "select p_brand, string_agg(p_name || '=' || n, ';' order by p_name) as notes from (select p_brand, p_name, count(*) as n from part group by 1, 2) group by p_brand")
def cp19(spark, sf):
    n = read(spark, sf, "part").groupBy("p_brand", "p_name").agg(rows_n().alias("n"))
    items = F.array_sort(F.collect_list(F.struct("p_name", "n")))
    return n.groupBy("p_brand").agg(F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["p_name"], x["n"].cast("string"))), ";").alias("notes"))


@register("cp20_build_rollup", "select stage, count(*) as n from (select case when n_chars < 300 then 'skipped' when lang <> 'en' then 'partial' else 'built' end as stage from documents) group by stage")
def cp20(spark, sf):
    stage = F.when(F.col("n_chars") < 300, "skipped").when(F.col("lang") != "en", "partial").otherwise("built")
    return read(spark, sf, "documents").groupBy(stage.alias("stage")).agg(rows_n().alias("n"))


@register("cp21_inventory", "select 'documents' as name, count(*) as n from documents union all select 'pages', count(*) from pages union all select 'events', count(*) from events")
def cp21(spark, sf):
    parts = [read(spark, sf, t).agg(rows_n().alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "pages", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("cp23_parser_routing", "select page_id, case when length(html) > 5000 then 'deep' when contains(html, '<li>') then 'layout' else 'fast' end as parser from pages")
def cp23(spark, sf):
    h = F.col("html")
    return read(spark, sf, "pages").select("page_id", F.when(F.length(h) > 5000, "deep").when(h.contains("<li>"), "layout").otherwise("fast").alias("parser"))


@register("cp24_eval_rollup", "select lang, count(*) as cases, round(avg(case when quality = 1 and toxic = 0 then 1.0 else 0.0 end), 6)::double as pass_rate from documents join labels using (doc_id) group by lang")
def cp24(spark, sf):
    j = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id").groupBy("lang")
    ok = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)
    return j.agg(rows_n().alias("cases"), F.round(F.avg(ok), 6).alias("pass_rate"))


@register("cp25_llm_contract", "select event_id, cast(json_extract(props, '$.k') as int) as k, 'ok' as status from events")
def cp25(spark, sf):
    parsed = F.from_json("props", "k int")
    return read(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.when(parsed["k"].isNull(), "fallback").otherwise("ok").alias("status"))


@register("cp26_staleness", "select source, md5(string_agg(cast(n_chars as varchar), ',' order by doc_id)) as fingerprint from documents group by source")
def cp26(spark, sf):
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))), lambda x: x["n_chars"].cast("string"))
    return read(spark, sf, "documents").groupBy("source").agg(F.md5(F.array_join(items, ",")).alias("fingerprint"))
