"""Queries: joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions.text import alnum, jaccard, words
from papyrine.operators import linking as L
from papyrine.plans.registry import register
from papyrine.sources.tables import PAPERS_SQL, papers, read, spread_texts

P = f"with {PAPERS_SQL} "
FIRST_SENTENCE = "lower(split_part(text, '.', 1))"


@register("jn1_either_key", "select l.l_orderkey, l.l_linenumber, s.s_name from lineitem l join supplier s on l.l_suppkey = s.s_suppkey or l.l_suppkey = s.s_nationkey")
def jn1(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("s_nationkey"), "s_name")
    return L.join_either(l, s, "l_suppkey", "s_suppkey", "s_nationkey").select("l_orderkey", "l_linenumber", "s_name")


@register("jn2_full_outer_scores", """select coalesce(a.k, b.k) as k, round(coalesce(a.x, 0) + coalesce(b.y, 0), 4) as score from
(select c_custkey as k, c_acctbal as x from customer where c_mktsegment = 'BUILDING') a full outer join
(select o_custkey as k, max(o_totalprice) as y from orders where o_orderstatus = 'F' group by 1) b on a.k = b.k""")
def jn2(spark, sf):
    a = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    b = read(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("y"))
    return L.full_outer_scores(a, b, "k", "x", "y").select("k", F.round("score", 4).alias("score"))


@register("jn3_left_enrich", "select p.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, 0) as toxic from documents p left join labels l using (doc_id)")
def jn3(spark, sf):
    d = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@register("jn4_array_member", """select n.n_nationkey, c.c_custkey from (select n_nationkey, unnest([n_nationkey, n_nationkey + 100]) as member from nation) n join customer c on c.c_custkey = n.member""")
def jn4(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.explode(F.array("n_nationkey", F.col("n_nationkey") + 100)).alias("member"))
    return n.join(read(spark, sf, "customer").select("c_custkey"), F.col("c_custkey") == F.col("member")).select("n_nationkey", "c_custkey")


@register("jn5_left_then_aggregate", "select c_mktsegment, count(o_orderkey) as n_orders, count(distinct c_custkey) as n_customers, round(coalesce(sum(o_totalprice), 0), 2) as total from customer left join orders on o_custkey = c_custkey group by c_mktsegment")
def jn5(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    j = read(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_mktsegment")
    return j.agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_orders"), F.count(F.lit(1)).alias("n_customers"), F.round(F.coalesce(F.sum("t"), F.lit(0.0)), 2).alias("total"))


@register("jn6_default_quality", "select d.lang, round(avg(coalesce(l.quality, 0.5)), 6) as mean_quality from documents d left join labels l using (doc_id) group by d.lang")
def jn6(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("lang").agg(F.round(F.avg(F.coalesce(F.col("quality").cast("double"), F.lit(0.5))), 6).alias("mean_quality"))


@register("jn7_ranked_links", """select c_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_totalprice desc, o_orderkey) as top_orders from
(select c_custkey, o_orderkey, o_totalprice, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as r from customer join orders on o_custkey = c_custkey where c_nationkey = 3) where r <= 3 group by c_custkey""")
def jn7(spark, sf):
    j = read(spark, sf, "customer").where("c_nationkey = 3").join(read(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    r = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = j.select("c_custkey", "o_orderkey", r.alias("r")).where("r <= 3").groupBy("c_custkey")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return top.agg(F.array_join(ids, ",").alias("top_orders"))


@register("jn8_range_phase", "select p.phase, count(*) as n from (select cast(year(o_orderdate) as bigint) as y from orders) o join (select * from (values ('early', 1995, 1996), ('middle', 1997, 1999), ('late', 1999, 2001)) v(phase, a, b)) p on o.y between p.a and p.b group by p.phase")
def jn8(spark, sf):
    phases = spark.createDataFrame([("early", 1995, 1996), ("middle", 1997, 1999), ("late", 1999, 2001)], "phase string, a bigint, b bigint")
    years = read(spark, sf, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"))
    return L.band_join(years, phases, "y", "a", "b", 3).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


SENT = "select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) as w from conversations"


@register("jn9_similarity_within", f"""with u as ({SENT} where role = 'user'), a as ({SENT} where role = 'assistant')
select u.conv_id, u.turn, a.turn as turn2, round(len(list_intersect(u.w, a.w)) / cast(least(len(u.w), len(a.w)) as double), 6) as overlap from u join a on u.conv_id = a.conv_id
where len(list_intersect(u.w, a.w)) > 0 and len(list_intersect(u.w, a.w)) / cast(least(len(u.w), len(a.w)) as double) > 0.2""")
def jn9(spark, sf):
    c = read(spark, sf, "conversations").withColumn("w", F.array_distinct(words(F.col("text"), 4)))
    a = c.where("role = 'user'").select("conv_id", "turn", "w")
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("turn2"), "w")
    return L.similarity_within(a, b, "conv_id", "turn", "turn2", "w", 0.2).withColumn("overlap", F.round("overlap", 6))


@register("jn10_containment", "select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)")
def jn10(spark, sf):
    """Documents that hold an item's text.

    An item's second to fourth words stand as whole words in a text that holds it, so both sides meet on
    them and the text is searched only for items it may hold; items of under five words are searched everywhere.
    """
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    d = read(spark, sf, "documents").select("doc_id", "text")
    token = F.lit(r"[^ \t\n]+")
    b = b.withColumn("w", F.regexp_extract_all("item", token, 0))
    long = b.where(F.size("w") > 4).select("item_id", "item", F.array_join(F.slice("w", 2, 3), " ").alias("key"))
    w = d.select("doc_id", "text", F.regexp_extract_all("text", token, 0).alias("w"))
    triples = F.zip_with(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y)), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    keys = w.select("doc_id", F.explode(F.array_distinct(triples)).alias("key"))
    hits = keys.join(long, "key").select("doc_id", "item_id", "item")
    found = hits.join(d, "doc_id").where(F.contains("text", "item")).select("item_id", "doc_id")
    short = b.where(F.size("w") <= 4).select("item_id", "item")
    return found.unionByName(d.join(short, F.contains("text", "item")).select("item_id", "doc_id"))


@register("jn11_cross_within_key", "select s.s_nationkey, s.s_suppkey, c.c_custkey from supplier s join customer c on s.s_nationkey = c.c_nationkey where c.c_acctbal > 9500")
def jn11(spark, sf):
    c = read(spark, sf, "customer").where("c_acctbal > 9500")
    return read(spark, sf, "supplier").join(c, F.col("s_nationkey") == F.col("c_nationkey")).select("s_nationkey", "s_suppkey", "c_custkey")


@register("jn12_capped_self_pairs", """with r as (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_suppkey) as i from (select distinct l_partkey, l_suppkey from lineitem))
select a.l_partkey, a.l_suppkey as left_item, b.l_suppkey as right_item from r a join r b on a.l_partkey = b.l_partkey and a.i < b.i and b.i <= 5""")
def jn12(spark, sf):
    r = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return L.capped_pairs(r, ["l_partkey"], "l_suppkey", 5)


@register("jn13_member_pairs", "select a.n_regionkey, a.n_nationkey as left_item, b.n_nationkey as right_item from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def jn13(spark, sf):
    members = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("m"))
    left = members.select("n_regionkey", "m", F.posexplode("m").alias("i", "left_item"))
    rest = F.slice("m", F.col("i") + 2, F.size("m"))
    return left.select("n_regionkey", "left_item", F.explode(rest).alias("right_item"))


@register("jn14_result_discussion", f"""with u as ({SENT} where role = 'user'), a as ({SENT} where role = 'assistant'), j as (select u.conv_id, u.turn, a.turn as turn2, len(list_intersect(u.w, a.w)) as shared, len(list_distinct(list_concat(u.w, a.w))) as total from u join a on u.conv_id = a.conv_id),
s as (select *, shared / cast(total as double) as j, row_number() over (partition by conv_id order by shared / cast(total as double) desc, turn, turn2) as r from j where shared >= 1 and shared / cast(total as double) >= 0.05)
select conv_id, turn, turn2, round(j, 6) as jaccard, case when j >= 0.25 then 'high' when j >= 0.12 then 'medium' else 'low' end as confidence from s where r <= 10""")
def jn14(spark, sf):
    c = read(spark, sf, "conversations").withColumn("w", F.array_distinct(words(F.col("text"), 4)))
    a = c.where("role = 'user'").select("conv_id", "turn", "w")
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("turn2"), F.col("w").alias("w2"))
    j = a.join(b, "conv_id").where(F.arrays_overlap("w", "w2")).withColumn("j", jaccard(F.col("w"), F.col("w2"))).where("j >= 0.05")
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("j"), "turn", "turn2"))
    label = F.when(F.col("j") >= 0.25, "high").when(F.col("j") >= 0.12, "medium").otherwise("low")
    return j.withColumn("r", r).where("r <= 10").select("conv_id", "turn", "turn2", F.round("j", 6).alias("jaccard"), label.alias("confidence"))


@register("jn15_claim_links", "select o.o_orderkey, string_agg(distinct cast(l_suppkey as varchar), ',' order by cast(l_suppkey as varchar)) as suppliers from orders o join lineitem l on l.l_orderkey = o.o_orderkey where o.o_orderpriority = '1-URGENT' group by o.o_orderkey")
def jn15(spark, sf):
    o = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    j = o.join(read(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("s")), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("suppliers"))


@register("jn17_unmatched", "select 'customer' as kind, c_custkey as id from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null) union all select 'document', doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def jn17(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    d, l = read(spark, sf, "documents"), read(spark, sf, "labels")
    a = L.missing(c, o, c["c_custkey"] == o["o_custkey"]).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return a.unionByName(L.missing(d, l, d["doc_id"] == l["doc_id"]).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")))


@register("jn18_mention_links", "select l_orderkey, l_linenumber, p_name from lineitem join part on p_partkey = l_partkey where l_returnflag = 'R' and p_type = 'ECONOMY'")
def jn18(spark, sf):
    l = read(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return l.join(read(spark, sf, "part").where("p_type = 'ECONOMY'"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@register("jn19_scored_assignment", """with s as (select n.n_nationkey, r.r_regionkey, case when n.n_regionkey = r.r_regionkey then 5 when left(n.n_name, 1) = left(r.r_name, 1) then 3 else 1 end as score from nation n cross join region r)
select n_nationkey, r_regionkey, score, case when score >= 3 then 'linked' else 'candidate' end as status from (select *, row_number() over (partition by n_nationkey order by score desc, r_regionkey) as k from s) where k <= 2""")
def jn19(spark, sf):
    """Region is a table of fixed size, so it may be broadcast to every nation."""
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    score = F.when(F.col("n_regionkey") == F.col("r_regionkey"), 5).when(F.left("n_name", F.lit(1)) == F.left("r_name", F.lit(1)), 3).otherwise(1)
    s = n.join(F.broadcast(r), F.lit(True)).select("n_nationkey", "r_regionkey", score.alias("score"))
    k = F.row_number().over(Window.partitionBy("n_nationkey").orderBy(F.desc("score"), "r_regionkey"))
    return s.withColumn("k", k).where("k <= 2").drop("k").withColumn("status", F.when(F.col("score") >= 3, "linked").otherwise("candidate"))


@register("jn20_referential_check", "select 'order' as edge, o_orderkey as id from orders where o_custkey not in (select c_custkey from customer) union all select 'line', l_orderkey from lineitem where l_partkey not in (select p_partkey from part) union all select 'document', doc_id from documents where doc_id not in (select doc_id from labels)")
def jn20(spark, sf):
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    l, p = read(spark, sf, "lineitem"), read(spark, sf, "part")
    d, k = read(spark, sf, "documents"), read(spark, sf, "labels")
    a = L.missing(o, c, o["o_custkey"] == c["c_custkey"]).select(F.lit("order").alias("edge"), F.col("o_orderkey").alias("id"))
    b = L.missing(l, p, l["l_partkey"] == p["p_partkey"]).select(F.lit("line").alias("edge"), F.col("l_orderkey").alias("id"))
    return a.unionByName(b).unionByName(L.missing(d, k, d["doc_id"] == k["doc_id"]).select(F.lit("document").alias("edge"), F.col("doc_id").alias("id")))


@register("jn21_hash_prefix", "select a.doc_id, b.doc_id as other from documents a join documents b on left(sha256(a.text), 12) = left(sha256(b.text), 12) and a.doc_id < b.doc_id")
def jn21(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.left(F.sha2("text", 256), F.lit(12)).alias("key"))
    return d.join(d.toDF("other", "key"), "key").where("doc_id < other").select("doc_id", "other")


@register("jn22_chunk_enrich", "select c.conv_id, c.turn, d.source, d.lang from conversations c left join documents d on d.doc_id = c.conv_id")
def jn22(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn")
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "source", "lang")
    return c.join(d, "conv_id", "left")


@register("jn23_lookup_cascade", P + """, q as (select * from (values ('q1', '12'), ('q2', '10.1234/doc.9'), ('q3', 'the')) v(q, x)),
a as (select q, paper_id, 0 as priority from q join papers on cast(paper_id as varchar) = x), b as (select q, paper_id, 1 as priority from q join papers on rtrim(lower(replace(doi, 'https://doi.org/', '')), '.') = x),
c as (select q, min(paper_id) as paper_id, 2 as priority from q join papers on contains(lower(title), x) group by q), u as (select * from a union all select * from b union all select * from c)
select u.q, u.paper_id, u.priority from u join (select q, min(priority) as priority from u group by q) m on m.q = u.q and m.priority = u.priority""")
def jn23(spark, sf):
    from papyrine.functions.text import normalize_doi

    p = papers(spark, sf).select("paper_id", "title", "doi")
    q = spark.createDataFrame([("q1", "12"), ("q2", "10.1234/doc.9"), ("q3", "the")], "q string, x string")
    by_id = q.join(p, F.col("paper_id").cast("string") == F.col("x")).select("q", "paper_id")
    by_doi = q.join(p, normalize_doi(F.col("doi")) == F.col("x")).select("q", "paper_id")
    # the queries are a fixed handful of rows
    by_title = p.join(F.broadcast(q), F.contains(F.lower("title"), F.col("x"))).groupBy("q").agg(F.min("paper_id").alias("paper_id"))
    return L.cascade(by_id, by_doi, by_title, by="q")


@register("jn24_reverse_index", "select l_suppkey, string_agg(cast(l_partkey as varchar), ',' order by l_partkey) as parts from (select distinct l_suppkey, l_partkey from lineitem) group by l_suppkey")
def jn24(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_suppkey")
    return l.agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


@register("set1_union_precedence", "select doc_id, 'label' as origin from labels union all select doc_id, 'document' from documents where doc_id not in (select doc_id from labels)")
def set1(spark, sf):
    l, d = read(spark, sf, "labels"), read(spark, sf, "documents")
    rest = d.join(l.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("document").alias("origin"))
    return l.select("doc_id", F.lit("label").alias("origin")).unionByName(rest)


@register("set2_first_spelling", "select doc_id, word from (select doc_id, word, row_number() over (partition by doc_id, lower(word) order by pos) as r, pos from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as w from documents))) where r = 1")
def set2(spark, sf):
    # texts are dealt by document once, so that their words need no shuffle
    d = spread_texts(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    w = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("pos", "word"))
    return w.groupBy("doc_id", F.lower("word").alias("lw")).agg(F.min_by("word", "pos").alias("word")).select("doc_id", "word")


@register("set3_set_algebra", "select 'intersect' as op, lang, source from (select lang, source from documents where doc_id % 2 = 0 intersect select lang, source from documents where doc_id % 3 = 0) union all select 'except', lang, source from (select lang, source from documents where doc_id % 2 = 0 except select lang, source from documents where doc_id % 7 = 0)")
def set3(spark, sf):
    d = read(spark, sf, "documents")
    even, third, seventh = (d.where(f"doc_id % {n} = 0").select("lang", "source") for n in (2, 3, 7))
    a = even.intersect(third).select(F.lit("intersect").alias("op"), "lang", "source")
    return a.unionByName(even.subtract(seventh).select(F.lit("except").alias("op"), "lang", "source"))


@register("set4_edge_dedup", "select min(l_orderkey) as first_order, l_partkey, l_suppkey from lineitem group by l_partkey, l_suppkey")
def set4(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first_order"))


@register("set5_prefix_dedup", "select min(doc_id) as doc_id, lower(substr(text, 1, 60)) as prefix from documents group by lower(substr(text, 1, 60))")
def set5(spark, sf):
    return read(spark, sf, "documents").groupBy(F.lower(F.substring("text", 1, 60)).alias("prefix")).agg(F.min("doc_id").alias("doc_id"))


@register("set6_content_dedup", "select min(doc_id) as doc_id, sha256(text) as sha256, count(*) as copies from documents group by sha256(text)")
def set6(spark, sf):
    return read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@register("set7_tag_diff", """with a as (select source, list_distinct(list(lang)) as old from documents where doc_id % 3 = 0 group by source), b as (select source, list_distinct(list(lang)) as new from documents where doc_id % 4 = 1 group by source)
select coalesce(a.source, b.source) as source, array_to_string(list_sort(list_filter(coalesce(new, []), lambda x: not list_contains(coalesce(old, []), x))), ',') as added, array_to_string(list_sort(list_filter(coalesce(old, []), lambda x: not list_contains(coalesce(new, []), x))), ',') as removed from a full outer join b on a.source = b.source""")
def set7(spark, sf):
    d = read(spark, sf, "documents")
    old = d.where("doc_id % 3 = 0").groupBy("source").agg(F.collect_set("lang").alias("old"))
    new = d.where("doc_id % 4 = 1").groupBy("source").agg(F.collect_set("lang").alias("new"))
    j = old.join(new, "source", "full").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("old", "new")})
    return j.select("source", F.array_join(F.array_sort(F.array_except("new", "old")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("old", "new")), ",").alias("removed"))


@register("fn12_alnum_join_key", "select p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') as key from part")
def fn12(spark, sf):
    return read(spark, sf, "part").select("p_partkey", alnum(F.concat_ws(" ", "p_name", "p_brand")).alias("key"))
