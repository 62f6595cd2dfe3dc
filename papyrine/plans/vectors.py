"""Queries: vector search, retriever merging and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.operators import vectors as V
from papyrine.operators.topics import merged_topics, topic_similarity
from papyrine.plans.registry import register
from papyrine.sources.tables import read, spread

E = "select vec_id, label, embedding::double[] as v from embeddings"
Q = f"e as ({E}), q as (select v as qv from e where vec_id = 0)"
COS = "list_cosine_similarity(e.v, q.qv)"


@register("rk8_knn_filtered", f"with {Q} select vec_id, label, round(list_distance(e.v, q.qv), 6) as distance from e, q where label = 3 order by distance, vec_id limit 10")
def rk8(spark, sf):
    e = V.as_vectors(read(spark, sf, "embeddings"))
    return V.nearest(e.where("label = 3"), V.vector_of(e, 0), 10, metric="l2").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@register("rk9_cosine_distance", f"with {Q} select vec_id, round(1 - {COS}, 6) as distance from e, q")
def rk9(spark, sf):
    e = V.as_vectors(read(spark, sf, "embeddings"))
    return e.select("vec_id", F.round(V.cosine_distance(F.col("v"), V.vector_of(e, 0)), 6).alias("distance"))


@register("rk7_vector_score", f"with {Q}, h as (select label, list_distance(e.v, q.qv) as d from e, q order by d, vec_id limit 40) select label, round(sum(1 / (1 + d)), 6) as score, round(max(1 / (1 + d)), 6) as best from h group by label")
def rk7(spark, sf):
    e = V.as_vectors(read(spark, sf, "embeddings"))
    h = V.nearest(e, V.vector_of(e, 0), 40, metric="l2").withColumn("s", 1 / (1 + F.col("distance")))
    return h.groupBy("label").agg(F.round(F.sum("s"), 6).alias("score"), F.round(F.max("s"), 6).alias("best"))


@register("rk10_dual_interleave", f"""with {Q}, a as (select vec_id, 'a' as src, 1 - {COS} as d from e, q where vec_id % 2 = 0 order by d, vec_id limit 20), b as (select vec_id, 'b' as src, 1 - {COS} as d from e, q where vec_id % 3 = 0 order by d, vec_id limit 20),
u as (select *, row_number() over (partition by vec_id order by d, src) as k from (select * from a union all select * from b)), r as (select vec_id, src, row_number() over (partition by src order by d, vec_id) as rn from u where k = 1)
select vec_id, src, row_number() over (order by rn, src) as place from r""")
def rk10(spark, sf):
    e = V.as_vectors(read(spark, sf, "embeddings"))
    q = V.vector_of(e, 0)
    a = V.nearest(e.where("vec_id % 2 = 0"), q, 20).withColumn("src", F.lit("a"))
    b = V.nearest(e.where("vec_id % 3 = 0"), q, 20).withColumn("src", F.lit("b"))
    return V.interleave(a.unionByName(b)).select("vec_id", "src", F.col("place").cast("bigint").alias("place"))


@register("rk13_union_topk", f"with {Q} select vec_id, round(1 / (1 + (1 - {COS})), 6) as score from e, q where label in (1, 2) order by score desc, vec_id limit 15")
def rk13(spark, sf):
    e = V.as_vectors(read(spark, sf, "embeddings"))
    q = V.vector_of(e, 0)
    both = V.nearest(e.where("label = 1"), q, 15).unionByName(V.nearest(e.where("label = 2"), q, 15))
    return both.select("vec_id", F.round(1 / (1 + F.col("distance")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(15)


@register("rk14_merge_retrievers", f"""with {Q}, a as (select vec_id, {COS} as s, 'vector' as src from e, q order by s desc, vec_id limit 40), b as (select vec_id, 0.1 as s, 'label' as src from e where label = 4),
u as (select * from a union all select * from b) select vec_id, round(max(s), 6)::double as score, string_agg(distinct src, ',' order by src) as sources from u group by vec_id""")
def rk14(spark, sf):
    e = V.as_vectors(read(spark, sf, "embeddings"))
    a = V.nearest(e, V.vector_of(e, 0), 40).select("vec_id", (1 - F.col("distance")).alias("s"), F.lit("vector").alias("src"))
    b = e.where("label = 4").select("vec_id", F.lit(0.1).alias("s"), F.lit("label").alias("src"))
    return V.merge_hits(a.unionByName(b), "vec_id")


@register("rk14b_greedy_title_dedup")
def rk14b(spark, sf):
    """Hits whose titles nearly repeat a better hit's are dropped, one after the other."""
    d = read(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(60)
    hits = d.select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("n_chars").cast("double").alias("score"))
    return V.drop_near_titles(hits, "doc_id", "title", "score", 0.8)


@register("rk17_related", f"with {Q} select vec_id, round({COS}, 6) as similarity from e, q where vec_id <> 0 order by similarity desc, vec_id limit 8")
def rk17(spark, sf):
    e = V.as_vectors(read(spark, sf, "embeddings"))
    r = V.nearest(e.where("vec_id <> 0"), V.vector_of(e, 0), 8)
    return r.select("vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


PAIRS = f"e as ({E}), p as (select a.label, a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.v, b.v) as c from e a join e b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.3)"


@register("gr1_threshold_pairs", f"with {PAIRS} select label, a, b, round(c, 6) as cosine from p")
def gr1(spark, sf):
    return V.similar_pairs(V.as_vectors(read(spark, sf, "embeddings")), 0.3).select("label", "a", "b", F.round("cosine", 6).alias("cosine"))


@register("gr1b_communities")
def gr1b(spark, sf):
    """Greedy communities: largest neighbourhood first, no overlap, the rest as single clusters."""
    e = V.as_vectors(read(spark, sf, "embeddings"))
    return V.communities(e, V.similar_pairs(e, 0.25))


@register("gr2_nested_clusters")
def gr2(spark, sf):
    """Communities of closer vectors inside each community."""
    e = V.as_vectors(read(spark, sf, "embeddings"))
    outer = V.communities(e, V.similar_pairs(e, 0.25))
    return V.nested_communities(e, outer, 0.4).withColumnRenamed("label", "outer")


@register("gr3_cohesion", f"with e as ({E}), p as (select a.label, list_cosine_similarity(a.v, b.v) as c from e a join e b on a.label = b.label and a.vec_id < b.vec_id) select label, round(avg(c), 6) as cohesion from p group by label")
def gr3(spark, sf):
    """Mean pairwise cosine from the sum vector of a label: no pair is formed."""
    return V.cohesion(V.as_vectors(read(spark, sf, "embeddings")))


def _gr3_sql(most: int = 8, near: int = 9) -> str:
    """Every cluster written out: the first free vector, and the nearest of the other free ones."""
    parts = ["e as materialized (select vec_id, embedding::double[] as v, md5('42:' || vec_id) as draw from embeddings)", "u0 as (select vec_id from e where false)"]
    for k in range(1, most + 1):
        parts.append(f"f{k} as materialized (select * from e where vec_id not in (select vec_id from u{k - 1}))")
        parts.append(f"s{k} as materialized (select * from f{k} order by draw, vec_id limit 1)")
        parts.append(f"n{k} as materialized (select f.vec_id, f.v, 1 - list_cosine_similarity(f.v, s.v) as distance from f{k} f, s{k} s where f.vec_id <> s.vec_id order by distance, f.vec_id limit {near})")
        parts.append(f"m{k} as materialized (select {k} as cluster, vec_id, v, 0 as place, 0e0 as distance from s{k} union all select {k}, vec_id, v, row_number() over (order by distance, vec_id), distance from n{k})")
        parts.append(f"u{k} as materialized (select vec_id from u{k - 1} union all select vec_id from m{k})")
    every = " union all ".join(f"select * from m{k}" for k in range(1, most + 1))
    return f"""with {", ".join(parts)}, m as materialized ({every}),
c as (select a.cluster, avg(list_cosine_similarity(a.v, b.v)) as cohesion from m a join m b on a.cluster = b.cluster and a.place < b.place and b.place < 10 group by 1)
select cluster::int as cluster, vec_id, place::int as place, round(distance, 6) as distance, round(coalesce(cohesion, 0.5), 6) as cohesion from m left join c using (cluster)"""


@register("gr3b_seeded_clusters", _gr3_sql())
def gr3b(spark, sf):
    """Seeded nearest-neighbour clusters of vectors not yet taken, with their cohesion."""
    found = V.seeded_clusters(V.as_vectors(read(spark, sf, "embeddings")))
    return found.select("cluster", "vec_id", "place", F.round("distance", 6).alias("distance"), F.round("cohesion", 6).alias("cohesion"))


def _topics(spark, sf):
    """A source is a topic, and so are its documents in each language; keywords, title words, papers and vectors of them."""
    d = spread(read(spark, sf, "documents").select("doc_id", "text", "source", "lang"))
    rows = d.select("doc_id", "text", F.explode(F.array("source", F.concat_ws("/", "source", "lang"))).alias("topic"))
    papers = rows.select("topic", F.col("doc_id").alias("item"))
    words = d.select("source", "lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))).alias("item")).groupBy("source", "lang", "item").agg(F.count(F.lit(1)).alias("n"))
    counted = words.select(F.explode(F.array("source", F.concat_ws("/", "source", "lang"))).alias("topic"), "item", "n").groupBy("topic", "item").agg(F.sum("n").alias("n"))
    keywords = counted.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "item"))).where("r <= 12").select("topic", "item")
    ranked = papers.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("item"))).where("r <= 3").select("topic", F.col("item").alias("doc_id"), "r")
    titles = ranked.join(d.select("doc_id", F.substring_index("text", "\n", 1).alias("title")), "doc_id").select("topic", F.explode(F.split("title", " ")).alias("item"))
    e = V.as_vectors(read(spark, sf, "embeddings")).select(F.col("vec_id").alias("doc_id"), "v")
    owned = papers.withColumnRenamed("item", "doc_id").join(e.select("doc_id"), "doc_id", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("doc_id"))).where("r <= 2")
    return keywords, titles, papers, owned.join(e, "doc_id").select("topic", "v")


@register("gr4_topic_similarity", """with d as (select doc_id, text, source, unnest([source, source || '/' || lang]) as topic from documents),
w as (select topic, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) as item from d), n as (select topic, item, count(*) as n from w group by 1, 2),
k as (select topic, item from (select *, row_number() over (partition by topic order by n desc, item) as r from n) where r <= 12),
t as (select distinct topic, lower(item) as item from (select topic, unnest(string_split(string_split(text, chr(10))[1], ' ')) as item from (select *, row_number() over (partition by topic order by doc_id) as r from d) where r <= 3) where item <> ''),
v as (select topic, v from (select topic, embedding::double[] as v, row_number() over (partition by topic order by doc_id) as r from d join embeddings on vec_id = doc_id) where r <= 2),
ks as (select a.topic as a, b.topic as b, count(*) as k from k a join k b on a.item = b.item and a.topic < b.topic group by 1, 2), ts as (select a.topic as a, b.topic as b, count(*) as k from t a join t b on a.item = b.item and a.topic < b.topic group by 1, 2),
ps as (select a.topic as a, b.topic as b, count(*) as k from d a join d b on a.doc_id = b.doc_id and a.topic < b.topic group by 1, 2),
kn as (select topic, count(*) as n from k group by 1), tn as (select topic, count(*) as n from t group by 1), pn as (select topic, count(*) as n from d group by 1),
x as (select ks.a, ks.b, ks.k / (ka.n + kb.n - ks.k)::double as keyword_sim, coalesce(ts.k / (ta.n + tb.n - ts.k)::double, 0) as title_sim, coalesce(ps.k / (pa.n + pb.n - ps.k)::double, 0) as paper_sim,
coalesce((select avg(list_cosine_similarity(x.v, y.v)) from v x, v y where x.topic = ks.a and y.topic = ks.b), 0) as vector_sim from ks join kn ka on ka.topic = ks.a join kn kb on kb.topic = ks.b left join ts on ts.a = ks.a and ts.b = ks.b left join tn ta on ta.topic = ks.a left join tn tb on tb.topic = ks.b
left join ps on ps.a = ks.a and ps.b = ks.b left join pn pa on pa.topic = ks.a left join pn pb on pb.topic = ks.b)
select a, b, round(keyword_sim, 6) as keyword_sim, round(title_sim, 6) as title_sim, round(paper_sim, 6) as paper_sim, round(vector_sim, 6) as vector_sim, round(0.4 * keyword_sim + 0.25 * title_sim + 0.1 * paper_sim + 0.25 * vector_sim, 6) as similarity from x""")
def gr4(spark, sf):
    found = topic_similarity(*_topics(spark, sf))
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("keyword_sim", "title_sim", "paper_sim", "vector_sim", "similarity")])


@register("gr4b_merged_topics")
def gr4b(spark, sf):
    """Which topics become one: the most alike pairs first, each topic once."""
    return merged_topics(topic_similarity(*_topics(spark, sf))).select("a", "b", F.round("weight", 6).alias("weight"))


@register("gr4c_source_words", """with k as (select source, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{5,}')))) as w from documents group by source)
select a.source as a, b.source as b, round(len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) as double), 6) as jaccard from k a join k b on a.source < b.source""")
def gr4c(spark, sf):
    from papyrine.functions.text import words

    w = read(spark, sf, "documents").select("source", F.explode(F.array_distinct(words(F.col("text"), 5))).alias("w")).distinct()
    sizes = w.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    shared = w.toDF("a", "w").join(w.toDF("b", "w"), "w").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    pairs = sizes.toDF("a", "na").join(sizes.toDF("b", "nb"), F.col("a") < F.col("b"))
    both = pairs.join(shared, ["a", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return both.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@register("rk27_degree_capped_pairs")
def rk27(spark, sf):
    """Best pairs of all vectors of a label, at most three for each id, taken greedily."""
    return V.degree_capped_vectors(V.as_vectors(read(spark, sf, "embeddings")), 0.15, 3)
