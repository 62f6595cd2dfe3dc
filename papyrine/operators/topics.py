"""How alike topics are, and which two become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators.greedy import capped_matching
from papyrine.operators.vectors import cosine_distance

#: Weights of keywords, titles, papers and vectors, of both scores in the order of merges, and the least keyword similarity.
KEYWORDS, TITLES, PAPERS, VECTORS = 0.40, 0.25, 0.10, 0.25
BOTH_WEIGHT, KEYWORD_WEIGHT, LEAST = 0.4, 0.6, 0.28


def _shared(items: DataFrame) -> DataFrame:
    """(a, b, k): pairs of topics and how many items (topic, item) they share; an inverted list joined with itself."""
    x = items.select(F.col("topic").alias("a"), "item")
    return x.join(items.select(F.col("topic").alias("b"), "item"), "item").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))


def _jaccard(items: DataFrame, name: str) -> DataFrame:
    """(a, b, name) of the pairs that share an item; ``items`` (topic, item) are made distinct."""
    once = items.where("item is not null").distinct()
    sizes = once.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    met = _shared(once).join(sizes.select(F.col("topic").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("topic").alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias(name))


def topic_similarity(keywords: DataFrame, titles: DataFrame, papers: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, keyword_sim, title_sim, paper_sim, vector_sim, similarity) of all pairs of topics that share a keyword.

    ``keywords``, ``titles`` (words of them) and ``papers`` are (topic, item), ``vectors`` (topic, v) of a topic's first representatives, two at most.
    Words are compared in lower case.  Vector similarity is the mean cosine of all pairs of representatives, 0 without any.  Only
    topics that share a keyword can merge, so other pairs are never formed.
    """
    low = [t.where("item <> ''").select("topic", F.lower("item").alias("item")) for t in (keywords, titles)]
    pairs = _jaccard(low[0], "keyword_sim")
    for part in (_jaccard(low[1], "title_sim"), _jaccard(papers, "paper_sim")):
        pairs = pairs.join(part, ["a", "b"], "left")
    ends = pairs.select("a", "b").join(vectors.select(F.col("topic").alias("a"), F.col("v").alias("x")), "a").join(vectors.select(F.col("topic").alias("b"), F.col("v").alias("y")), "b")
    near = ends.groupBy("a", "b").agg(F.avg(1 - cosine_distance(F.col("x"), F.col("y"))).alias("vector_sim"))
    pairs = pairs.join(near, ["a", "b"], "left").fillna(0.0, ["title_sim", "paper_sim", "vector_sim"])
    total: Column = KEYWORDS * F.col("keyword_sim") + TITLES * F.col("title_sim") + PAPERS * F.col("paper_sim") + VECTORS * F.col("vector_sim")
    return pairs.withColumn("similarity", total)


def merged_topics(similar: DataFrame) -> DataFrame:
    """The pairs of ``topic_similarity`` that merge: keywords from .28, the most alike first, each topic once."""
    weight = F.round(BOTH_WEIGHT * F.col("similarity") + KEYWORD_WEIGHT * F.col("keyword_sim"), 12)
    return capped_matching(similar.where(F.col("keyword_sim") >= LEAST).withColumn("weight", weight), 1)
