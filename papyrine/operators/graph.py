"""Property graph: nodes, edges, traversal and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.tables import read


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, node_type, title, confidence) of regions, nations and suppliers."""
    r = read(spark, sf_dir, "region").select(_key("r", "r_regionkey").alias("node_id"), F.lit("region").alias("node_type"), F.col("r_name").alias("title"), F.lit(0.9).alias("confidence"))
    n = read(spark, sf_dir, "nation").select(_key("n", "n_nationkey").alias("node_id"), F.lit("nation").alias("node_type"), F.col("n_name").alias("title"), F.lit(0.8).alias("confidence"))
    s = read(spark, sf_dir, "supplier").select(_key("s", "s_suppkey").alias("node_id"), F.lit("supplier").alias("node_type"), F.col("s_name").alias("title"), (F.col("s_acctbal") / 10000).alias("confidence"))
    return r.unionByName(n).unionByName(s)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, edge_type, edge_id); the id is a hash of the edge, so that repeats can be found."""
    n = read(spark, sf_dir, "nation").select(_key("n", "n_nationkey").alias("src"), _key("r", "n_regionkey").alias("dst"), F.lit("in_region").alias("edge_type"))
    s = read(spark, sf_dir, "supplier").select(_key("s", "s_suppkey").alias("src"), _key("n", "s_nationkey").alias("dst"), F.lit("in_nation").alias("edge_type"))
    return n.unionByName(s).withColumn("edge_id", F.sha2(F.concat_ws("|", "src", "edge_type", "dst"), 256))


def _steps(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node_id, depth): nodes reached by ``depth`` steps at most; nodes already reached are not walked again."""
    reached = start.select("node_id", F.lit(0).alias("depth")).distinct()
    front = reached
    for d in range(1, depth + 1):
        met = front.join(links, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id")).distinct()
        front = met.join(reached.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(d))
        reached = reached.unionByName(front)
    return reached


def within(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Neighbourhood, edges taken both ways."""
    return _steps(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), start, depth)


def follow(edges: DataFrame, start: DataFrame, types: Sequence[str], depth: int) -> DataFrame:
    """Nodes reached along edges of the given types, in their direction."""
    return _steps(edges.where(F.col("edge_type").isin(*types)).select("src", "dst"), start, depth)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids``, each once."""
    a = edges.join(ids, F.col("src") == F.col("node_id"), "left_semi")
    b = edges.join(ids, F.col("dst") == F.col("node_id"), "left_semi")
    return a.unionByName(b).distinct()


def validate(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(issue, id): orphans, low confidence, dangling edges, repeated titles."""
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    orphan = nodes.join(ends, "node_id", "left_anti").select(F.lit("orphan").alias("issue"), F.col("node_id").alias("id"))
    low = nodes.where("confidence < 0.3").select(F.lit("low_confidence").alias("issue"), F.col("node_id").alias("id"))
    loose = edges.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    dangling = loose.select(F.lit("dangling").alias("issue"), F.concat("src", F.lit(">"), "dst").alias("id"))
    twice = nodes.groupBy("node_type", F.substring("title", 1, width).alias("t")).agg(F.min("node_id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return orphan.unionByName(low).unionByName(dangling).unionByName(twice.select(F.lit("duplicate").alias("issue"), "id"))
