"""Connected components of a table of links, by repeated contraction.

Each round every node takes its smallest neighbour (or itself) as parent, two pointer jumps follow,
and links move to the parents; links inside a tree vanish.  The number of rounds grows with the logarithm
of the longest chain.  Each round's tables are written to the shared folder and those of the round before
deleted, so lineage and disk stay short; the minimum of a hot node is taken on the map side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of ``links``, the smallest node that it can reach.

    Links with a null end, repeated links and loops are harmless; a loop keeps its node in the result.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    written: DataFrame | None = None
    labels: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        taken = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "parents")
        jumped = taken
        for _ in range(2):
            jumped = jumped.join(taken.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p"))
        parents = scratch.table(jumped, "jumped")
        scratch.drop(taken)
        if labels is None:
            old, labels = None, parents
        else:
            moved = labels.withColumnRenamed("p", "q").join(parents.withColumnRenamed("u", "q"), "q", "left")
            old, labels = labels, scratch.table(moved.select("u", F.coalesce("p", "q").alias("p")), "labels")
        mine = parents.select("u", F.col("p").alias("pu"))
        yours = parents.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(mine, "u").join(yours, "v").where("pu <> pv")
        low, high = F.least("pu", "pv"), F.greatest("pu", "pv")
        edges = scratch.table(moved.select(low.alias("u"), high.alias("v")).distinct(), "links")
        scratch.drop(written, old, None if parents is labels else parents)
        written = edges
        if edges.isEmpty():
            scratch.drop(edges)
            return scratch.view(labels, labels.select(F.col("u").alias("node"), F.col("p").alias("component")))
