"""Greedy choices in rounds: what a plain loop takes one by one, taken all at once where nothing better is undecided.

Each round is joins and partial aggregates over what is still open; it is written once to the shared folder and the next round reads it.  The best
open choice can always be made, so every round decides something, and mostly very much; only counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.sources.session import ship_package
from papyrine.sources.workdir import written

#: Best open sets that one task decides in order, and members that these may have together; a larger set goes alone.
BATCH_SETS, BATCH_MEMBERS = 4096, 2_000_000


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, empty.limit(0))


def disjoint_sets(sets: DataFrame, least: int = 2) -> DataFrame:
    """(set, member): sets without members that a larger set took before, of equal sizes the smaller ``set`` first.

    ``sets`` has (set, member) once each.  A set whose rest is smaller than ``least`` is passed over, and its members stay open for others.
    Each round the best open sets, a batch of bounded size, are decided in order in one task, which takes whole crowds of overlapping sets at once;
    of the others each set is taken that is the best open one of all its open members.  So the result is that of a loop by size.
    """
    sizes = sets.groupBy("set").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    open_ = written(sets.join(sizes, "set").select("set", "size", "member"), "open")
    ship_package(sets.sparkSession)
    member = sets.schema["member"].dataType.simpleString()
    taken: list[DataFrame] = []
    rank = F.struct((-F.col("size")).alias("size"), F.col("set").alias("set"))

    def decide(table: pa.Table) -> pa.Table:
        place, who = table.column("place").to_numpy(), np.unique(table.column("member").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.argsort(place, kind="stable")
        ends = np.flatnonzero(np.diff(place[order], append=-1)) + 1
        free, won, start = np.ones(len(who), bool), [], 0
        for end in ends:
            rows = order[start:end]
            start = end
            rows = rows[free[who[rows]]]
            if len(rows) >= least:
                free[who[rows]] = False
                won.append(rows)
        return table.take(pa.array(np.concatenate(won) if won else np.zeros(0, np.int64))).select(["set", "member"])

    def without(rows: DataFrame, won: DataFrame) -> DataFrame:
        return rows.join(won.select("member"), "member", "left_anti")

    while not open_.isEmpty():
        rest = open_.groupBy("set").agg(F.count(F.lit(1)).alias("rest")).where(F.col("rest") >= least)
        alive = written(open_.join(rest, "set"), "alive")
        first = alive.select("set", "size", "rest").distinct().orderBy(rank).limit(BATCH_SETS).collect()
        if not first:
            break
        total = np.cumsum([r["rest"] for r in first])
        batch = [(r["set"], i) for i, r in enumerate(first) if i == 0 or total[i] <= BATCH_MEMBERS]
        chosen = F.broadcast(sets.sparkSession.createDataFrame(batch, f"set {sets.schema['set'].dataType.simpleString()}, place int"))
        met = alive.join(chosen, "set").select("set", "member", "place", F.lit(0).alias("__batch"))
        done = written(met.groupBy("__batch").applyInArrow(decide, f"set {sets.schema['set'].dataType.simpleString()}, member {member}"), "decided")
        taken.append(done)
        others = without(alive.join(chosen, "set", "left_anti").select("set", "size", "member"), done)
        rest = others.groupBy("set").agg(F.count(F.lit(1)).alias("rest")).where(F.col("rest") >= least)
        others = written(others.join(rest, "set"), "others")
        best = others.groupBy("member").agg(F.min(rank)["set"].alias("best"))
        ready = others.join(best, "member").groupBy("set", "rest").agg(F.count_if(F.col("best") == F.col("set")).alias("own")).where("own = rest").select("set")
        won = written(others.join(ready, "set", "left_semi").select("set", "member"), "won")
        taken.append(won)
        open_ = written(without(others.join(won.select("set").distinct(), "set", "left_anti"), won).select("set", "size", "member"), "open")
    return _union(taken, sets.select("set", "member"))


def capped_matching(edges: DataFrame, most: int) -> DataFrame:
    """Of ``edges`` (a, b, weight and other columns) those that a loop from the heaviest takes while both ends have fewer than ``most``.

    Of equal weights the smaller (a, b) goes first; a pair occurs once.  An edge is taken once it is among the heaviest open edges that still fit at
    both of its ends; a hot end keeps no more than ``most`` edges for each task before it is sorted.
    """
    open_ = written(edges.withColumn("__used_a", F.lit(0).cast("bigint")).withColumn("__used_b", F.lit(0).cast("bigint")), "edges")
    taken: list[DataFrame] = []
    order = [F.desc("weight"), F.asc("a"), F.asc("b")]
    while not open_.isEmpty():
        ends = open_.select(F.col("a").alias("end"), "a", "b", "weight", F.col("__used_a").alias("used")).unionByName(open_.select(F.col("b").alias("end"), "a", "b", "weight", F.col("__used_b").alias("used")))
        first = ends.withColumn("place", F.row_number().over(Window.partitionBy("end").orderBy(*order))).where(F.col("place") <= most).where(F.col("place") <= most - F.col("used"))
        both = first.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")
        won = written(open_.join(both, ["a", "b"], "left_semi"), "won")
        taken.append(won.select(*edges.columns))
        gains = won.select(F.col("a").alias("end")).unionByName(won.select(F.col("b").alias("end"))).groupBy("end").agg(F.count(F.lit(1)).alias("more"))
        rest = open_.join(both, ["a", "b"], "left_anti")
        for side in ("a", "b"):
            rest = rest.join(gains.select(F.col("end").alias(side), "more"), side, "left").withColumn(f"__used_{side}", F.col(f"__used_{side}") + F.coalesce("more", F.lit(0))).drop("more")
        open_ = written(rest.where((F.col("__used_a") < most) & (F.col("__used_b") < most)).select(*open_.columns), "edges")
    return _union(taken, edges)


def capped_lists(lists: Callable[[DataFrame], DataFrame], ends: DataFrame, most: int, listed: int) -> DataFrame:
    """``capped_matching`` of edges that are never all there: (a, b, weight), a < b.

    ``lists`` gives for a table (end, used) of open ends (end, other, weight), every end's ``listed + most`` best edges to other open ends or all
    of them, each edge with the same weight from both sides.  What a list holds is better than all it leaves out, so an edge among the best of both
    lists is taken rightly.  Once lists decide nothing more, the ends still open get new ones, until no list was cut.
    """
    order = Window.partitionBy("end").orderBy(F.desc("weight"), F.asc("other"))
    used = written(ends.select("end", F.lit(0).cast("bigint").alias("used")), "used")
    taken: list[DataFrame] = []
    empty: DataFrame | None = None
    while True:
        every = lists(used)
        empty = every.select(F.col("end").alias("a"), F.col("other").alias("b"), "weight").limit(0)
        if taken:  # an open end has fewer than ``most`` edges
            had = _union(taken, empty)
            had = had.select(F.col("a").alias("end"), F.col("b").alias("other")).unionByName(had.select(F.col("b").alias("end"), F.col("a").alias("other")))
            every = every.join(had, ["end", "other"], "left_anti")
        open_ = written(every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= listed).drop("place"), "lists")
        cut = not open_.groupBy("end").count().where(F.col("count") >= listed).isEmpty()
        while not open_.isEmpty():
            first = open_.join(used, "end").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most - F.col("used"))
            pair = first.select(F.least("end", "other").alias("a"), F.greatest("end", "other").alias("b"), "weight")
            won = written(pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")).where("n = 2").select("a", "b", "weight"), "won")
            if won.isEmpty():
                break
            taken.append(won)
            both = won.select(F.col("a").alias("end"), F.col("b").alias("other")).unionByName(won.select(F.col("b").alias("end"), F.col("a").alias("other")))
            gains = both.groupBy("end").agg(F.count(F.lit(1)).alias("more"))
            used = written(used.join(gains, "end", "left").select("end", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used")).where(F.col("used") < most), "used")
            left = open_.join(both, ["end", "other"], "left_anti").join(used.select("end"), "end", "left_semi")
            open_ = written(left.join(used.select(F.col("end").alias("other")), "other", "left_semi").select("end", "other", "weight"), "lists")
        if not cut:
            return _union(taken, empty)
