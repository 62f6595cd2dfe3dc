"""Components of similar nodes from bucketed candidates, without all pairs of a bucket.

The posts of a bucket are dealt once, to one sorted run that names its first node as hub.  Buckets that may hold
more than a thousandth of all posts are found by counts of ``CELLS`` cells of keys, and are split over so
many runs that none holds more; the hubs of their runs meet the first of them.

Work goes in rounds.  In the first, every node meets the smallest of its hubs.  In each later one, every bucket
that still holds several components picks a hub in its largest one, and each node outside that component meets
the hub, at most once for each component it could join.  Verified links merge components.  In the last round, in
the buckets that still hold several, the nodes outside the largest component meet all others, in blocks.  Pairs
inside a component are skipped because they change no component; no pair between components is left out
and no bucket is capped.  A group of n near copies costs about n comparisons.

Two things save pairs where the last round is a join.  A bucket of two nodes is settled by its only pair in the first
round.  Before the last round, nodes that are still outside in crowded buckets meet ``HUBS`` members of the
component that is largest there, so that few of a family's true links are left to be found one by one.  In the last
round a pair that shares several buckets is met in the first of them only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.components import components
from papyrine.llm.runs import GROUP, block_copies
from papyrine.llm.scratch import Scratch

Close = Callable[[str, str], Column]
ROUNDS = 2
#: Cells in which the posts of every so many nodes are counted (only to deal evenly: all posts are dealt); a cell with
#: more than this share of the counted posts, and more than so many, is split.
CELLS, COUNTED, SHARE, LEAST_RUN = 4096, 16, 1000, 64
#: Nodes of a bucket that meet each other in one group of the last round.
BLOCK = 1024
#: A bucket with more nodes is crowded, and so many members of its largest component are met before the last round.
CROWD, HUBS = 32, 16


def _side(nodes: DataFrame, name: str) -> DataFrame:
    """Columns of ``nodes`` with ``name`` appended; the id column is just ``name``."""
    return nodes.select(*[F.col(c).alias(name if c == "id" else f"{c}{name}") for c in nodes.columns])


def deal(posts: DataFrame, scratch: Scratch, twos: bool = False) -> tuple[DataFrame, DataFrame]:
    """(shared, hubs): a written table (key, id, hub, split) of the buckets that may hold several nodes, and pairs (a, b) of hubs of one bucket.

    ``posts`` holds a node once for each key.  With ``twos`` a further column ``two`` tells the buckets that hold just two nodes.
    """
    cell = F.pmod("key", F.lit(CELLS)).cast("int")
    part = posts.where(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0)
    counts = part.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()  # CELLS rows at most
    most = max(LEAST_RUN, sum(r["n"] for r in counts) // SHARE)
    hot = [(r["cell"], -(-r["n"] // most)) for r in counts if r["n"] > most]
    placed = posts.withColumn("cell", cell)
    if hot:
        # fewer than SHARE rows
        placed = placed.join(F.broadcast(posts.sparkSession.createDataFrame(hot, "cell int, runs bigint")), "cell", "left").fillna(1, ["runs"])
    else:
        placed = placed.withColumn("runs", F.lit(1).cast("bigint"))
    placed = placed.select("key", "id", "runs", F.pmod(F.xxhash64("id"), "runs").alias("run"))
    run = Window.partitionBy("key", "run").orderBy("id")
    dealt = placed.withColumn("hub", F.first("id").over(run)).withColumn("next", F.lead("id").over(run))
    several = (F.col("hub") < F.col("id")) | F.col("next").isNotNull() | (F.col("runs") > 1)
    columns = ["key", "id", "hub", (F.col("runs") > 1).alias("split")]
    if twos:
        heads_two = (F.col("hub") == F.col("id")) & F.lead("id", 2).over(run).isNull()
        ends_two = (F.lag("id").over(run) == F.col("hub")) & F.col("next").isNull()
        dealt = dealt.withColumn("two", (F.col("runs") == 1) & (heads_two | F.coalesce(ends_two, F.lit(False))))
        columns.append("two")
    shared = scratch.table(dealt.where(several).select(*columns), "buckets")
    if not hot:
        return shared, posts.sparkSession.createDataFrame([], "a bigint, b bigint")
    heads = shared.where("split and id = hub")
    first = heads.groupBy("key").agg(F.min("id").alias("b"))
    return shared, heads.join(first, "key").where("id > b").select(F.col("id").alias("a"), "b").distinct()


def similar(a: Column, b: Column, sizes: Column, percent: int) -> Column:
    """Whether two arrays have ``percent`` or more of their union in common; ``sizes`` adds their numbers of distinct items.

    The intersection is bound in a lambda, as a filter would make it anew for every use.
    """
    return F.exists(F.array(F.size(F.array_intersect(a, b))), lambda n: n * 100 >= (sizes - n) * percent)


def link(
    nodes: DataFrame,
    close: Close,
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    dealt: tuple[DataFrame, DataFrame],
    rest: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    finer: tuple[Callable[[DataFrame], DataFrame], Close] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(links, labels): verified pairs (a, b) that connect all similar nodes, and (node, component).

    ``nodes`` has id and whatever ``close(a, b)`` reads, which sees each column with the side's name appended, for
    every node of ``dealt``, the posts as ``deal`` has dealt them; their table is dropped here.  ``verify`` maps
    pairs (a, b) to those that are similar, as a written table.  ``rest`` finds the links of the last round from
    (mixed, labels); by default a join of blocks whose condition compares the sketches.  For that join ``finer`` may
    change the columns of some nodes, and gives the condition that reads them.
    """
    shared, hubs = dealt

    def possible(pairs: DataFrame, name: str) -> DataFrame:
        met = pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b")
        return scratch.table(met.where(close("a", "b")).select("a", "b"), name)

    settled = F.col("two") if "two" in shared.columns else F.lit(False)
    later = shared.where("id > hub").where(~settled)
    first = later.groupBy(F.col("id").alias("a")).agg(F.min("hub").alias("b")).unionByName(hubs)
    if "two" in shared.columns:
        first = first.unionByName(shared.where("id > hub").where(settled).select(F.col("id").alias("a"), F.col("hub").alias("b")))
    pairs = possible(first.distinct(), "first")
    links = verify(pairs)
    scratch.drop(pairs)
    label = components(links, scratch)
    mixed = _mixed(shared.where(~settled), label, scratch)
    scratch.drop(shared)
    for step in range(1, ROUNDS + 1):
        if mixed.isEmpty():
            break
        if step < ROUNDS:
            # a hub differs from round to round, and is the same for a component wherever it is the largest
            order = F.xxhash64(F.lit(step), "id")
            hub = mixed.where("component = main").groupBy("key").agg(F.min_by("id", order).alias("hub"))
            met = mixed.where("component <> main").join(hub, "key")
            pairs = met.groupBy(F.col("id").alias("a"), "main").agg(F.min("hub").alias("b")).select("a", "b").distinct()
            pairs = possible(pairs, f"round-{step}")
            more = verify(pairs)
            scratch.drop(pairs)
        elif rest is not None:
            more = rest(mixed, label)
        else:
            pairs = possible(_crowded(mixed, step), "crowded")
            more = verify(pairs)
            scratch.drop(pairs)
            if not more.isEmpty():
                links = links.unionByName(more)
                old, label = label, components(links, scratch)
                left, mixed = mixed, _mixed(mixed, label, scratch)
                scratch.drop(left, old)
            pairs = _between(mixed, nodes, close, scratch, finer)
            more = verify(pairs)
            scratch.drop(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            old, label = label, components(links, scratch)
            if step < ROUNDS:
                left, mixed = mixed, _mixed(mixed, label, scratch)
                scratch.drop(left)
            scratch.drop(old)
    return links, label


def _mixed(shared: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, component, main) of the buckets that hold several components; main is a largest one."""
    placed = shared.select("key", "id").join(label.toDF("id", "component"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    counted = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = counted.groupBy("key").agg(F.max_by("component", "k").alias("main"), F.count(F.lit(1)).alias("parts"))
    return scratch.table(placed.join(mixed.where("parts > 1").drop("parts"), "key").select("key", "id", "component", "main"), "mixed")


def _crowded(mixed: DataFrame, step: int) -> DataFrame:
    """Pairs (a, b) of each node outside the largest component of a crowded bucket with members of that component."""
    crowds = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CROWD)
    crowded = mixed.join(crowds.select("key"), "key")
    order = F.xxhash64(F.lit(step), "id")
    hubs = crowded.where("component = main").groupBy("main", F.pmod(order, F.lit(HUBS)).alias("slot")).agg(F.min_by("id", order).alias("b"))
    return crowded.where("component <> main").select(F.col("id").alias("a"), "main").distinct().join(hubs, "main").select("a", "b").distinct()


def _between(mixed: DataFrame, nodes: DataFrame, close: Close, scratch: Scratch, finer: tuple[Callable[[DataFrame], DataFrame], Close] | None) -> DataFrame:
    """Pairs of different components that meet in a bucket and are not excluded by ``close``, as a written table."""
    buckets = mixed.groupBy("id").agg(F.collect_list("key").alias("buckets"))
    nodes = nodes.join(buckets, "id")
    if finer is not None:
        nodes, close = finer[0](nodes), finer[1]
    sides = scratch.table(mixed.join(nodes, "id"), "sides")
    # no number is null; code that need not look is short enough to be compiled
    sure = sides.withColumns({c: F.coalesce(c, F.lit(0).cast(kind)) for c, kind in sides.dtypes if kind in ("int", "bigint")})
    asking, asked = block_copies(sure.where("component <> main"), sure, "key", BLOCK, (sides.where("component <> main"), sides))
    met = (F.col("componentb") == F.col("mainb")) | (F.col("a") < F.col("b"))
    same = [F.col(f"{c}a") == F.col(f"{c}b") for c in ("key", *GROUP)]
    # a pair may share many buckets; it is met in one
    once = F.array_min(F.array_intersect("bucketsa", "bucketsb")) == F.col("keya")
    cond = same[0] & same[1] & same[2] & (F.col("componenta") != F.col("componentb")) & met & close("a", "b") & once
    found = scratch.table(_side(asking, "a").join(_side(asked, "b"), cond).select("a", "b").distinct(), "between")
    scratch.drop(sides)
    return found
