"""Mixing sources to target weights by capped water-filling [native].

``T`` words are shared by weight; a source whose share passes ``max_epochs`` times its size is clamped
there and the excess goes to the others by weight, until none is above.  The set of clamped sources
is ``cap / weight <= level`` for a rising level, so each pass over the source table (one row per source)
moves only one number.  A source's rate is target / size: every document gets ``floor(rate)`` whole
repetitions, and a seeded draw gives one more to documents holding the fractional part of the words.

The draw orders a source's documents by a seeded uniform number and takes them while the words before
a document's middle stay below the wanted words, so a source misses its target by half a document
at most.  The running sum is kept in two levels (bins of the seeded number, then the rows of the one
bin in which the sum passes the target), so no task gathers the rows of a source.  Rows that share a number are
added up before they move; where the target cuts through such a group, its rows are numbered by a distributed
sort, and as many as fit are taken.
The plan is one row per source: whole repetitions, the seeded number up to which one more is given, and how many
of the rows of that number get it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.numbering import DRAW_BITS, draw, number_rows, word_count
from papyrine.llm.scratch import Scratch

BIN_BITS = 12
WEIGHTS = (1.0, 2.0, 3.0)


def water_level(sources: DataFrame, total: float) -> float | None:
    """Level at which sum(min(cap, level * weight)) = total; null if every source is clamped."""
    level = None
    while True:
        open_ = F.col("weight") > 0 if level is None else (F.col("cap") > F.lit(level) * F.col("weight")) & (F.col("weight") > 0)
        row = sources.agg(
            F.sum(F.when(~open_, F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0))).otherwise(F.lit(0))).alias("held"),
            F.sum(F.when(open_, F.col("weight"))).alias("weight"),
        ).first()
        if row is None or not row["weight"]:
            return None
        risen = (total - row["held"]) / row["weight"]
        if level is not None and risen <= level:
            return level
        level = risen


def source_targets(sources: DataFrame, max_epochs: int, share: float = 1.0) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``.

    Sources of weight 0 get 0.  If the caps hold less than the wanted words, every source is at its cap.
    """
    capped = sources.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    total = (capped.agg(F.sum("source_size")).first()[0] or 0) * share
    level = water_level(capped, total)
    cap = F.col("cap").cast("double")
    fill = cap if level is None else F.least(cap, F.lit(float(level)) * F.col("weight"))
    return capped.withColumn("target", F.when(F.col("weight") > 0, fill).otherwise(F.lit(0.0)))


def cyclic_weights(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weights 1, 2, 3, repeating over the sources by code point, null last.

    A UTF-8 string sorts by code point in Spark.
    """
    ranked, _ = number_rows(sizes.withColumn("__last", F.col("source").isNull().cast("int")), ["__last", "source"], "__rank", scratch)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.get(cycle, F.pmod("__rank", F.lit(len(weights))).cast("int"))).drop("__rank", "__last")


def plan_sources(
    base: DataFrame,
    *,
    weights: DataFrame | None = None,
    max_epochs: int = 3,
    scratch: Scratch,
) -> DataFrame:
    """From rows (source, size, draw): per source its source_size, target, whole and ``upto``.

    A row is repeated ``whole`` times, and once more if its draw is ``upto`` or less.
    """
    base = base.withColumn("bin", F.shiftright("draw", DRAW_BITS - BIN_BITS))
    # one row per source and bin leaves each map task, so a hot source is added up before the shuffle
    bins = scratch.table(base.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
    sizes = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    if weights is None:
        weighted = cyclic_weights(scratch, sizes)
    else:
        given = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").fillna({"weight": 0.0})
    targets = source_targets(scratch.table(weighted, "weights"), max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = scratch.table(
        targets.withColumn("whole", F.floor(rate)).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    wanted = targets.select(F.col("source").alias("__s"), "wanted")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")
    cuts = (
        bins.withColumn("before", before)
        .join(wanted, F.col("source").eqNullSafe(F.col("__s")))
        .where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") >= F.col("wanted")))
        .select(F.col("source").alias("__s"), F.col("bin").alias("__bin"), "before", "wanted")
    )
    cuts = scratch.table(cuts, "cuts")
    # rows of one number are one group, taken as far as it fits: its i-th row (from 0) while the words before its middle are wanted
    groups = (
        base.join(cuts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bin") == F.col("__bin")))
        .groupBy("source", "draw", "before", "wanted")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("tied"))
    )
    left = F.col("wanted") - F.col("before") - F.sum("words").over(Window.partitionBy("source").orderBy("draw")) + F.col("words")
    fits = F.when(F.col("words") > 0, F.ceil(left / (F.col("words") / F.col("tied")) - 0.5)).otherwise(F.when(left > 0, F.col("tied")).otherwise(0))
    split = (
        groups.withColumn("some", F.greatest(F.lit(0), F.least(F.col("tied"), fits)))
        .where("some > 0")
        .groupBy("source")
        .agg(F.max(F.struct("draw", "some", "tied")).alias("last"))
    )
    edge = F.shiftleft(F.col("__bin"), DRAW_BITS - BIN_BITS) - 1
    whole_bins = F.struct(edge.alias("draw"), F.lit(1).cast("bigint").alias("some"), F.lit(1).cast("bigint").alias("tied"))
    upto = (
        cuts.join(split.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left")
        .select("__s", F.coalesce("last", whole_bins).alias("upto"))
    )
    held = targets.join(upto, F.col("source").eqNullSafe(F.col("__s")), "left")
    upto = [F.coalesce(F.col("upto")[c], F.lit(least).cast("bigint")).alias(name) for c, least, name in (("draw", -1, "upto"), ("some", 0, "some"), ("tied", 0, "tied"))]
    return held.select("source", "source_size", "target", "whole", *upto)


def repetitions(rows: DataFrame, plan: DataFrame, scratch: Scratch, tie: str | None = None) -> DataFrame:
    """``rows`` (source, draw, ...) with source_size, target and ``repetitions``; ``plan`` is a written table of a row per source.

    Rows whose group is taken in part are numbered in the order of ``tie``; rows equal in it may swap.
    """
    held = plan.select(F.col("source").alias("__s"), "source_size", "target", "whole", "upto", "some", "tied")
    joined = rows.join(held, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    more = F.col("whole") + (F.col("draw") <= F.col("upto")).cast("bigint")
    torn = (F.col("draw") == F.col("upto")) & (F.col("some") < F.col("tied"))
    helpers = ["whole", "upto", "some", "tied"]
    if plan.where("some < tied").isEmpty():
        return joined.withColumn("repetitions", more).drop(*helpers)
    numbered, _ = number_rows(joined.where(torn), ["source", *([tie] if tie else [])], "__n", scratch)
    start = numbered.groupBy(F.col("source").alias("__s")).agg(F.min("__n").alias("__first"))
    numbered = numbered.join(start, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    numbered = numbered.withColumn("repetitions", F.col("whole") + (F.col("__n") - F.col("__first") < F.col("some")).cast("bigint"))
    whole = joined.where(~torn).withColumn("repetitions", more)
    return whole.drop(*helpers).unionByName(numbered.drop("__n", "__first", *helpers))


def mix_digest(docs: DataFrame, *, max_epochs: int = 3, seed: int = 5) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of the mix of all documents.

    A null source is a source of its own, a null text has size 0; documents of size 0 are repeated as
    the rate says and count nothing.  An empty table gives an empty result.  Reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count("text").alias("size"))
    base = scratch.table(sized.withColumn("draw", draw(seed, "doc_id", "size")), "sizes")
    plan = scratch.table(plan_sources(base, max_epochs=max_epochs, scratch=scratch), "plan")
    return repetitions(base, plan, scratch).select(
        "doc_id",
        "size",
        F.col("source_size").cast("bigint").alias("source_size"),
        "target",
        (F.col("repetitions") * F.col("size")).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame, *, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 5) -> DataFrame:
    """The mixed rows themselves: each row as often as the plan repeats it, columns unchanged.

    Needs columns doc_id, source and text; others are carried along under any name.  Rows that agree in doc_id
    and size share their draw; where only some of them fit, those of the smallest text hashes are taken.  The
    texts are not shuffled, but for such rows: only sizes and draws are.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text", word_count("text").alias("size"))
    drawn = sized.withColumn("draw", draw(seed, "doc_id", "size"))
    base = scratch.table(drawn.select("source", "size", "draw"), "sizes")
    plan = scratch.table(plan_sources(base, weights=weights, max_epochs=max_epochs, scratch=scratch), "plan")
    repeated = repetitions(drawn.select("row", "source", "draw", F.xxhash64("text").alias("hash")), plan, scratch, "hash")
    times = F.when(F.col("repetitions") > 0, F.sequence(F.lit(1), F.col("repetitions").cast("int")))
    return repeated.select("row", F.explode(times).alias("copy")).select("row.*")
