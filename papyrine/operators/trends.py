"""Time phases and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bounds(rows: DataFrame, year: str) -> DataFrame:
    """First and last year as one row."""
    return rows.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))


def fixed_phases(rows: DataFrame, year: str) -> DataFrame:
    """Phases of five years if the span is 15 or more, else three: phase, first_year, last_year, n."""
    width = F.when(F.col("hi") - F.col("lo") >= 15, 5).otherwise(3)
    j = rows.join(F.broadcast(_bounds(rows, year)))
    phase = F.floor((F.col(year) - F.col("lo")) / width)
    return j.groupBy(phase.alias("phase")).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count(F.lit(1)).alias("n"))


def merged_phases(rows: DataFrame, year: str, least: int) -> DataFrame:
    """Fixed phases merged from the left until each has ``least`` rows; a short tail joins the last.

    Merging is a fold over the phases, at most one per few years, held in one array.
    """
    phases = fixed_phases(rows, year)
    listed = phases.agg(F.array_sort(F.collect_list(F.struct("phase", "first_year", "last_year", "n"))).alias("p"))
    kind = "array<struct<a:int,b:int,n:bigint>>"

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["a"].alias("a"), x["last_year"].alias("b"), (last["n"] + x["n"]).alias("n"))
        fresh = F.struct(x["first_year"].alias("a"), x["last_year"].alias("b"), x["n"].alias("n"))
        short = (F.size(acc) > 0) & (last["n"] < least)
        return F.when(short, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    folded = listed.select(F.aggregate("p", F.array().cast(kind), add).alias("m"))
    tail = F.try_element_at("m", F.lit(-1))
    before = F.try_element_at("m", F.lit(-2))
    joined = F.concat(F.slice("m", 1, F.size("m") - 2), F.array(F.struct(before["a"].alias("a"), tail["b"].alias("b"), (before["n"] + tail["n"]).alias("n"))))
    final = F.when((F.size("m") > 1) & (tail["n"] < least), joined).otherwise(F.col("m")).cast(kind)
    return folded.select(F.posexplode(final).alias("phase", "x")).select("phase", F.col("x.a").alias("first_year"), F.col("x.b").alias("last_year"), F.col("x.n").alias("n"))


def three_way(rows: DataFrame, year: str) -> DataFrame:
    """``period``: early, middle or recent third of the years."""
    j = rows.join(F.broadcast(_bounds(rows, year)))
    span = F.col("hi") - F.col("lo")
    period = F.when(F.col(year) <= F.col("lo") + span / 3, "early").when(F.col(year) <= F.col("lo") + 2 * span / 3, "middle").otherwise("recent")
    return j.withColumn("period", period).drop("lo", "hi")


def evolution(rows: DataFrame, cluster: str, phase: str, phases: int, factor: float) -> DataFrame:
    """(cluster, trend, persistence) from the counts of a cluster's first and last phase."""
    n = rows.groupBy(cluster, phase).agg(F.count(F.lit(1)).alias("n"))
    f = n.groupBy(cluster).agg(F.max(phase).alias("p1"), F.count(F.lit(1)).alias("active"), F.min_by("n", phase).alias("first_n"), F.max_by("n", phase).alias("last_n"))
    final = F.col("p1") == phases - 1
    trend = (
        F.when(F.col("active") == 1, "single_period")
        .when((F.col("last_n") > factor * F.col("first_n")) & final, "emerging")
        .when((F.col("first_n") > factor * F.col("last_n")) & ~final, "declining")
        .otherwise("persistent")
    )
    return f.select(cluster, trend.alias("trend"), F.round(F.col("active") / phases, 6).alias("persistence"))


def median_split(rows: DataFrame, cluster: str, year: str, factor: float) -> DataFrame:
    """(cluster, mid, trend): counts before and from the upper median year, found from counts by year."""
    by = rows.groupBy(cluster, year).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy(cluster)
    by = by.withColumn("upto", F.sum("n").over(w.orderBy(year))).withColumn("all", F.sum("n").over(w))
    mid = by.where(F.col("upto") >= F.floor(F.col("all") / 2) + 1).groupBy(cluster).agg(F.min(year).alias("mid"))
    j = by.join(mid, cluster).groupBy(cluster, "mid")
    e, l = F.sum(F.when(F.col(year) < F.col("mid"), F.col("n")).otherwise(0)), F.sum(F.when(F.col(year) >= F.col("mid"), F.col("n")).otherwise(0))
    return j.agg(F.when(l > factor * e, "rising").when(e > factor * l, "falling").otherwise("steady").alias("trend"))
