"""Grouped summaries.  Everything here is a plain aggregate, so partial sums leave the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import clip


def top_counts(rows: DataFrame, key: Column, k: int, name: str = "key") -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(k)


def count_if_map(conditions: Mapping[str, Column]) -> list[Column]:
    """One conditional count per name."""
    return [F.count_if(c).alias(n) for n, c in conditions.items()]


def joined_set(value: Column, sep: str = ",") -> Column:
    """Distinct values in order, as one string: the same on every run."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def mean_of_truthy(value: Column) -> Column:
    """Mean over values that are neither null nor zero."""
    return F.avg(F.when(value != 0, value))


def numeric_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, min, max, mean of each column, in one pass over the rows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    return long.select("x.*").groupBy("column").agg(
        F.count("v").alias("n"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.round(F.avg("v"), 4).alias("mean")
    )


def dedup_merge(rows: DataFrame, key: Sequence[str], item: str, value: str, most: int = 5) -> DataFrame:
    """One row per key: links, distinct items in order, and the first ``most`` values."""
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("links"),
        joined_set(F.col(item)).alias("items"),
        F.array_join(F.slice(F.array_sort(F.collect_set(value)), 1, most), ",").alias("first_values"),
    )


def round_robin(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: Column) -> Column:
    """Number of the part a row gets when a group's rows are dealt out in turn."""
    return (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % k


def opportunity_scores() -> dict[str, Column]:
    """Component scores of an opportunity from its aggregates.

    Reads papers, confidence, hyp_quality, gaps, support, n_hyp, low, med, high, has_pred, has_exp, novelty_type,
    impact_type, why_length and overclaims.
    """
    r = {c: F.when(F.col("n_hyp") > 0, F.col(c) / F.col("n_hyp")).otherwise(F.lit(0.0)) for c in ("low", "med", "high")}
    quality = F.coalesce("hyp_quality", F.lit(0.5))
    support = F.when(F.col("support") == "strong", 0.15).when(F.col("support") == "multi", 0.08).otherwise(0.0)
    evidence = clip(0.35 * F.least(F.lit(1.0), F.col("papers") / 15) + 0.25 * F.col("confidence") + 0.15 * quality + F.least(F.lit(0.15), 0.005 * F.col("gaps")) + support)
    feasible = clip(0.5 * (r["low"] + 0.6 * r["med"] + 0.15 * r["high"]) + 0.1 * F.col("has_pred") + 0.1 * F.col("has_exp") + 0.2)
    feasibility = F.when(F.col("n_hyp") == 0, F.lit(0.3)).otherwise(feasible)
    novelty = clip(0.7 * F.col("novelty_type") + F.least(F.lit(0.3), 0.02 * F.col("papers")))
    width = F.when(F.col("support") == "strong", 1.0).when(F.col("support") == "multi", 0.7).otherwise(0.3)
    why = F.when(F.col("why_length") == 0, F.lit(0.3)).otherwise(F.least(F.lit(1.0), F.col("why_length") / 200))
    impact = clip(0.25 * F.least(F.lit(1.0), F.col("papers") / 12) + 0.3 * width + 0.15 * why + 0.3 * F.col("impact_type"))
    confidence = 0.4 * F.col("confidence") + 0.6 * quality
    risk = F.when(F.col("n_hyp") == 0, F.lit(0.15)).otherwise(F.least(F.lit(0.5), 0.4 * r["high"] + F.least(F.lit(0.15), 0.03 * F.col("overclaims"))))
    return {"evidence": evidence, "feasibility": feasibility, "novelty": novelty, "impact": impact, "certainty": confidence, "risk": risk}


def opportunity_total() -> Column:
    """Weighted sum of the component columns."""
    return 0.30 * F.col("evidence") + 0.25 * F.col("feasibility") + 0.20 * F.col("novelty") + 0.15 * F.col("impact") + 0.10 * F.col("certainty") - 0.10 * F.col("risk")
