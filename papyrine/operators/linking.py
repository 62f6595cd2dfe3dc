"""Joins that link rows: by keys, arrays, ranges, similarity and best match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import overlap


def join_either(left: DataFrame, right: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Rows whose ``key`` equals ``first`` or ``second`` of the right side.

    Two equi-joins instead of one join with OR, which would compare all pairs; a row that meets both
    ways is given once.
    """
    by_first = left.join(right, left[key] == right[first])
    by_second = left.join(right, (left[key] == right[second]) & ~right[first].eqNullSafe(left[key]))
    return by_first.unionByName(by_second)


def full_outer_scores(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Both sides' rows by key, with the sum of their scores."""
    total = F.coalesce(left, F.lit(0.0)) + F.coalesce(right, F.lit(0.0))
    return a.join(b, key, "full").withColumn("score", total)


def band_join(rows: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Rows with the bands that hold their value, ends included.

    A band is listed under every cell of ``width`` that it touches, so the join is on equal cells with the
    range as residue, and no side has to be broadcast.
    """
    cells = bands.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    placed = rows.withColumn("__cell", F.floor(F.col(value) / width))
    return placed.join(cells, "__cell").where(F.col(value).between(F.col(low), F.col(high))).drop("__cell")


def similarity_within(a: DataFrame, b: DataFrame, by: str, a_id: str, b_id: str, tokens: str, least: float) -> DataFrame:
    """Pairs of one ``by`` value whose token sets overlap by more than ``least``.

    Only pairs that share a token are formed: both sides are exploded to tokens and joined on them.
    """
    left = a.select(by, F.col(a_id).alias("__a"), F.explode(F.array_distinct(tokens)).alias("__t"))
    right = b.select(by, F.col(b_id).alias("__b"), F.explode(F.array_distinct(tokens)).alias("__t"))
    shared = left.join(right, [by, "__t"]).groupBy(by, "__a", "__b").agg(F.count(F.lit(1)).alias("__n"))
    sizes_a = a.select(by, F.col(a_id).alias("__a"), F.size(F.array_distinct(tokens)).alias("__na"))
    sizes_b = b.select(by, F.col(b_id).alias("__b"), F.size(F.array_distinct(tokens)).alias("__nb"))
    scored = shared.join(sizes_a, [by, "__a"]).join(sizes_b, [by, "__b"])
    score = F.col("__n") / F.least("__na", "__nb")
    return scored.where(score > least).select(by, F.col("__a").alias(a_id), F.col("__b").alias(b_id), score.alias("overlap"))


def capped_pairs(rows: DataFrame, by: Sequence[str], item: str, cap: int) -> DataFrame:
    """Ordered pairs of a group's items in which the second is among the first ``cap``; the output is linear in a group."""
    ranked = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(item)))
    first = ranked.where(F.col("__i") <= cap).select(*by, F.col(item).alias("left_item"), F.col("__i").alias("__a"))
    second = ranked.where(F.col("__i") <= cap).select(*by, F.col(item).alias("right_item"), F.col("__i").alias("__b"))
    return first.join(second, list(by)).where("__a < __b").drop("__a", "__b")


def best_match(candidates: DataFrame, by: Sequence[str], score: Column, ties: Sequence[Column]) -> DataFrame:
    """The best candidate of each key."""
    window = Window.partitionBy(*by).orderBy(score.desc(), *ties)
    return candidates.withColumn("__r", F.row_number().over(window)).where("__r = 1").drop("__r")


def missing(rows: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """Rows without a partner."""
    return rows.join(other, on, "left_anti")


def cascade(*lookups: DataFrame, by: str, priority: str = "priority") -> DataFrame:
    """First lookup that answers each key, in the order given."""
    found = lookups[0].withColumn(priority, F.lit(0))
    for i, more in enumerate(lookups[1:], 1):
        found = found.unionByName(more.withColumn(priority, F.lit(i)))
    first = found.groupBy(by).agg(F.min(priority).alias(priority))
    return found.join(first, [by, priority])


def token_overlap(a: str, b: str) -> Column:
    """Overlap coefficient of two token columns."""
    return overlap(F.col(a), F.col(b))
