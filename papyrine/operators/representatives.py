"""Representatives of groups: the best by score, spread over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of likeness, tags and a year; years of a bucket, its most representatives, and how few call for more.
LIKENESS, TAGGED, DATED = 0.4, 0.15, 0.05
BUCKET_YEARS, BUCKET_MOST, FEW = 5, 2, 3


def score(similarity: Column, tags: Column, year: Column) -> Column:
    """.4 of the likeness to the group's seed, .15 for any tag, .05 for a year; what is null adds nothing."""
    return F.coalesce(LIKENESS * similarity, F.lit(0.0)) + F.when(F.size(tags) > 0, TAGGED).otherwise(0.0) + F.when(F.coalesce(year, F.lit(0)) != 0, DATED).otherwise(0.0)


def representatives(rows: DataFrame, group: str, key: str, most: int = 5) -> DataFrame:
    """``rows`` (group, key, score, year and others) of up to ``most`` representatives for each group, with their place.

    In the order of score and key a row is taken unless its five years have two already (no year is a bucket of its own); if less than
    three come together, the best others follow.  So a bucket's rows are its first two, and the rest is only asked for where a group has few
    of these.  Both rankings keep a few rows for each task before anything is sorted.
    """
    order = [F.desc("score"), F.asc(key)]
    bucket = F.coalesce(F.floor(F.col("year") / BUCKET_YEARS), F.lit(0))
    own = rows.withColumn("__bucket", bucket)
    first = own.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order))).where(F.col("__r") <= BUCKET_MOST).drop("__r").withColumn("__spread", F.lit(0))
    best = own.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= most).drop("__r").withColumn("__spread", F.lit(1))
    either = first.unionByName(best).withColumn("__copy", F.row_number().over(Window.partitionBy(group, key).orderBy("__spread"))).where("__copy = 1")
    counted = either.withColumn("__n", F.sum(1 - F.col("__spread")).over(Window.partitionBy(group)))
    asked = counted.where((F.col("__spread") == 0) | (F.col("__n") < FEW))
    placed = asked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("__spread", *order)))
    return placed.where(F.col("place") <= most).drop("__bucket", "__spread", "__copy", "__n")
