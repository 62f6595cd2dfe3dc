"""Keyed writes on Parquet tables, which have no update: whole groups are replaced by anti-join and union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_groups(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the batch's key groups go; the batch's rows come."""
    return table.join(batch.select(*keys).distinct(), list(keys), "left_anti").select(table.columns).unionByName(batch)


def insert_absent(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key is new are added; of repeated new keys one row."""
    fresh = batch.join(table.select(key), key, "left_anti").dropDuplicates([key])
    return table.unionByName(fresh.select(table.columns))


def upsert(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch replace those of equal key and add the others."""
    return replace_groups(table, batch, [key])


def changed_groups(old: DataFrame, new: DataFrame, group: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Keys of groups whose fingerprint differs, was not there or is gone.

    The fingerprint adds up hashes of the items, so it does not depend on their order and needs no sort.
    """

    def prints(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*item)
        return df.groupBy(*group).agg(F.sum(h.cast("decimal(38,0)")).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    both = prints(old, "old").join(prints(new, "new"), list(group), "full")
    same: Column = F.col("old").eqNullSafe(F.col("new")) & F.col("n_old").eqNullSafe(F.col("n_new"))
    return both.where(~same).select(*group)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line of GraphML for each node and edge."""

    def safe(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    n = nodes.select(F.concat(F.lit('<node id="'), safe("node_id"), F.lit('"/>')).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), safe("src"), F.lit('" target="'), safe("dst"), F.lit('"/>')).alias("value"))
    return n.unionByName(e)
