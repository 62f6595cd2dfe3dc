"""Groups of rows inside sorted partitions, and block-against-block keys for hot groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, in a partition sorted by them; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: list | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        change[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
        else:
            if cuts[0] > 0:
                held.append(batch.slice(0, cuts[0]))
            if held:
                yield pa.Table.from_batches(held)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.Table.from_batches([batch.slice(a, b - a)])
            held = [batch.slice(cuts[-1])]
        last = [c[-1] for c in columns]
    if held:
        yield pa.Table.from_batches(held)


def block_copies(asking: DataFrame, asked: DataFrame, key: str, block: int, counts: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns ``GROUP``, copied so that each asking block of a key meets each asked block in one group.

    Both sides have ``key`` and ``id`` columns.  Blocks hold about ``block`` rows, so a hot key becomes many small
    groups.  ``counts`` may give cheaper tables with the same keys, to count them.
    """

    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias(name))

    few, many = counts or (asking, asked)
    sizes = counted(few, "__p").join(counted(many, "__q"), key)
    both = []
    for side, own, other, n_own, n_other in ((asking, "__i", "__j", "__p", "__q"), (asked, "__j", "__i", "__q", "__p")):
        placed = side.join(sizes, key).withColumn(own, F.pmod(F.xxhash64("id"), n_own))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n_other) - 1)))
        both.append(placed.select(*side.columns, *GROUP))
    return both[0], both[1]


def blocks(asking: DataFrame, asked: DataFrame, key: str, block: int, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows of both sides, marked ``asks``, in the groups of ``block_copies``.

    Both sides have the same columns.  Partitions come sorted by group, asking rows first.
    """
    one, two = block_copies(asking, asked, key, block, counts)
    rows = one.withColumn("asks", F.lit(True)).unionByName(two.withColumn("asks", F.lit(False)))
    return rows.repartition(key, *GROUP).sortWithinPartitions(key, *GROUP, F.desc("asks"))


GROUP = ("__i", "__j")
