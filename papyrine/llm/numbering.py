"""Dense global row numbers and seeded uniform numbers, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.scratch import Scratch


def number_rows(df: DataFrame, order: list[str], out: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """Add ``out`` = 0, 1, ... in the order of ``order`` (nulls first); also return the row count.

    A range partitioning sorts the rows; each row's place inside its partition comes from the low
    bits of ``monotonically_increasing_id``.  The sorted rows are written once, so that places and
    partition sizes come from the same files, and the sizes' running sum (one row per partition)
    turns places into global numbers.  A last range column splits runs of equal keys, so one
    repeated key does not fill one task.  Rows equal in all of ``order`` may swap numbers.
    """
    place, part, tie = "__place", "__part", "__tie"
    ordered = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col(tie))
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], tie)
        .drop(tie)
        .withColumn(place, F.monotonically_increasing_id())
    )
    written = scratch.table(ordered, "sorted")
    low = (1 << 33) - 1
    written = written.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND(F.lit(low)))
    sizes = written.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    offsets = scratch.table(
        sizes.withColumn("__before", F.sum("__n").over(Window.orderBy(part)) - F.col("__n")), "offsets"
    )
    total = offsets.agg(F.sum("__n")).first()[0] or 0
    # one row per partition of the sort: bounded by the number of tasks, so it may be broadcast
    numbered = written.join(F.broadcast(offsets.select(part, "__before")), part)
    return numbered.withColumn(out, F.col("__before") + F.col(place)).drop("__before", part, place), int(total)


DRAW_BITS = 52


def draw(seed: int | str, *keys: str) -> Column:
    """Number of ``DRAW_BITS`` bits from the MD5 of seed and keys: the same on every run and in other engines."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def word_count(text: str) -> Column:
    """Number of runs free of space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
