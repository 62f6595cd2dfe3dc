"""Sharding by a Feistel permutation with cycle walking over global row numbers [native].

Row numbers 0..N-1 are written as (left, right) with left < a = ceil(sqrt N) and right < b = ceil(N/a).
Each round adds a keyed hash of one half to the other, modulo its radix, so the rounds permute
[0, a*b); a*b - N < a, so a walk rarely has to step again, and a value outside [0, N) is
permuted until it is inside.  ``shard = p mod shards`` and ``slot = p div shards``: counts differ by one
at most, slots have no gap, and both can be computed from the row number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.numbering import number_rows
from papyrine.llm.scratch import Scratch

ROUNDS = 4
#: Each further step is needed with probability under 1/sqrt(N), and a walk takes at most a*b - N + 1.
WALK = 48


def radices(rows: int) -> tuple[int, int]:
    """Smallest near-square grid that holds ``rows`` numbers."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def permute(number: Column, rows: int, seed: int) -> Column:
    """Feistel permutation of [0, rows), cycle-walking until the value lies inside."""
    a, b = radices(rows)

    def rounds(x: Column) -> Column:
        start = F.struct((x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))

        def mix(state: Column, k: Column) -> Column:
            left = F.pmod(state["l"] + F.pmod(F.xxhash64(F.lit(seed), k, state["r"]), F.lit(a)), F.lit(a))
            shift = F.xxhash64(F.lit(seed), k + F.lit(1000), left)
            right = F.pmod(state["r"] + F.pmod(shift, F.lit(b)), F.lit(b))
            return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, mix, lambda s: s["l"] * F.lit(b) + s["r"])

    steps = min(WALK, max(1, a * b - rows + 1))
    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(steps)) if steps > 1 else F.array().cast("array<int>"),
        rounds(number.cast("bigint")),
        lambda x, _: F.when(x >= F.lit(rows), rounds(x)).otherwise(x),
    )
    checked = F.when(walked < F.lit(rows), walked)
    return F.coalesce(checked, F.raise_error(F.lit("a cycle walk left the bounded number of steps")).cast("bigint"))


def shard(
    docs: DataFrame,
    shards: int,
    *,
    order: list[str],
    seed: int = 7,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add ``shard`` (0..shards-1) and ``slot`` (0, 1, ... in each shard) to every row.

    The shuffle is reproducible: it depends on the order of ``order``, the row count and ``seed``, not
    on how files or partitions lie.  Nulls in ``order`` come first; rows equal in ``order`` may swap
    places.  An empty table gives an empty table.  Columns named ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    scratch = scratch or Scratch(docs.sparkSession, "feistel")
    number, place = "__number", "__permuted"
    numbered, rows = number_rows(docs.drop("shard", "slot"), order, number, scratch)
    placed = numbered.withColumn(place, permute(F.col(number), max(rows, 1), seed))
    return (
        placed.withColumn("shard", F.pmod(F.col(place), F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col(place) / F.lit(shards)).cast("bigint"))
        .drop(number, place)
    )


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Digest of a sharding of documents: law ``rows``; ``grown_shard`` is null under that law."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("__tie"),
    )
    placed = shard(narrow, shards, order=["doc_id", "size", "text_crc32", "__tie"], seed=seed)
    return placed.drop("__tie").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
