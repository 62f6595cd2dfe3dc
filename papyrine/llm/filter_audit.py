"""Which filter removes what, for every order of the filters, from one count of failure masks.

Each document fails a set of filters, a mask of a few bits.  Per part (a language, say) the documents are counted by
mask; a zeta transform over subsets turns these counts into the survivors of every set of filters.  An order of the
filters walks from set to set, so what a step removes is a difference between two neighbouring sets; the same holds
for counts of labelled documents.  Texts are read once and never shuffled: what travels is an id, a digest and a mask.

Defined cases: a null text is empty, a null part is the empty string; labels that repeat an id count if any of them is 1;
a null id has no label, fails no copy filter and makes no other document fail it; of rows that repeat an id with one text none
is a copy of the other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Filters by letter, in the order of their bits.
LETTERS = "ABCDE"
#: Bits of the filters that look at a text alone; the last filter compares texts.
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether a text has under 100 words, repeats over a fifth of them, is over a tenth capitals, or holds a mark."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame, *, failures: Sequence[Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail.

    ``failures`` has one condition per bit on the column ``text``; the next bit is the copy filter.  A document is a copy if some
    smaller id has the same text.  The first id of each text is found by partial minima and met again by (digest, id), so a
    text that a third of all rows hold is never one task's.
    """
    checks = text_failures(F.col("text")) if failures is None else list(failures)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks)), F.lit(0))
    seen = rows.select("id", "part", F.sha2(F.col("text"), 256).alias("digest"), mask.alias("mask")).groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    firsts = seen.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(checks)).otherwise(0)
    met = seen.join(firsts, ["digest", "id"], "left").join(marks, "id", "left")
    return met.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTS[1:]]
    )


def _counts(column: str, size: int) -> Column:
    """A map from masks to counts as an array by mask, zeros included."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.try_element_at(F.col(column), m), F.lit(0)).cast("bigint")).alias(column)


def _with_bit(column: str, bit: int) -> Column:
    """One step of the zeta transform: a set that holds ``bit`` also counts the set without it."""
    return F.transform(column, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(F.col(column), i - bit)).otherwise(F.lit(0))).alias(column)


def survivors(masks: DataFrame, bits: int) -> DataFrame:
    """(part, n, good, toxic): for each count an array whose entry t is the documents that fail no filter outside the set t."""
    filled = masks.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in COUNTS])  # a row for each mask, 2^bits at most
    table = filled.select("part", *[_counts(c, 1 << bits) for c in COUNTS])
    for b in range(bits):  # one projection for each filter, so that no expression nests in itself
        table = table.select("part", *[_with_bit(c, 1 << b) for c in COUNTS])
    return table


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, with what that step keeps, removes and loses.

    part, filter_order, step; kept, removed, redundant (fails this filter, gone before), unique_fails (fails this filter only), good_lost,
    toxic_lost, shapley (removed by this step's filter over all orders together).
    """
    bits, full = len(letters), (1 << len(letters)) - 1
    alive = survivors(masks, bits)
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])).alias("filter_order")
    steps = alive.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(bits))).alias("step"))
    bit_of = F.create_map(*[F.lit(v) for i, c in enumerate(letters) for v in (c, 1 << i)])
    letters_before = F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), "")
    before = F.aggregate(letters_before, F.lit(0), lambda s, c: s + F.coalesce(F.try_element_at(bit_of, c), F.lit(0)))
    own = F.element_at(bit_of, F.substring("filter_order", F.col("step"), F.lit(1)))
    at = steps.withColumns({"was": F.lit(full) - before, "own": own}).withColumn("now", F.col("was") - F.col("own"))

    def fell(c: str) -> Column:
        return F.get(c, F.col("was")) - F.get(c, F.col("now"))

    # a filter's turn comes after a set of k others in k! (bits - 1 - k)! orders
    weight = F.array(*[F.lit(factorial(k) * factorial(bits - 1 - k)) for k in range(bits)])
    gain = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(full)), lambda t: t.bitwiseAND(F.col("own")) != 0),
        F.lit(0).cast("bigint"),
        lambda s, t: s + F.get(weight, F.lit(bits) - F.bit_count(t)) * (F.get(F.col("n"), t) - F.get(F.col("n"), t - F.col("own"))),
    )
    return at.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), F.get("n", F.col("now")).alias("kept"), fell("n").alias("removed"),
        (F.get("n", F.lit(full)) - F.get("n", F.lit(full) - F.col("own")) - fell("n")).alias("redundant"), (F.get("n", F.col("own")) - F.get("n", F.lit(0))).alias("unique_fails"),
        fell("good").alias("good_lost"), fell("toxic").alias("toxic_lost"), gain.alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole documents, by language."""
    return audit(failure_masks(docs, labels))
