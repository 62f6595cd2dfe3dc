"""Rule tables as expressions: keyword counts, first match, penalties."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that is found."""
    out: Column = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur."""
    return reduce(add, [text.contains(k).cast("int") for k in keywords])


def rubric(start: int, penalties: Sequence[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(score, notes): start plus the points of every condition that holds, not below 0, and their names."""
    points = [F.when(F.coalesce(c, F.lit(False)), F.lit(p)).otherwise(F.lit(0)) for c, p, _ in penalties]
    notes = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, _, n in penalties])), ",")
    return F.greatest(reduce(add, points, F.lit(start)), F.lit(0)), notes
