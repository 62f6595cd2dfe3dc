"""Filtered and ranked search over papers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import excerpt, normalize_doi, occurrences

#: Weights of fields in keyword search.
FIELD_WEIGHTS = {"title": 5.0, "abstract": 3.0, "summary": 4.0, "tags": 2.5, "metadata": 1.0}
#: What a filter adds to the score.
FILTER_WEIGHTS = {"list": 3.0, "year": 2.0, "range": 1.0, "doi": 4.0, "paper_id": 4.0}


@dataclass(frozen=True)
class Filters:
    """Conditions that must all hold; a null year fails every year condition."""

    paper_id: int | None = None
    doi: str | None = None
    year: int | None = None
    year_from: int | None = None
    year_to: int | None = None
    lists: Mapping[str, Sequence[str]] = field(default_factory=dict)


def list_matches(values: Column, wanted: Sequence[str]) -> Column:
    """Every wanted string is a case-insensitive substring of the joined values."""
    joined = F.lower(F.concat_ws(" | ", values))
    return reduce(and_, [joined.contains(w.lower()) for w in wanted], F.lit(True))


def predicates(filters: Filters) -> list[Column]:
    """One column per condition, so that the scan gets those it can use."""
    out = []
    if filters.paper_id is not None:
        out.append(F.col("paper_id") == filters.paper_id)
    if filters.doi is not None:
        out.append(normalize_doi(F.col("doi")) == normalize_doi(F.lit(filters.doi)))
    if filters.year is not None:
        out.append(F.col("year") == filters.year)
    if filters.year_from is not None:
        out.append(F.col("year") >= filters.year_from)
    if filters.year_to is not None:
        out.append(F.col("year") <= filters.year_to)
    out += [list_matches(F.col(c), w) for c, w in filters.lists.items() if w]
    return out


def passes(papers: DataFrame, filters: Filters) -> DataFrame:
    """Rows that meet all conditions."""
    return reduce(DataFrame.where, predicates(filters), papers)


def filter_score(filters: Filters) -> Column:
    """What the filters add; folded to one constant."""
    w = FILTER_WEIGHTS
    total = w["list"] * sum(1 for v in filters.lists.values() if v)
    total += w["year"] * (filters.year is not None) + w["doi"] * (filters.doi is not None) + w["paper_id"] * (filters.paper_id is not None)
    total += w["range"] * (filters.year_from is not None or filters.year_to is not None)
    return F.lit(float(total))


def keyword_score(terms: Sequence[str], weights: Mapping[str, float], most: int = 5) -> Column:
    """Sum over terms and fields of min(count, most) * weight."""
    parts = [F.least(occurrences(F.lower(F.coalesce(F.col(c), F.lit(""))), t.lower()), F.lit(most)) * F.lit(w) for t in terms for c, w in weights.items()]
    return reduce(add, parts).cast("double")


def field_score(values: Column, query: str) -> Column:
    """5 per distinct value that holds the query; for an empty query 2 if there is any value."""
    if not query:
        return F.when(F.size(values) > 0, F.lit(2.0)).otherwise(F.lit(0.0))
    return F.size(F.array_distinct(F.filter(values, lambda v: F.lower(v).contains(query.lower())))) * F.lit(5.0)


def keyword_search(papers: DataFrame, terms: Sequence[str], *, filters: Filters = Filters(), weights: Mapping[str, float], top_k: int, added: float = 0.0) -> DataFrame:
    """Papers that pass the filters and hold a term, best first: score, then year (null as 0), title, id.

    ``added`` is what filters give that were applied before.
    """
    scored = passes(papers, filters).withColumn("kw", keyword_score(terms, weights))
    scored = scored.withColumn("score", F.round(F.col("kw") + filter_score(filters) + F.lit(added), 4))
    # rows without a term score lowest, so they may be dropped from the top k: a filter before it would
    # be pushed to the scan and the scores computed twice
    best = scored.orderBy(F.desc("score"), F.desc(F.coalesce("year", F.lit(0))), "title", "paper_id").limit(top_k).where("kw > 0")
    return best.select("paper_id", "title", "year", "score", excerpt(F.col("abstract"), [t.lower() for t in terms]).alias("excerpt"))


def asset_keyword_score(query: str, weights: Mapping[str, float]) -> Column:
    """Phrase in a field: 3 * weight; else half the weight for each of the query's words in it."""
    parts = []
    for c, w in weights.items():
        text = F.lower(F.coalesce(F.col(c), F.lit("")))
        single = reduce(add, [text.contains(t).cast("int") for t in query.lower().split()]) * F.lit(0.5 * w)
        parts.append(F.when(text.contains(query.lower()), F.lit(3.0 * w)).otherwise(single))
    return reduce(add, parts)


def final_rank(base: Column, sources: Column, confidence: Column, fields: Column) -> Column:
    """Base score with bounded bonuses for sources, confidence and matched fields."""
    return base + F.least(0.05 * sources, F.lit(0.15)) + 0.1 * confidence + F.least(0.03 * fields, F.lit(0.15))


def page(rows: DataFrame, number: int, size: int, order: Sequence[Column]) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
