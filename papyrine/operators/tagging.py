"""Dictionary tags of papers: hits of terms and patterns with exclusions around them, scored by section."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions import evidence_rules as E
from papyrine.functions.classify import section_role
from papyrine.sources.session import ship_package

HEADING = re.compile(r"(?m)^#{1,6}\s+(.+?)\s*$")
WHOLE_SOURCES = frozenset({"title", "abstract", "summary", "summary.md"})


@dataclass(frozen=True)
class TagRule:
    """A tag of the dictionary: terms are found as whole words, patterns anywhere, both regardless of case."""

    category: str
    tag: str
    terms: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    weight: float = 1.0
    min_score: float = 1.0
    required_sections: tuple[str, ...] = ()
    weak_sections: tuple[str, ...] = ()


def problems(rules: Sequence[TagRule], known: Sequence[tuple[str, str]]) -> list[str]:
    """What is wrong with a dictionary against the (category, tag) pairs of its ontology, in order."""
    out, seen = [], set()
    for r in rules:
        if not r.tag.strip() or not r.category.strip():
            out.append("a rule has no name")
        if (r.category, r.tag) in seen:
            out.append(f"{r.category}/{r.tag} is repeated")
        seen.add((r.category, r.tag))
        for field in ("include", "exclude"):
            for pattern in getattr(r, field):
                try:
                    re.compile(pattern)
                except re.error as e:
                    out.append(f"{r.tag}.{field} has invalid pattern {pattern!r}: {e}")
    out += [f"{c}/{t} of the ontology is missing" for c, t in sorted(set(known) - seen)]
    return out + [f"{c}/{t} is outside the ontology" for c, t in sorted(seen - set(known))]


def term_pattern(term: str) -> str | None:
    """Pattern of a term with any blanks between its words and no word character beside it; None for a blank term."""
    words = term.split()
    return rf"(?<!\w){r'\s+'.join(map(re.escape, words))}(?!\w)" if words else None


#: Characters that a search regardless of case takes for an ASCII letter although they are none in lower case.
ODD_CASES = "\u017f\u212a\u0130\u0131"


def lowered(text: str) -> str | None:
    """The text in lower case where ASCII patterns find the same places in it; None where they might not."""
    if any(c in text for c in ODD_CASES):
        return None
    low = text.lower()
    return low if len(low) == len(text) else None


def _plain(pattern: str) -> bool:
    """Whether a pattern finds in lower case what it finds regardless of case: ASCII without capitals but for escaped classes."""
    return pattern.isascii() and not re.search("[A-Z]", re.sub(r"\\[ABDSWZ]", "", pattern))


class Matcher:
    """A rule with its patterns compiled.

    In a text in lower case a term is looked for by its first word, which takes a fraction of a pattern's time, and the pattern is tried only
    there; other patterns run with regard to case.  A text that has no such form is searched regardless of case.
    """

    def __init__(self, rule: TagRule) -> None:
        self.rule = rule
        own = [(t, term_pattern(t), term_pattern(t.lower()) if t.isascii() else None, t.split()[0].lower()) for t in rule.terms if t.split()]
        own += [(None, p, p if _plain(p) else None, "") for p in rule.include]
        self.patterns = [(name, re.compile(p, re.IGNORECASE), None if quick is None else re.compile(quick), word) for name, p, quick, word in own]
        self.excluded = [re.compile(p, re.IGNORECASE) for p in rule.exclude]

    def _places(self, text: str, low: str | None) -> Iterator[tuple[str, int, int]]:
        for name, slow, quick, word in self.patterns:
            if low is None or quick is None:
                found = slow.finditer(text)
            elif word:
                found = _at(quick, low, word)
            else:
                found = quick.finditer(low)
            for m in found:
                yield name or text[m.start() : m.end()].strip() or slow.pattern, m.start(), m.end()

    def hits(self, text: str, reach: int, low: str | None = None) -> Iterator[tuple[str, int]]:
        """(term, place) of all hits with no exclusion in them or within ``reach`` characters; ``low`` is ``lowered(text)``."""
        for name, start, end in self._places(text, low):
            around = text[max(0, start - reach) : end + reach]
            if not any(x.search(text[start:end]) or x.search(around) for x in self.excluded):
                yield name, start


def _at(pattern: re.Pattern[str], text: str, word: str) -> Iterator[re.Match[str]]:
    """Matches that begin with ``word``, none within another."""
    place = text.find(word)
    while place >= 0:
        m = pattern.match(text, place)
        if m:
            yield m
        place = text.find(word, m.end() if m else place + 1)


class Sections:
    """The last heading before a place of a text."""

    def __init__(self, source: str, text: str) -> None:
        self.source, self.text = source, text
        self.found = [] if source in WHOLE_SOURCES else list(HEADING.finditer(text))
        self.starts = [m.start() for m in self.found]

    def at(self, place: int) -> str:
        i = bisect_right(self.starts, place - 1) - 1
        while i >= 0:
            heading = self.found[i]
            if heading.end() > place:  # within the heading itself, of which only what goes before counts
                heading = HEADING.match(self.text[heading.start() : place])
            if heading:
                return f"{self.source}:{heading.group(1)}"
            i -= 1
        return self.source


def tag_hits(sources: DataFrame, key: str, source: str, text: str, rules: Sequence[TagRule], reach: int = 80) -> DataFrame:
    """(key, source, category, tag, term, section) once for each term and section of a source.

    ``sources`` has a row for each text of a paper.  Hits with an excluded pattern in them or within ``reach``
    characters do not count.  A null or empty text has no hit, a null source is one without a name.  Invalid patterns
    raise.  Runs over Arrow batches, as the places of matches are needed; nothing is shuffled but the distinct rows.
    """
    for r in rules:
        Matcher(r)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = [Matcher(r) for r in rules]
        for frame in frames:
            rows = []
            for k, name, t in zip(frame["k"], frame["source"], frame["t"], strict=True):
                low = lowered(t)
                found = [(m.rule, list(m.hits(t, reach, low))) for m in matchers]
                if any(hits for _, hits in found):
                    sections = Sections(name, t)
                    for r, hits in found:
                        rows += {(k, name, r.category, r.tag, term, sections.at(place)) for term, place in hits}
            yield pd.DataFrame(rows, columns=["k", "source", "category", "tag", "term", "section"]).astype("object")

    ship_package(sources.sparkSession)
    own = sources.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("t"))
    found = own.where(F.length("t") > 0).mapInPandas(run, "k string, source string, category string, tag string, term string, section string")
    return found.distinct().select(F.col("k").cast(sources.schema[key].dataType).alias(key), "source", "category", "tag", "term", "section")


def score_tags(hits: DataFrame, key: str, rules: Sequence[TagRule]) -> DataFrame:
    """(key, category, tag, hits, terms, score, assignable_score, confidence, assigned) of the tags with a score above 0.

    A hit scores its tag's weight times that of its section's role.  Hits in methods, references and a tag's weak
    sections, or outside its required ones, are not assignable.  Confidence is high from twice the least score in
    assignable hits, medium from the least, low below; a tag is assigned unless it is low.
    """
    spark = hits.sparkSession
    schema = "category string, tag string, weight double, least double, required array<string>, weak array<string>"
    table = spark.createDataFrame([(r.category, r.tag, float(r.weight), float(r.min_score), list(r.required_sections), [*E.WEAK_SECTIONS, *r.weak_sections]) for r in rules], schema)
    weights = F.create_map(*[x for role, w in E.SECTION_WEIGHTS for x in (F.lit(role), F.lit(w))])
    rated = hits.join(F.broadcast(table), ["category", "tag"]).withColumn("role", section_role(F.col("source"), F.col("section")))
    points = F.col("weight") * F.coalesce(F.try_element_at(weights, F.col("role")), F.lit(1.0))
    sound = ~F.array_contains("weak", F.col("role")) & ((F.size("required") == 0) | F.array_contains("required", F.col("role")))
    grouped = rated.withColumn("points", points).withColumn("sound", sound).groupBy(key, "category", "tag", "least")
    scored = grouped.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("term").alias("terms"), F.round(F.sum("points"), 3).alias("score"), F.round(F.sum(F.when(F.col("sound"), F.col("points")).otherwise(0.0)), 3).alias("assignable_score"))
    enough = (F.col("score") >= F.col("least")) & (F.col("assignable_score") >= F.col("least"))
    confidence = F.when(~enough, "low").when(F.col("assignable_score") >= 2 * F.col("least"), "high").otherwise("medium")
    return scored.where("score > 0").select(key, "category", "tag", "hits", "terms", "score", "assignable_score", confidence.alias("confidence"), enough.alias("assigned"))
