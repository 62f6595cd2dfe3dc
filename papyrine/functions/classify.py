"""Classifiers and rubrics as expressions over rule tables.

Rule tables are parameters, the fixed ones of ``rule_tables`` by default.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import rule_tables as R
from papyrine.functions.text import SENTENCE_END, strip


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _hits(text: Column, terms: Sequence[str], literal: bool) -> Column:
    return reduce(add, [(text.contains(t) if literal else text.rlike(t)).cast("int") for t in terms])


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(or_, [text.rlike(p) for p in patterns])


def steps(base: float, step: float, most: float) -> int:
    """Hits from which the score stays at ``most``."""
    return ceil((most - base) / step - 1e-9)


def best_of(text: Column, rules: R.Rules, most_hits: int, literal: bool = False) -> Column:
    """Struct (n, first, label) of the category with most hits, counted to ``most_hits``; ties go to the first named."""
    found = [F.struct(F.least(_hits(text, terms, literal), F.lit(most_hits)).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("label")) for i, (name, terms) in enumerate(rules)]
    return F.greatest(*found)


def scored(best: Column, base: float, step: float, most: float, default: str, least: float) -> tuple[Column, Column]:
    """(label, confidence) of a ``best_of``; ``default`` with ``least`` where nothing was hit."""
    some = best["n"] > 0
    score = F.round(F.least(F.lit(base) + F.lit(step) * best["n"], F.lit(most)), 2)
    return F.when(some, best["label"]).otherwise(default), F.when(some, score).otherwise(F.lit(least))


def intent(text: Column, rules: R.Rules = R.QUERY_INTENTS) -> Column:
    """``best_of`` the intents of a question, to be read by ``scored(…, .4, .2, .95, default, .3)``."""
    return best_of(F.lower(_text(text)), rules, steps(0.4, 0.2, 0.95))


def tool_plan(label: Column, plans: R.Rules = R.TOOL_PLANS, other: str = "cross_asset_query") -> Column:
    """Tools of an intent in order; those of an unknown intent are ``other`` alone."""
    known = F.create_map(*[x for name, tools in plans for x in (F.lit(name), F.array(*map(F.lit, tools)))])
    return F.coalesce(F.try_element_at(known, label), F.array(F.lit(other)))


def dataset_words(headers: Column, cells: Column, caption: Column) -> Column:
    """The text that dataset types are read from: headers, caption and cells, lower-case, with _ - . as spaces."""
    words = F.concat_ws(" ", F.array_join(headers, " "), _text(caption), F.array_join(cells, " "))
    return F.regexp_replace(F.lower(words), r"[_\-.]", " ")


def dataset_type(words: Column, rules: R.Rules = R.DATASET_TYPES) -> Column:
    """``best_of`` the dataset types, to be read by ``scored(…, .7, .05, .95, "unknown", 0)``."""
    low = tuple((name, tuple(t.lower() for t in terms)) for name, terms in rules)
    return best_of(words, low, steps(0.7, 0.05, 0.95), literal=True)


def matched_keywords(words: Column, label: Column, rules: R.Rules = R.DATASET_TYPES, most: int = 5) -> Column:
    """The first ``most`` keywords of the named type that occur."""
    known = F.create_map(*[x for name, terms in rules for x in (F.lit(name), F.array(*map(F.lit, terms)))])
    terms = F.coalesce(F.try_element_at(known, label), F.array().cast("array<string>"))
    return F.slice(F.filter(terms, lambda t: F.contains(words, F.lower(t))), 1, most)


def key_columns(headers: Column, keywords: Column) -> Column:
    """Structs (keyword, headers that contain it) of the keywords that some header contains."""
    pairs = F.transform(keywords, lambda k: F.struct(k.alias("keyword"), F.filter(headers, lambda h: F.contains(F.lower(h), F.lower(k))).alias("headers")))
    return F.filter(pairs, lambda p: F.size(p["headers"]) > 0)


def section_role(source: Column, section: Column, rules: R.Rules = R.SECTION_ROLES) -> Column:
    """Role of a section: that of its source, else by its heading, which follows the first colon; raw_text if no rule fits."""
    name, whole = F.lower(_text(source)), _text(section)
    heading = F.regexp_replace(F.regexp_replace(whole, "^[^:]*:", ""), "<[^>]+>", " ")
    heading = F.regexp_replace(heading, r"\s+", " ")
    heading = F.lower(F.btrim(heading))
    out: Column = F.lit("raw_text")
    for role, patterns in reversed(rules):
        out = F.when(_any(heading, patterns), role).otherwise(out)
    out = F.when(heading == "", "unknown").otherwise(out)
    own = F.when(name == "summary.md", "summary").when(name.isin(*R.OWN_ROLES), name)
    return F.coalesce(own, out)


def evidence_role(kind: Column, confidence: Column, boilerplate: Column, has_links: Column) -> Column:
    """Role of a chunk in an evidence packet; boilerplate goes first, then claims, results and figures by kind."""
    claim = kind == "claim"
    weak = (confidence == "low") | ((confidence == "medium") & ~has_links)
    out = F.when(boilerplate, "boilerplate").when(claim & weak, "weak_claim").when(claim, "claim")
    out = out.when(kind == "result", "supporting_result").when(kind == "figure", "figure_context")
    return out.when(confidence == "low", "weak_evidence").when(confidence == "high", "direct_evidence").otherwise("background")


def relation(sentence: Column, before: Column, rules: R.Rules = R.RELATIONS) -> Column:
    """Relation of a mention to its asset: the first rule with a word in the sentence or what goes before it."""
    context = F.lower(F.concat(_text(sentence), F.lit(" "), _text(before)))
    out: Column = F.lit("unknown")
    for label, terms in reversed(rules):
        out = F.when(reduce(or_, [context.contains(t) for t in terms]), label).otherwise(out)
    return out


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _bonus(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def gap_quality(evidence: Column, statement: Column, confidence: Column, kind: Column, missing: Column, why: Column) -> dict[str, Column]:
    """Evidence, specificity and novelty of a gap, unrounded, and the risk that it claims too much.

    Null evidence counts as none, a null confidence as 0.5, other nulls as empty.
    """
    items = F.coalesce(evidence, F.array().cast("array<string>"))
    n, short = F.size(items), F.size(F.filter(items, lambda e: F.length(e) < 20))
    grounded = F.when(n == 0, 0.1).when(n == 1, 0.5).when(n == 2, 0.7).otherwise(0.9)
    grounded = _clip(grounded - F.when(short > 0, F.lit(0.2) * short / n).otherwise(F.lit(0.0)))
    said = _text(statement)
    low, size = F.lower(said), F.length(said)
    specific = F.when(size < 30, 0.2).when(size > 100, 0.8).otherwise(0.5) + _bonus(_any(low, R.VAGUE_GAPS), -0.3)
    specific = _clip(specific + _bonus(said.rlike(R.GAP_ENTITY), 0.15) + _bonus(low.rlike(R.GAP_PATHWAY), 0.1))
    novel: Column = F.lit(0.6)
    for name, points in reversed(R.GAP_NOVELTY):
        novel = F.when(F.lower(_text(kind)) == name, points).otherwise(novel)
    novel = _clip(novel + _bonus((F.length(_text(missing)) < 10) | (F.length(_text(why)) < 10), -0.2))
    sure = F.coalesce(confidence, F.lit(0.5))
    high = ((sure > 0.85) & (grounded < 0.4)) | ((sure > 0.7) & (grounded < 0.3))
    medium = ((sure > 0.8) & (grounded < 0.6)) | ((sure > 0.7) & (grounded < 0.5))
    return {"grounding": grounded, "specificity": specific, "novelty": novel, "overclaim": F.when(high, "high").when(medium, "medium").otherwise("low")}


def hypothesis_quality(prediction: Column, experiment: Column, rationale: Column, supporting: Column, gap_valid: Column, statement: Column) -> dict[str, Column]:
    """Testability, rationale and feasibility of a hypothesis, unrounded, its over-specificity and the warnings it matches."""
    told, done, ground = _text(prediction), _text(experiment), _text(rationale)
    low = F.lower(told)
    test = F.when(F.length(told) > 80, 0.8).when(F.length(told) > 30, 0.6).otherwise(0.3)
    test = _clip(test + _bonus(low.rlike(R.DIRECTION), 0.1) + _bonus(low.rlike(R.MEASURABLE), 0.1))
    n = F.size(F.coalesce(supporting, F.array().cast("array<string>")))
    reason = F.when(F.length(ground) > 80, 0.7).when(F.length(ground) > 30, 0.5).otherwise(0.3)
    reason = _clip(reason + _bonus(n >= 2, 0.15) + _bonus(n >= 1, 0.1) + _bonus(gap_valid, 0.1))
    able = F.when(F.length(done) > 100, 0.7).when(F.length(done) > 40, 0.5).otherwise(0.3)
    able = _clip(able + _bonus(done.rlike(R.TECHNIQUE), 0.15) + _bonus(F.lower(done).rlike(R.MODEL_SYSTEM), 0.1))
    narrow = _hits(done, R.OVER_SPECIFIC, literal=False)
    whole = F.concat_ws(" ", _text(statement), done, told)
    warnings = F.array_compact(F.array(*[F.when(whole.rlike(p), F.lit(p)) for p in R.DANGEROUS]))
    return {
        "testability": test,
        "rationale": reason,
        "feasibility": able,
        "over_specific": F.when(narrow >= 2, "high").when(narrow == 1, "medium").otherwise("low"),
        "warnings": warnings,
    }


def weighted(parts: Sequence[Column], weights: Sequence[float], places: int = 3) -> Column:
    """Sum of the parts by their weights, rounded."""
    return F.round(reduce(add, [p * F.lit(w) for p, w in zip(parts, weights, strict=True)]), places)


def discussion_points(text: Column, rules: R.Rules = R.DISCUSSION, most: int = 10) -> Column:
    """The first ``most`` sentences of 30 to 500 characters, as structs (place, point, quote, kind, confidence).

    Of sentences with equal first 60 characters in lower case the first is taken.  A null text gives an empty array.
    Only the sentences taken are classified, and no more than ``most`` are held while a text is read.
    """
    sentences = F.transform(F.split(_text(text), SENTENCE_END), lambda s, i: F.struct(i.alias("place"), strip(s).alias("s")))
    sized = F.filter(sentences, lambda x: F.length(x["s"]).between(30, 500))
    keyed = F.transform(sized, lambda x: F.struct(x["place"].alias("place"), x["s"].alias("s"), F.lower(F.substring(x["s"], 1, 60)).alias("key")))
    none = F.slice(keyed, 1, 0)
    taken = F.aggregate(keyed, none, lambda a, x: F.when((F.size(a) >= most) | F.exists(a, lambda y: y["key"] == x["key"]), a).otherwise(F.concat(a, F.array(x))))
    return F.transform(taken, lambda x: _discussion_point(x["place"], x["s"], rules))


def _discussion_point(place: Column, sentence: Column, rules: R.Rules) -> Column:
    low = F.lower(sentence)
    counts = [F.struct(reduce(add, [F.regexp_count(low, F.lit(p)) for p in terms]).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("kind")) for i, (name, terms) in enumerate(rules)]
    top = F.greatest(*counts)
    kind, sure = F.when(top["n"] > 0, top["kind"]).otherwise("interpretation"), F.when(top["n"] >= 2, "medium").otherwise("low")
    return F.struct(place.alias("place"), F.substring(sentence, 1, 300).alias("point"), F.substring(sentence, 1, 200).alias("quote"), kind.alias("kind"), sure.alias("confidence"))


def guardrails(answer: Column, refs: Column, without_provenance: Column, without_path: Column, words: Sequence[str] = R.OVERCLAIM) -> tuple[Column, Column]:
    """(issues, risk) of an answer with ``refs`` references, of which so many lack provenance or a path.

    Two strong words with at most two references claim too much; each reference without a path is an issue of its
    own, references without provenance are one.  Null counts are none.
    """
    n, bare, lost = (F.coalesce(c, F.lit(0)).cast("int") for c in (refs, without_provenance, without_path))
    strong = _hits(F.lower(_text(answer)), words, literal=True)
    flags = [((strong >= 2) & (n <= 2), "overclaim_risk"), (n == 0, "no_references"), (bare > 0, "missing_provenance")]
    named = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))
    issues = F.concat(named, F.array_repeat(F.lit("no_source_path"), lost))
    risk = F.when(F.size(issues) >= 3, "high").when(F.size(issues) > 0, "medium").otherwise("low")
    return issues, risk


def caption_kind(caption: Column, mentions: Column, rules: R.Rules) -> Column:
    """Kind of a figure (``FIGURE_KINDS``) or table (``TABLE_KINDS``): the first rule with a word in caption or mentions."""
    return relation(caption, mentions, rules)
