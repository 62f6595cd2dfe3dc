"""Evidence of a paper as expressions: sections, methods, results and findings; questions and table statistics.

Everything runs on one row, without a shuffle, and but for key results in the JVM.  Rule tables are parameters, the fixed ones of
``evidence_rules`` by default.  A null text counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import evidence_rules as R
from papyrine.functions import type_tables as T
from papyrine.functions.result_sentences import chained_results, key_results
from papyrine.functions.rule_tables import Rules
from papyrine.functions.text import SENTENCE_END, SPACE, strip

LETTER = r"[\p{L}\p{N}_]"
_MARK, _END = "\x01", "\x02"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _has(text: Column, terms: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(t) for t in terms])


def _matches(text: Column, patterns: Sequence[str], flags: str = "") -> Column:
    return reduce(or_, [text.rlike(flags + p) for p in patterns])


def _cascade(text: Column, rules: Rules, default: Column) -> Column:
    """Label of the first rule with a word in the text."""
    out = default
    for label, terms in reversed(rules):
        out = F.when(_has(text, terms), F.lit(label)).otherwise(out)
    return out


def whole_word(terms: Sequence[str]) -> str:
    """Pattern that finds one of the terms with no letter, digit or underscore beside it."""
    edge = r"[^\p{L}\p{N}_]"
    return f"(?:^|{edge})(?:{'|'.join(map(re.escape, terms))})(?:$|{edge})"


def any_letter(pattern: str) -> str:
    """A pattern whose ``\\w`` stands for letters of all scripts."""
    return pattern.replace(r"\w", LETTER)


def from_word(pattern: str) -> str:
    """``any_letter`` of a pattern; one that begins with words is tried at starts of words only."""
    start = f"(?<!{LETTER})" if pattern.startswith(r"(\w+") else ""
    return start + any_letter(pattern)


def sentences(text: Column) -> Column:
    """Structs (place, s, low) of the sentences in order, trimmed, ``low`` in lower case."""
    return F.transform(_sentences(text), lambda x: F.struct(x["place"], x["s"], F.lower(x["s"]).alias("low")))


def _sentences(text: Column) -> Column:
    parts = F.transform(F.split(_text(text), SENTENCE_END), strip)
    return F.transform(parts, lambda s, i: F.struct(i.alias("place"), s.alias("s")))


def heading_label(line: Column, rules: Rules = R.SECTIONS) -> Column:
    """Section that a line is the heading of, else null: a short line that a rule's pattern finds.

    Lines below 80 characters may be headings, those below 100 if they are words in letters after a number.  Results
    that name a discussion, and the other way round, are the combined section.
    """
    titled = (F.length(line) < 100) & line.rlike(rf"^(?:[0-9]+\.?{SPACE}*)?[A-Z](?:[A-Za-z&]|{SPACE})+$")
    found: Column = F.lit(None).cast("string")
    for name, patterns in reversed(rules):
        label: Column = F.lit(name)
        other = {"results": "discussion", "discussion": "result"}.get(name)
        if other:
            label = F.when(F.lower(line).contains(other), F.lit(R.COMBINED)).otherwise(label)
        found = F.when(_matches(line, patterns, "(?i)"), label).otherwise(found)
    return F.when((F.length(line) < 80) | titled, found)


def sections(text: Column, rules: Rules = R.SECTIONS, most: int | None = None) -> Column:
    """Structs (section, text, quality) of all sections of ``rules`` and the combined one, in this order.

    A section is the lines after its headings, joined by spaces; repeated headings add to it.  Quality is ``found``
    above 80 characters, ``combined`` where results or discussion come from the combined section, ``fallback_full``
    where the lines before all headings stand in (below 500 characters: the whole text), ``missing`` otherwise.  An
    empty, blank or null text has no section.  ``most`` cuts sections; without it they are whole.  The control
    characters U+0001 and U+0002 are left out.
    """
    names = [name for name, _ in rules]

    def cut(c: Column) -> Column:
        return c if most is None else F.substring(c, 1, most)

    def build(raw: Column) -> Column:
        lines = F.filter(F.transform(F.split(raw, "\n"), strip), lambda x: x != "")
        marked = F.transform(lines, lambda x: F.coalesce(F.concat(F.lit(_MARK), heading_label(x, rules), F.lit(_END)), x))
        joined = F.concat(F.lit("body" + _END), F.array_join(marked, " "))
        pieces = F.transform(F.split(joined, _MARK), lambda p: F.struct(F.substring_index(p, _END, 1).alias("k"), F.btrim(F.substring_index(p, _END, -1)).alias("t")))
        return _let(pieces, lambda ps: assemble(raw, ps))

    def assemble(raw: Column, pieces: Column) -> Column:
        def of(name: str) -> Column:
            return F.array_join(F.transform(F.filter(pieces, lambda p: (p["k"] == name) & (p["t"] != "")), lambda p: p["t"]), " ")

        parts = F.struct(*[of(n).alias(n) for n in [*names, R.COMBINED, "body"]], raw.alias("raw"))
        return _let(parts, rate)

    def rate(p: Column) -> Column:
        full = F.when(~p["raw"].rlike(f"(?s)(?!{SPACE})."), "").when(F.length(p["body"]) < 500, p["raw"]).otherwise(p["body"])
        both = F.length(p[R.COMBINED]) > 80
        out = []
        for n in names:
            own = F.length(p[n]) > 80
            shared = both if n in ("results", "discussion") else F.lit(False)
            quality = F.when(own, "found").when(shared, "combined").when(full != "", "fallback_full").otherwise("missing")
            out.append(F.struct(F.lit(n).alias("section"), cut(F.when(own, p[n]).when(shared, p[R.COMBINED]).when(full != "", full).otherwise(p[n])).alias("text"), quality.alias("quality")))
        rated = F.struct(F.lit(R.COMBINED).alias("section"), cut(p[R.COMBINED]).alias("text"), F.when(both, "found").otherwise("missing").alias("quality"))
        return F.array(*out, rated)

    return _let(F.translate(_text(text), _MARK + _END, ""), build)


def section_texts(found: Column) -> Column:
    """Map from section to text of a ``sections``."""
    return F.map_from_entries(F.transform(found, lambda s: F.struct(s["section"], s["text"])))


def _unlike(items: Column, key: str, most: int) -> Column:
    """The first ``most`` structs with different ``key``."""

    def take(xs: Column) -> Column:
        return F.aggregate(xs, F.slice(xs, 1, 0), lambda a, x: F.when((F.size(a) >= most) | F.exists(a, lambda y: y[key] == x[key]), a).otherwise(F.concat(a, F.array(x))))

    return _let(items, take)


def core_findings(conclusion: Column, abstract: Column, results: Column, phrases: Sequence[str] = R.CONCLUDING, most: int = 3) -> Column:
    """Up to ``most`` structs (finding, quote, section, confidence): what the authors conclude.

    Sentences of 30 to 500 characters of the conclusion, then of the abstract, that hold a concluding phrase (medium)
    or stand after 70 % of the sentences (low); texts below 50 characters have none.  With fewer than two, the first
    two ``results`` of high confidence follow.  Sentences alike in their first 60 characters count once.
    """

    def of(text: Column, section: str) -> Column:
        def pick(all_of: Column) -> Column:
            sized = F.filter(all_of, lambda x: F.length(x["s"]).between(30, 500))
            rated = F.transform(sized, lambda x: F.struct(x["s"].alias("s"), F.substring(x["low"], 1, 60).alias("key"), _matches(x["s"], phrases, "(?i)").alias("told"), (x["place"] > F.lit(0.7) * F.size(all_of)).alias("late")))
            taken = F.filter(rated, lambda x: x["told"] | x["late"])
            return F.transform(taken, lambda x: _finding(x["s"], x["s"], x["key"], section, F.when(x["told"], "medium").otherwise("low")))

        return _let(sentences(F.when(F.length(_text(text)) >= 50, text).otherwise("")), pick)

    sure = F.slice(F.filter(results, lambda r: r["confidence"] == "high"), 1, 2)
    more = F.transform(sure, lambda r: _finding(r["result"], r["quote"], F.lower(F.substring(r["result"], 1, 60)), "Results", F.lit("medium")))
    own = _unlike(F.concat(of(conclusion, "Conclusion"), of(abstract, "Abstract")), "key", max(most, 2))
    found = _let(own, lambda o: _unlike(F.when(F.size(o) < 2, F.concat(o, more)).otherwise(o), "key", most))
    return F.transform(found, lambda x: x.dropFields("key"))


def _finding(text: Column, quote: Column, key: Column, section: str, confidence: Column) -> Column:
    return F.struct(F.substring(text, 1, 300).alias("finding"), F.substring(quote, 1, 200).alias("quote"), F.lit(section).alias("section"), confidence.alias("confidence"), key.alias("key"))


def method_type(term: str, rules: Rules = R.METHOD_TYPES) -> str:
    """Type of a method term, by the first rule with a fragment of it."""
    return next((label for label, parts in rules if any(p in term for p in parts)), "experiment")


def methods(text: Column, terms: Sequence[str] = R.METHOD_TERMS, phrases: Sequence[str] = R.METHOD_PHRASES, most: int = 12) -> Column:
    """The first ``most`` structs (name, kind, quote, confidence): terms, longest first, then phrases around a method.

    A term is quoted with 60 characters on both sides of its first place, terms of one length go by name.  Phrases of
    more than 15 characters count once by their first 40; names alike in 30 characters count once.
    """
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))

    def term(raw: Column, low: Column, name: str) -> Column:
        at = F.instr(low, name)
        start = F.greatest(at - 60, F.lit(1))
        quote = strip(F.substr(raw, start, at + F.lit(len(name) + 60) - start))
        return F.when(low.contains(name), _method(F.lit(name), F.substring(quote, 1, 200), method_type(name), "medium"))

    needs = dict(zip(R.METHOD_PHRASES, R.METHOD_PHRASE_WORDS, strict=True))

    def matches(raw: Column, low: Column, p: str) -> Column:
        every = F.regexp_extract_all(raw, F.lit("(?i)" + from_word(p)), 0)
        return F.when(_has(low, needs[p]), every).otherwise(F.array().cast("array<string>")) if p in needs else every

    def phrase(raw: Column) -> Column:
        each = _let(F.lower(raw), lambda low: F.concat(*[matches(raw, low, p) for p in phrases]))
        cut = F.filter(F.transform(each, strip), lambda m: F.length(m) > 15)
        headed = F.transform(cut, lambda m: F.struct(m.alias("m"), F.lower(F.substring(m, 1, 40)).alias("h")))
        first = _let(headed, lambda z: _let(F.transform(z, lambda y: y["h"]), lambda hs: F.filter(z, lambda x, i: F.array_position(hs, x["h"]) == i + 1)))
        return F.transform(first, lambda x: _method(F.substring(x["m"], 1, 200), F.substring(x["m"], 1, 200), "experiment", "low"))

    def build(raw: Column) -> Column:
        found = _let(F.lower(raw), lambda low: F.array_compact(F.array(*[term(raw, low, t) for t in ordered])))
        return F.transform(_unlike(F.concat(found, phrase(raw)), "key", most), lambda x: x.dropFields("key"))

    return _let(_text(text), build)


def _method(name: Column, quote: Column, kind: str, confidence: str) -> Column:
    key = F.substring(F.regexp_replace(F.lower(name), r"\s+", " "), 1, 30)
    return F.struct(name.alias("name"), F.lit(kind).alias("kind"), quote.alias("quote"), F.lit(confidence).alias("confidence"), key.alias("key"))


def method_noise(text: Column, generic: Sequence[str] = R.GENERIC_METHODS, specific: Sequence[str] = R.SPECIFIC_METHODS) -> tuple[Column, Column]:
    """(noise, flags) of a method text: it is noise if no specific word names a method."""
    low = F.lower(_text(text))
    bare = ~_has(low, specific)
    flags = [(_has(low, generic), "generic_method_phrase"), (bare, "missing_specific_method_name"), (F.length(strip(low)) < 50, "low_information_method")]
    return bare, F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))


def out_of_scope(text: Column, outside: Sequence[str] = R.OUT_OF_SCOPE, inside: Sequence[str] = R.IN_SCOPE) -> Column:
    """Whether a question has a word from outside the collection and none from inside."""
    low = F.lower(_text(text))
    return _has(low, outside) & ~_has(low, inside)


def entity_question(text: Column) -> Column:
    """Whether a question names an entity and asks for supplementary data, a place or a kind of entity."""
    asked, low = _text(text), F.lower(_text(text))
    names = F.filter(F.regexp_extract_all(asked, F.lit(R.ENTITY_NAME), 0), lambda n: ~n.isin(*R.NOT_ENTITIES))
    return (F.size(names) > 0) & (_has(low, R.SUPPLEMENT_WORDS + R.ENTITY_WORDS) | _matches(asked, [any_letter(p) for p in R.PLACE_PHRASES], "(?i)"))


def literature_intent(text: Column, rules: Rules = R.LITERATURE_INTENTS, late: Rules = R.LATE_INTENTS, comparing: Sequence[str] = R.COMPARING) -> Column:
    """Intent of a question to the literature agent: the first rule with a word in it, entities before the late rules."""
    low, named = F.lower(_text(text)), entity_question(text)
    other = _cascade(low, late, F.lit("hybrid_search"))
    other = F.when(named & _has(low, comparing), "supplementary_entity_comparison_query").when(named, "supplementary_entity_query").otherwise(other)
    return _cascade(low, rules, other)


def two_tiers(words: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]], strong: tuple[float, float, float], fair: tuple[float, float, float], weak: float, least: int) -> Column:
    """Structs (label, confidence) of the types with a word in the text, in order.

    A rule is (label, strong words, weak words); each hit counts, repeated words too.  With ``base, step, most`` of
    a tier, a type scores ``min(base + step * hits, most)`` by strong words, else by ``least`` weak words or more,
    else ``weak`` by one.
    """

    def score(tier: tuple[float, float, float], n: Column) -> Column:
        return F.least(F.lit(tier[0]) + F.lit(tier[1]) * n, F.lit(tier[2]))

    def hits(w: Column, terms: Column) -> Column:
        return F.size(F.filter(terms, lambda t: F.contains(w, t)))

    def rated(x: Column) -> Column:
        n, m = x["n"], x["m"]
        c = F.when(n > 0, score(strong, n)).when(m >= least, score(fair, m)).when(m > 0, F.lit(weak))
        return F.struct(x["label"].alias("label"), F.round(c, 6).alias("confidence"))

    # one literal and lambdas: each word is looked for once a row, and the plan stays small
    known = F.array(*[F.struct(F.lit(label).alias("label"), _strings(high).alias("high"), _strings(low).alias("low")) for label, high, low in rules])
    counted = _let(words, lambda w: F.transform(known, lambda r: F.struct(r["label"].alias("label"), hits(w, r["high"]).alias("n"), hits(w, r["low"]).alias("m"))))
    return F.transform(F.filter(counted, lambda x: x["n"] + x["m"] > 0), rated)


def _strings(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t.lower()) for t in terms]).cast("array<string>")


def best_type(scored: Column) -> Column:
    """Struct (label, confidence, alternatives) of ``two_tiers``: the first type of highest confidence.

    Alternatives are the first three others above 0.3, in the order in which they are passed over.  Without a
    type the label is unknown, with confidence 0.
    """
    names = F.array().cast("array<string>")
    start = F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"), names.alias("alternatives"))

    def step(a: Column, x: Column) -> Column:
        better = x["confidence"] > a["confidence"]
        lost = F.when(better, F.when(a["confidence"] > 0.3, a["label"])).otherwise(F.when(x["confidence"] > 0.3, x["label"]))
        more = F.when(lost.isNull(), a["alternatives"]).otherwise(F.concat(a["alternatives"], F.array(lost)))
        return F.struct(F.when(better, x["label"]).otherwise(a["label"]).alias("label"), F.greatest(a["confidence"], x["confidence"]).alias("confidence"), more.alias("alternatives"))

    return F.aggregate(scored, start, step, lambda a: a.withField("alternatives", F.slice(a["alternatives"], 1, 3)))


def reason(words: Column, label: Column, rules: T.Tiers, least: int, told: Sequence[str]) -> Column:
    """Why ``two_tiers`` gave a type: its tier and the first five strong or weak words, of one weak word that alone."""

    def of(place: int) -> Column:
        known = F.create_map(*[x for rule in rules for x in (F.lit(rule[0]), F.array(*map(F.lit, rule[place])).cast("array<string>"))])
        return F.filter(F.coalesce(F.try_element_at(known, label), F.array().cast("array<string>")), lambda t: words.contains(F.lower(t)))

    def listed(start: str, found: Column, most: int) -> Column:
        return F.concat(F.lit(start), F.array_join(F.slice(found, 1, most), ", "))

    def why(strong: Column, weak: Column) -> Column:
        return F.when(F.size(strong) > 0, listed(told[0], strong, 5)).when(F.size(weak) >= least, listed(told[1], weak, 5)).when(F.size(weak) > 0, listed(told[2], weak, 1)).otherwise(told[3])

    return _let(F.struct(of(1).alias("strong"), of(2).alias("weak")), lambda x: why(x["strong"], x["weak"]))


def key_columns(label: Column, headers: Column, rules: Rules = T.KEY_COLUMNS) -> Column:
    """Structs (key, columns) of the keys of a table type that some header contains, in any case."""
    known = F.create_map(*[x for name, keys in rules for x in (F.lit(name), F.array(*map(F.lit, keys)))])
    keys = F.coalesce(F.try_element_at(known, label), F.array().cast("array<string>"))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(headers, lambda h: F.contains(F.lower(h), k)).alias("columns")))
    return F.filter(pairs, lambda p: F.size(p["columns"]) > 0)


def subtype(words: Column, label: Column, rules: Sequence[tuple[str, Sequence[tuple[str, str]]]] = T.SUBTYPES) -> Column:
    """Subtype of a figure type: that of the first word found, else empty."""
    out: Column = F.lit("")
    for name, kinds in rules:
        own: Column = F.lit("")
        for word, kind in reversed(kinds):
            own = F.when(words.contains(word), kind).otherwise(own)
        out = F.when(label == name, own).otherwise(out)
    return out


def _header(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), r"[_\-.]", " ")


def stat_fields(headers: Column, fields: Sequence[tuple[str, str, Sequence[str]]] = R.STAT_FIELDS) -> Column:
    """Structs (field, category, columns) of the statistical fields that some header names."""

    def field(named: Column, name: str, category: str, words: Sequence[str]) -> Column:
        hit = F.transform(F.filter(named, lambda x: _has(x["low"], words)), lambda x: x["h"])
        return F.struct(F.lit(name).alias("field"), F.lit(category).alias("category"), hit.alias("columns"))

    # a header is put in lower case once, not for every word
    named = F.transform(headers, lambda h: F.struct(h.alias("h"), _header(h).alias("low")))
    return _let(named, lambda ns: F.filter(F.array(*[field(ns, *f) for f in fields]), lambda f: F.size(f["columns"]) > 0))


def stat_confidence(found: Column) -> Column:
    """Confidence of a table's ``stat_fields``: 0.3 and 0.1 for each, 0.9 at most; 0 without any."""
    n = F.size(found)
    return F.when(n > 0, F.round(F.least(F.lit(0.3) + F.lit(0.1) * n, F.lit(0.9)), 2)).otherwise(F.lit(0.0))


def p_thresholds(headers: Column, rows: Column, words: Sequence[str] = R.P_COLUMNS, most: int = 20) -> Column:
    """Struct (low, high, below_05, below_01, below_001) of the first p column's values in 0 to 1; null without any.

    Rows are arrays of strings, of which the first ``most`` are read; what is no number does not count.
    """
    def numbers(at: Column) -> Column:
        cells = F.transform(F.slice(rows, 1, most), lambda r: F.when(at > 0, F.try_element_at(r, at.cast("int"))).try_cast("double"))
        return F.filter(cells, lambda v: v.between(0, 1))

    # the column is found once, not for every row
    lows = F.transform(headers, _header)
    values = _let(F.array_position(F.transform(lows, lambda h: _has(h, words)), True), numbers)

    def below(vs: Column, limit: float) -> Column:
        return F.size(F.filter(vs, lambda v: v < limit))

    def told(vs: Column) -> Column:
        return F.struct(F.round(F.array_min(vs), 6).alias("low"), F.round(F.array_max(vs), 6).alias("high"), below(vs, 0.05).alias("below_05"), below(vs, 0.01).alias("below_01"), below(vs, 0.001).alias("below_001"))

    return _let(values, lambda vs: F.when(F.size(vs) > 0, told(vs)))
