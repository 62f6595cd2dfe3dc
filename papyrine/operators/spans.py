"""Places in texts: mentions of figures, tables and data, references to supplements, and captions.

Patterns need places, which no built-in expression gives, so they run over Arrow batches: each pattern goes once over a text, and what a
text gives is a few rows.  Labels, quality and other columns are expressions on these rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import span_rules as R
from papyrine.sources.session import ship_package

_FIELDS = {"string": pa.string(), "int": pa.int32()}
Span = tuple[str, re.Match[str]]


def _rows(texts: DataFrame, key: str, text: str, fields: dict[str, str], find: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """Rows of ``find`` for each text, behind its key."""
    ship_package(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(find(t)) for t in batch.column(1).to_pylist()]
            index = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32())
            flat = [r for rows in found for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), *[pa.array([r[j] for r in flat], _FIELDS[f]) for j, f in enumerate(fields.values())]], names=["k", *fields])

    given = texts.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return given.mapInArrow(run, f"k {kind}, " + ", ".join(f"`{n}` {f}" for n, f in fields.items())).withColumnRenamed("k", key)


def _compiled(rules: R.Patterns) -> list[tuple[str, re.Pattern[str]]]:
    return [(kind, re.compile(p, re.IGNORECASE)) for kind, p in rules]


#: Other characters that a pattern regardless of case takes for an ASCII letter.
_ALIKE = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))


def possible(text: str, patterns: Sequence[tuple[str, re.Pattern[str]]]) -> list[tuple[str, re.Pattern[str]]]:
    """Patterns without those whose needed words are all missing from the text."""
    for other, letter in () if text.isascii() else _ALIKE:
        text = text.replace(other, letter)
    low = text.lower()
    return [(kind, p) for kind, p in patterns if p.pattern not in R.NEEDED or any(w in low for w in R.NEEDED[p.pattern])]


def outer_spans(text: str, patterns: Sequence[tuple[str, re.Pattern[str]]]) -> Iterator[Span]:
    """Matches pattern by pattern, without those inside a match of an earlier pattern."""
    seen: list[tuple[int, int]] = []
    starts: list[int] = []
    reach: list[int] = []
    for kind, pattern in possible(text, patterns):
        own = []
        for m in pattern.finditer(text):
            at = bisect_right(starts, m.start()) - 1
            if (at < 0 or reach[at] < m.end()) and m.group().strip():
                own.append(m.span())
                yield kind, m
        if own:
            seen = sorted(seen + own)
            starts, reach = [s for s, _ in seen], list(accumulate((e for _, e in seen), max))


_MARKS = re.compile(r"[.!?\n]")


def sentence_at(text: str, start: int, end: int, marks: Sequence[int] | None = None) -> str:
    """The sentence or line around a place, with its end mark; ``marks`` are the places of all end marks of the text, if known."""
    if marks is None:
        marks = [m.start() for m in _MARKS.finditer(text)]
    before, behind = bisect_left(marks, start), bisect_left(marks, end)
    begin = marks[before - 1] + 1 if before else 0
    return text[begin : marks[behind] + 1 if behind < len(marks) else len(text)].strip()


def _number(m: re.Match[str]) -> str:
    return (m.group(1) or "").strip() if m.re.groups else ""


def mentions(texts: DataFrame, key: str, text: str, *, rules: R.Patterns = R.MENTIONS, around: int = R.AROUND_MENTION, context: bool = True) -> DataFrame:
    """A row for each mention: key, kind, start, end, found, label, asset_type, subpanel, supplementary, and with ``context`` sentence, before, after.

    Patterns go in order, and a match inside an earlier one is left out.  Places are code points, end exclusive; the sentence has 500 characters
    at most, before and after are ``around`` characters, trimmed.  Null and empty texts have no row.
    """
    patterns = _compiled(rules)

    def find(t: str) -> Iterator[tuple]:
        marks = [m.start() for m in _MARKS.finditer(t)] if context else []
        for kind, m in outer_spans(t, patterns):
            a, b = m.span()
            if not context:
                yield kind, a, b, m.group().strip()
                continue
            yield kind, a, b, m.group().strip(), sentence_at(t, a, b, marks)[:500], t[max(0, a - around) : a].strip(), t[b : b + around].strip()

    beside = {"sentence": "string", "before": "string", "after": "string"} if context else {}
    fields = {"kind": "string", "start": "int", "end": "int", "found": "string", **beside}
    found = _rows(texts, key, text, fields, find)
    told = label_of(F.col("found"))
    return found.withColumn("told", told).select(key, "kind", "start", "end", "found", "told.*", *beside)


def label_of(found: Column) -> Column:
    """Struct (label, asset_type, subpanel, supplementary) of a mention such as ``Suppl. Fig. S1A``.

    A letter behind the number is the panel; labels of supplements have an S before the number.  What is neither figure, table nor data is its own label.
    """
    prefixed = found.rlike(f"(?i){R.SUPPLEMENT_PREFIX}")
    extra = prefixed | found.rlike(r"\bS\d+")
    named: Column = F.when(found.rlike(f"(?i){R.SUPPLEMENT_LABEL}"), _label(F.regexp_extract(found, f"(?i){R.SUPPLEMENT_LABEL}", 0), "supplementary", F.lit(""), F.lit(True))).otherwise(_label(found, "unknown", F.lit(""), extra))
    for kind, word, pattern in reversed(R.LABELS):
        number = F.trim(F.regexp_extract(found, f"(?i){pattern}", 1))
        panel = F.upper(F.regexp_extract(number, r"^S?\d+([A-Za-z])$", 1))
        bare = F.when(panel != "", F.regexp_extract(number, r"^(S?\d+)[A-Za-z]$", 1)).otherwise(number)
        full = F.concat(F.lit(f"{word} "), F.when(extra & ~bare.startswith("S"), F.lit("S")).otherwise(F.lit("")), bare)
        named = F.when(number != "", _label(full, kind, panel, extra)).otherwise(named)
    return named


def _label(label: Column, kind: str, panel: Column, extra: Column) -> Column:
    return F.struct(label.alias("label"), F.lit(kind).alias("asset_type"), panel.alias("subpanel"), extra.alias("supplementary"))


def supplement_references(texts: DataFrame, key: str, text: str, *, rules: R.Patterns = R.SUPPLEMENTS, around: int = R.AROUND_REFERENCE) -> DataFrame:
    """A row for each type and number that a text refers to: key, ref_type, number, label, referenced_as, start, source_text, of its first place.

    A reference without a number counts once for its type.  ``source_text`` is the match with ``around`` characters on both sides.
    """
    patterns = _compiled(rules)

    def find(t: str) -> Iterator[tuple]:
        for kind, pattern in possible(t, patterns):
            seen = set()
            for m in pattern.finditer(t):
                number = _number(m)
                if number not in seen:
                    seen.add(number)
                    yield kind, number, m.group().strip(), m.start(), t[max(0, m.start() - around) : m.end() + around].strip()[:500]

    found = _rows(texts, key, text, {"ref_type": "string", "number": "string", "found": "string", "start": "int", "source_text": "string"}, find)
    low, numbered = F.lower("found"), F.col("number") != ""

    def named(word: str) -> Column:
        return F.when(numbered, F.concat(F.lit(f"{word} "), F.col("number"))).otherwise(F.lit(word))

    label = (
        F.when(low.contains("supplementary table") | low.contains("supplemental table"), named("Supplementary Table"))
        .when(low.contains("table s") | F.upper("number").startswith("S"), F.concat(F.lit("Table "), F.col("number")))
        .when(low.contains("supplementary data"), named("Supplementary Data"))
        .when(low.contains("additional file"), named("Additional File"))
        .when(low.contains("supporting information") & low.contains("table"), named("Supporting Information Table"))
        .when(low.contains("supplementary excel") | low.contains("supplementary file"), named("Supplementary File"))
        .otherwise(F.substring("found", 1, 100))
    )
    return found.select(key, "ref_type", "number", label.alias("label"), F.substring("found", 1, 200).alias("referenced_as"), "start", "source_text")


def captions(texts: DataFrame, key: str, text: str, kind: str, *, starts: str | None = None, references: str | None = None) -> DataFrame:
    """Captions of figures or tables: key, label, number, caption, quality, source, panels, confidence.

    A caption goes from ``Figure 2.`` to the next such place, the last one 2,500 characters on, and ends before headings, other labels and rows of numbers.  Of a
    number its first place counts, below 15 characters it is none; below 30 its quality is low, below 100 medium.  A text without any caption
    gives its bare references, with quality none.  Panels are the letters of ``2A`` or ``2A-C``, for figures.
    """
    first = re.compile(starts or R.CAPTION_STARTS[kind], re.IGNORECASE)
    stops = re.compile("|".join(f"(?:{p})" for p in R.CAPTION_STOPS[kind]), re.IGNORECASE)
    bare = re.compile(references or R.BARE_REFERENCES[kind], re.IGNORECASE)

    def find(t: str) -> Iterator[tuple]:
        places, seen, some = list(first.finditer(t)), set(), False
        for i, m in enumerate(places):
            number = _number(m)
            if number.upper() in seen:
                continue
            seen.add(number.upper())
            raw = t[m.end() : places[i + 1].start() if i + 1 < len(places) else m.end() + R.MOST_CAPTION].strip()
            stop = stops.search(raw)
            caption = " ".join(raw[: stop.start() if stop else len(raw)].split())
            if len(caption) >= R.LEAST_CAPTION:
                some = True
                yield m.group().strip().rstrip("."), number, caption[: R.MOST_CAPTION], len(caption)
        if not some:
            once: dict[str, str] = {}
            for m in bare.finditer(t):
                once.setdefault(_number(m).upper() if kind == "table" else _number(m), _number(m))
            for number in once.values():
                yield number, number, "", 0

    found = _rows(texts, key, text, {"raw": "string", "number": "string", "caption": "string", "chars": "int"}, find)
    plain = F.col("chars") > 0
    quality = F.when(~plain, "none").when(F.col("chars") < R.FAIR_CAPTION, "low").when(F.col("chars") < R.GOOD_CAPTION, "medium").otherwise("high")
    word = {"figure": "Figure ", "table": "Table "}[kind]
    listed = F.concat(F.lit(word), F.col("number"))
    if kind == "table":
        surplus = F.when(F.upper("number").startswith("S"), F.lit("Supplementary Table ")).otherwise(F.lit("Supplementary Table S"))
        label = F.when(F.lower("raw").contains("supplementary"), F.concat(surplus, F.col("number"))).otherwise(listed)
        panels = F.array().cast("array<string>")
    else:
        label = F.when(plain, F.col("raw")).otherwise(listed)
        low, high = F.upper(F.regexp_extract("number", r"^\d+([A-Za-z])", 1)), F.upper(F.regexp_extract("number", r"^\d+[A-Za-z][–\-]([A-Za-z])", 1))
        run = F.when(F.ascii(high) >= F.ascii(low), F.transform(F.sequence(F.ascii(low), F.ascii(high)), lambda c: F.char(c))).otherwise(F.array().cast("array<string>"))
        panels = F.when(high != "", run).when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))
    return found.select(key, label.alias("label"), "number", "caption", quality.alias("quality"), F.when(plain, "plain_text_caption").otherwise("reference_only").alias("source"), panels.alias("panels"), F.when(plain, quality).otherwise("low").alias("confidence"))
