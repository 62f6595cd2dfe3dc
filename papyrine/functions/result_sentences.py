"""Sentences that report a result, one pass over a text in Arrow batches.

Built-in expressions would rate every sentence before the first few are taken, and take about four times as long on one core.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import evidence_rules as R
from papyrine.functions.rule_tables import Rules
from papyrine.sources.session import ship_package

_END = re.compile(r"(?<=[.!?])\s+")
RESULTS = "array<struct<place:int,result:string,quote:string,direction:string,section:string,confidence:string>>"
_RESULTS = pa.list_(pa.struct([("place", pa.int32()), *[(n, pa.string()) for n in ("result", "quote", "direction", "section", "confidence")]]))


class ResultRules:
    """Words of report and of direction, ready to be looked for in lower case."""

    def __init__(self, directions: Rules, words: Sequence[str]) -> None:
        self.words = words
        self.terms = sorted(((word, label) for label, terms in directions for word in terms), key=lambda x: -len(x[0]))
        self.whole = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)")
        # a text without these has no result: of a term with blanks, which may stand for a line's end, the longest word
        self.pieces = sorted({max(w.split(), key=len) for w in [*words, *[t for t, _ in self.terms]]})

    def any_piece(self, text: str) -> bool:
        low = text.lower()
        return any(p in low for p in self.pieces)

    def find(self, text: str, section: str, most: int, directed: bool) -> list[dict]:
        """The first ``most`` results of a text."""
        out: list[dict] = []
        for place, part in enumerate(_END.split(text)):
            s = part.strip()
            if not 30 <= len(s) <= 600:
                continue
            low = s.lower()
            turned = next((label for t, label in self.terms if t in low), None)
            if directed and turned is None:
                continue
            told = any(w in low for w in self.words) and self.whole.search(low) is not None
            if told or turned:
                sure = "low" if not told else "high" if turned else "medium"
                out.append({"place": place, "result": s[:300], "quote": s[:240], "direction": turned or "descriptive", "section": section, "confidence": sure})
                if len(out) == most:
                    break
        return out

    def chained(self, texts: Mapping[str, str]) -> list[dict]:
        """Results of the first place that has some."""

        def long(names: Sequence[str], least: int) -> str:
            return " ".join(texts[n] for n in names if n in texts and len(texts[n]) > least)

        if not any(self.any_piece(t) for t in set(texts.values())):
            return []
        found: list[dict] = []
        if len(texts["results"]) > 200:
            found = self.find(texts["results"], "Results", 8, False)
        if not found and len(texts["discussion"]) > 200:
            found = self.find(texts["discussion"], "Discussion", 5, True)
        if not found and len(both := long(["abstract", "conclusion"], 50)) > 50:
            found = self.find(both, "Abstract_Conclusion", 4, False)
        return found or self.find(long(list(texts), 100), "Full_text", 5, False)


def _ready() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


def key_results(text: Column, section: str, most: int = 8, directed: bool = False, rules: Rules = R.DIRECTIONS, words: Sequence[str] = R.RESULT_WORDS) -> Column:
    """The first ``most`` sentences of 30 to 600 characters that report a result.

    Structs (place, result, quote, direction, section, confidence): high with a word of report and a direction, medium
    with the word alone, low with the direction alone.  ``directed`` takes only sentences with a direction.
    """
    _ready()
    own = ResultRules(rules, words)

    @F.arrow_udf(RESULTS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([own.find(t or "", section, most, directed) for t in texts.to_pylist()], _RESULTS)

    return found(text)


def chained_results(texts: Mapping[str, Column], rules: Rules = R.DIRECTIONS, words: Sequence[str] = R.RESULT_WORDS) -> Column:
    """Key results of the first place that has some: results, discussion, abstract and conclusion, all sections.

    ``texts`` holds the text of each section.  A null or too short section is passed over; without any result the
    array is empty.  Results of section ``Full_text`` are those of the last resort.
    """
    _ready()
    own, names = ResultRules(rules, words), list(texts)

    @F.arrow_udf(RESULTS)
    def found(parts: pa.Array) -> pa.Array:
        return pa.array([own.chained({n: p[n] or "" for n in names}) for p in parts.to_pylist()], _RESULTS)

    return found(F.struct(*[c.alias(n) for n, c in texts.items()]))
