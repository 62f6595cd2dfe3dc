"""Texts and JSON put in order: artefacts and repeated phrases taken out, answers that almost hold JSON made to."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import SPACE
from papyrine.sources.session import ship_package

#: What is no text, the lengths of phrases that are looked for twice in a row, and how long text and phrase must be.
ARTEFACTS = ("[object Object]", "object Object", "undefined", "null null", "None None")
PHRASE_WORDS, LEAST_WORDS, LEAST_PHRASE = (5, 6), 9, 13
_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)\n?```", re.DOTALL)


def first_repeat(words: Column, size: int) -> Column:
    """Place (from 0) of the first phrase of ``size`` words and 13 characters or more that stands twice in a row; null without one.

    Each word is compared with that ``size`` places on, and a run of as many equal pairs is a repeat, so the text is read once.
    The very last phrase of a text is never one.
    """
    same = F.transform(words, lambda x, i: F.struct(i.alias("i"), (x == F.get(words, i + size)).alias("same")))
    start = F.struct(F.lit(0).alias("run"), F.lit(None).cast("int").alias("at"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(F.coalesce(x["same"], F.lit(False)), a["run"] + 1).otherwise(0)
        place = x["i"] - size + 1
        long = F.length(F.array_join(F.slice(words, place + 1, F.lit(size)), " ")) >= LEAST_PHRASE
        return F.struct(run.alias("run"), F.coalesce(a["at"], F.when((run >= size) & (place < F.size(words) - 2 * size) & long, place)).alias("at"))

    return F.aggregate(same, start, step)["at"]


def without_repeat(words: Column, size: int) -> Column:
    """Words without the second of the first phrase that ``first_repeat`` finds."""
    return F.get(F.transform(F.array(first_repeat(words, size)), lambda at: F.when(at.isNull(), words).otherwise(F.concat(F.slice(words, F.lit(1), at + size), F.slice(words, at + 2 * size + 1, F.size(words))))), 0)


def cleaned_words(text: Column, artefacts: Sequence[str] = ARTEFACTS) -> Column:
    """Words of a text without artefacts; an empty or null text has none."""
    for a in artefacts:
        text = F.replace(text, F.lit(a), F.lit(""))
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def repaired(text: str) -> str | None:
    """The first JSON object or array of a text, made whole; None without one.

    One scan with a stack of brackets: commas before a closing bracket go, and what a cut-off text leaves open is closed, without
    a dangling comma, colon or key.
    """
    begin = min((p for p in (text.find("{"), text.find("[")) if p >= 0), default=-1)
    if begin < 0:
        return None
    out: list[str] = []
    stack: list[str] = []
    inside = escaped = False
    for c in text[begin:]:
        out.append(c)
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            out.pop()
            _drop(out, ",")
            out.append(c)
            if not stack:
                return "".join(out)
    if escaped:
        out.pop()
    if inside:
        out.append('"')
    done = "".join(out).rstrip()
    while stack:
        done = _closed(done, stack[-1])
        done += stack.pop()
    return done


def _drop(out: list[str], mark: str) -> None:
    """Take blanks and then one mark off the end; blanks stay where no mark is before them."""
    n = len(out)
    while n and out[n - 1].isspace():
        n -= 1
    if n and out[n - 1] == mark:
        del out[n - 1 :]


def _closed(text: str, bracket: str) -> str:
    """``text`` without a comma at its end, or a key of an object that has no value yet."""
    text = text.rstrip()
    if text.endswith(","):
        text = text[:-1].rstrip()
    if bracket == "}" and (text.endswith(":") or _lone_key(text)):
        key = text.rstrip(":").rstrip()
        text = key[: _quote(key)].rstrip().removesuffix(",")
    return text


def _quote(text: str) -> int:
    """Place of the quote that opens the string at the end of ``text``."""
    at = len(text) - 1
    while at > 0:
        at = text.rfind('"', 0, at)
        slashes = len(text[:at]) - len(text[:at].rstrip("\\"))
        if slashes % 2 == 0:
            return max(at, 0)
    return 0


def _lone_key(text: str) -> bool:
    """Whether a text ends with a string that stands where a key of an object would."""
    return text.endswith('"') and text[: _quote(text)].rstrip().endswith(("{", ","))


def _loads(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def found_json(text: str) -> tuple[str | None, str]:
    """JSON of an answer, and how it was found."""
    plain = text.strip()
    if _loads(plain):
        return plain, "plain"
    fence = _FENCE.search(text)
    block = fence.group(1).strip() if fence else ""
    if block and _loads(block):
        return block, "fenced"
    for part in (block, text):
        mended = repaired(part)
        if mended is not None and _loads(mended):
            return mended, "repaired"
    return None, "none"


def json_of(text: Column) -> Column:
    """Struct (json, how) of an answer that should hold JSON.

    ``plain`` is JSON as it is, ``fenced`` the first block between fences, ``repaired`` what ``repaired`` makes of that block or else the text, if
    it then is JSON; otherwise json is null and how ``none``.  The JVM's parsers take text with more behind the first value, so the strict one
    runs over Arrow batches; only what it refuses is scanned.  A null text gives null.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)

    @F.arrow_udf("struct<json:string,how:string>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else dict(zip(("json", "how"), found_json(t), strict=True)) for t in texts.to_pylist()]
        return pa.array(rows, pa.struct([("json", pa.string()), ("how", pa.string())]))

    return found(text)
