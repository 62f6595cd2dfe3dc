"""Text expressions built from Spark functions; all run inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A blank of any script, as a class that Java and RE2 read alike, and all of these characters.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Where a sentence ends, in Java's dialect: a blank behind a mark, and all that follow.
SENTENCE_END = rf"{SPACE}(?<=[.!?]{SPACE}){SPACE}*"
#: Where a line ends.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without blanks of any script at both ends; only a text that has some is trimmed, which takes long."""
    at_ends = F.substring(text, 1, 1).isin(*SPACES) | F.substring(text, -1, 1).isin(*SPACES)
    return F.when(at_ends, F.btrim(text, F.lit(SPACES))).otherwise(text)


def occurrences(text: Column, term: str) -> Column:
    """How often a literal occurs, overlaps not counted."""
    # lengths in bytes are read off, lengths in characters are counted
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))
    return (gone / len(term.encode())).cast("int")


def words(text: Column, least: int = 1) -> Column:
    """Lower-case ASCII words of ``least`` letters or more, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z]{{{least},}}"), 0)


def normalize_doi(text: Column) -> Column:
    """The ``10.NNNN/...`` part without trailing punctuation, lower-cased; else the text lower-cased."""
    low = F.lower(F.trim(text))
    found = F.regexp_extract(low, r"(10\.[0-9]{4,9}/[^\s]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"[.,;:)\]]+$", "")).otherwise(low)


def first_year(text: Column) -> Column:
    """First 19xx or 20xx that stands alone, as INT; null without one."""
    found = F.regexp_extract(text, r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:$|[^0-9A-Za-z_])", 1)
    return found.try_cast("int")


def clean_scalar(text: Column) -> Column:
    """NULs dropped, white space collapsed, empty to null."""
    return F.nullif(F.trim(F.regexp_replace(F.translate(text, "\0", ""), r"[ \t\n\r\f]+", " ")), F.lit(""))


def alnum(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def safe_name(text: Column, width: int = 80) -> Column:
    """A name for paths: runs of other characters become one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, width)


def excerpt(text: Column, terms: Sequence[str], before: int = 160, after: int = 260) -> Column:
    """Text around the earliest term; the beginning if none occurs."""
    low = F.lower(text)
    places = [F.nullif(F.instr(low, t), F.lit(0)) for t in terms]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1))
    start = F.greatest(at - before, F.lit(1))
    return F.substr(text, start, at + after - start)


def phrase_flags(text: Column, phrases: Sequence[str]) -> Column:
    """Number of phrases that occur in the lower-cased text."""
    low = F.lower(text)
    return reduce(add, [low.contains(p).cast("int") for p in phrases])


def clip(x: Column) -> Column:
    """x held between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def decimal_comma(text: Column) -> Column:
    """Number with a decimal point or comma; null for anything else."""
    cleaned = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(cleaned.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), cleaned.try_cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
