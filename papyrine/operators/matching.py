"""Labels in texts matched to the assets that they mean, by a cascade of notes, names, captions and likeness.

All steps look at one paper: a distinct label meets the assets of its paper once, in an equi-join on the paper, and the best step of the best asset
is one partial maximum.  Only labels below a sure match go on to likeness, which is ``difflib``'s ratio in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.sources.session import ship_package

#: Kinds of labels and the types under which assets are registered, and short forms of label words.
KIND_TYPES = {"figure": "figure_image", "table": "supplementary_table", "dataset": "dataset", "supplementary": "supplementary_pdf"}
SHORT_FORMS = {"Figure": "Fig", "Table": "Tab", "Dataset": "Data"}
#: Scores of the steps, their caps and least values, and what is a match.
NOTED, NOTED_TYPE, NAMED, CAPTIONED = 0.95, 0.85, 0.90, 0.80
NOTE_LEAST, NOTE_CAP, TOKEN_LEAST, TOKEN_CAP, LIKE_LEAST, LIKE_CAP = 0.6, 0.75, 0.5, 0.85, 0.45, 0.65
MATCHED, LOW = 0.7, 0.5


def sequence_ratio(a: str, b: str, least: float = 0.0) -> float:
    """``difflib`` ratio of two texts; 0 where its bounds by length and letters already stay below ``least``."""
    return best_ratio([a], b, least)


def best_ratio(variants: list[str], text: str, least: float = 0.0) -> float:
    """Largest ``difflib`` ratio of any variant to ``text``, 0 below ``least``; length and letter counts are tried first."""
    best, matcher = 0.0, SequenceMatcher(None)
    matcher.set_seq2(text)  # what is known of the second text is kept
    for v in variants:
        matcher.set_seq1(v)
        if min(matcher.real_quick_ratio(), matcher.quick_ratio()) >= max(least, best):
            best = max(best, matcher.ratio())
    return best if best >= least else 0.0


def likeness(variants: Column, text: Column, least: float = 0.0) -> Column:
    """Largest ratio of an array of texts to a text, in Arrow batches; null where either is null."""

    @F.pandas_udf("double")
    def ratio(vs: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or t is None else best_ratio(list(v), t, least) for v, t in zip(vs, ts, strict=True)], dtype="float64")

    return ratio(variants, text)


def could_be_like(variants: Column, text: Column, least: float) -> Column:
    """Whether the lengths allow a ratio of ``least``: twice the shorter length over both."""
    n = F.length(text)
    return F.exists(variants, lambda v: 2 * F.least(F.length(v), n) >= least * (F.length(v) + n))


def search_variants(label: Column, short: Mapping[str, str] = SHORT_FORMS) -> Column:
    """Spellings under which a label such as ``Figure S1`` may stand in names; the label alone if it has no blank."""
    num = F.substring_index(label, " ", -1)
    head = F.substr(label, F.lit(1), F.length(label) - F.length(num) - 1)
    brief = head
    for long, form in short.items():
        brief = F.when(head == long, form).otherwise(brief)

    def joined(word: Column, number: Column, *marks: str) -> list[Column]:
        return [F.concat(word, F.lit(m), number) for m in marks]

    def spelled(x: Column) -> Column:
        label, head, low, brief, num, plain = (x[c] for c in ("label", "head", "low", "brief", "num", "plain"))
        full = [label, *joined(head, num, "_", "-", ""), *joined(low, num, "_", "-", ""), *joined(brief, num, "_", "-", "", "._", ".", " "), num]
        bare = [*joined(head, plain, "_", "-", " "), *joined(brief, plain, "_", "."), plain]
        return F.concat(F.array(*full), F.when(num.startswith("S"), F.array(*bare)).otherwise(F.array().cast("array<string>")))

    # parts are bound in a lambda: made anew for each spelling, generated code grows too long to be compiled
    parts = F.struct(label.alias("label"), head.alias("head"), F.lower(head).alias("low"), brief.alias("brief"), num.alias("num"), F.substring(num, 2, 1 << 30).alias("plain"))
    return F.when(label.contains(" "), F.transform(F.array(parts), spelled)[0]).otherwise(F.array(label))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def _within(line: Column, part: Column) -> Column:
    """Whether a text that is not empty stands in another, in any case."""
    return F.coalesce((part != "") & F.lower(line).contains(F.lower(part)), F.lit(False))


def match_labels(mentions: DataFrame, assets: DataFrame, notes: DataFrame, *, types: Mapping[str, str] = KIND_TYPES, like: bool = True) -> DataFrame:
    """``mentions`` with asset, method, confidence and status: each label's best asset of its paper.

    ``mentions`` has paper, label, kind; ``assets`` paper, asset, type, filename, original, notes and place (their order, from which the first of equals
    is taken); ``notes`` paper, label, line, a title line for each label (of repeated labels the largest line).  A kind outside
    ``types`` takes assets of every type; supplementary labels also take types that hold the word.  Steps and scores:

    * notes: the label has a title line; .95 for an asset whose name is in it, else .85 for the first of the type; else the title most
      like one of the label's spellings, from .6, stands for the first of the type, .75 at most;
    * filename: .90 if a spelling is part of a name, else the share of its tokens in the name from .5, .85 at most;
    * caption: .80 if the asset's notes hold the label;
    * fuzzy: with less than .7 so far, the ratio of spellings to names and notes from .45, .65 at most.

    The highest score counts, of equals the earlier step.  From .7 it is matched, from .5 low_confidence, else unmatched without an asset.
    ``like`` False leaves out the two steps by likeness.  Null or empty labels are unmatched.  Nulls in names and notes are empty.
    """
    ship_package(mentions.sparkSession)
    target = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    labels = mentions.where(F.col("label") != "").select("paper", "label", "kind").distinct()
    labels = labels.withColumns({"target": F.coalesce(F.try_element_at(target, F.col("kind")), F.lit("")), "low_label": F.lower("label"), "variants": F.array_distinct(F.transform(search_variants(F.col("label")), F.lower))})
    labels = labels.withColumn("tokens", F.array_distinct(F.transform("variants", lambda v: F.array_sort(_tokens(v)))))
    # what every spelling holds, and any token of them: two cheap looks that most pairs do not pass
    labels = labels.withColumns({"core": F.array_min(F.transform("variants", lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"], "any_token": F.array_distinct(F.flatten("tokens"))})
    titles = notes.where("label is not null").groupBy("paper", "label").agg(F.max("line").alias("line"))
    owned = assets.select("paper", "asset", F.coalesce("type", F.lit("")).alias("type"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("filename", "original", "notes")], "place")
    owned = owned.withColumn("names", F.array_distinct(F.filter(F.array(F.lower("filename"), F.lower("original")), lambda n: n != "")))
    owned = owned.withColumn("name_tokens", F.transform("names", _tokens)).withColumns({"all_tokens": F.flatten("name_tokens"), "low_notes": F.lower("notes")})
    # a paper's pairs are many for its few bytes, so parts are not merged by their size
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    titled, owned = labels.join(titles, ["paper", "label"], "left").repartition(parts, "paper"), owned.repartition(parts, "paper")
    pairs = titled.join(owned, "paper")
    exact = F.col("type") == F.col("target")
    fits = (F.col("target") == "") | exact | ((F.col("target") == "supplementary_pdf") & F.col("type").contains("supplementary"))

    def hit(score: Column, method: Column, raw: Column) -> Column:
        """A step's outcome, larger if better: score, earlier step, uncapped score, earlier asset."""
        return F.struct(score.cast("double").alias("score"), (-method).alias("step"), raw.cast("double").alias("raw"), (-F.col("place")).cast("bigint").alias("place"), F.col("asset").alias("asset"))

    def share(own: Column, name: Column) -> Column:
        return F.when(F.size(own) > 0, F.size(F.array_intersect(own, name)) / F.size(own)).otherwise(F.lit(0.0))

    token = F.when(F.arrays_overlap("any_token", "all_tokens"), F.array_max(F.transform("tokens", lambda v: F.array_max(F.transform("name_tokens", lambda n: share(v, n)))))).otherwise(F.lit(0.0))
    part = F.exists("names", lambda n: n.contains(F.col("core"))) & F.exists("variants", lambda v: F.exists("names", lambda n: n.contains(v)))
    noted = F.when(F.col("line").isNotNull(), F.when(_within(F.col("line"), F.col("filename")) | _within(F.col("line"), F.col("original")), NOTED).when(exact, NOTED_TYPE))
    captioned = F.when(((F.col("target") == "") | exact) & (F.col("notes") != "") & F.col("low_notes").contains(F.col("low_label")), CAPTIONED)
    key = ["paper", "label", "kind"]
    def largest(hits: DataFrame) -> DataFrame:
        # narrow rows of hits alone, as the maximum of a struct sorts its rows
        return hits.groupBy(*key).agg(F.max("hit").alias("best"))

    # each step is made once a pair, by name a part before tokens; most pairs hit nothing
    whole = 2.0
    raws = {1: noted, 2: F.when(fits, F.when(part, whole).otherwise(token)), 3: captioned}
    tries = pairs.select(*key, "asset", "place", F.stack(F.lit(len(raws)), *[x for m, raw in raws.items() for x in (F.lit(m), raw.cast("double"))]).alias("method", "raw"))
    tries = tries.where(F.col("raw") >= F.when(F.col("method") == 2, TOKEN_LEAST).otherwise(0.0))
    named = F.when(F.col("raw") == whole, NAMED).otherwise(F.least("raw", F.lit(TOKEN_CAP)))
    score, raw = F.when(F.col("method") == 2, named).otherwise(F.col("raw")), F.when(F.col("raw") == whole, NAMED).otherwise(F.col("raw"))
    hits = tries.select(*key, hit(score, F.col("method"), raw).alias("hit"))
    if like:
        # titles like a spelling stand for the first asset of the type; with a title of its own that asset is a hit already
        first = owned.groupBy("paper", F.col("type").alias("target")).agg(F.max(F.struct((-F.col("place")).cast("bigint").alias("place"), F.col("asset").alias("asset"))).alias("first"))
        open_ = titled.where("line is null").select(*key, "target", "variants").join(first, ["paper", "target"])
        told = open_.join(titles.select("paper", F.lower("label").alias("title")).distinct(), "paper").where(could_be_like(F.col("variants"), F.col("title"), NOTE_LEAST))
        told = told.withColumn("told", likeness(F.col("variants"), F.col("title"), NOTE_LEAST)).where(f"told >= {NOTE_LEAST}")
        by_note = F.struct(F.least(F.col("told"), F.lit(NOTE_CAP)).alias("score"), F.lit(-1).alias("step"), F.least(F.col("told"), F.lit(NOTE_CAP)).alias("raw"), F.col("first.place").alias("place"), F.col("first.asset").alias("asset"))
        hits = hits.unionByName(told.select(*key, by_note.alias("hit")))
    found = largest(hits)
    if like:
        sure = found.where(F.col("best.score") >= MATCHED).select(*[F.col(c).alias(f"s_{c}") for c in key])
        weak = titled.select(*key, "target", "variants").join(sure, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in key], "left_anti")
        seen = weak.join(owned, "paper").where(fits)
        texts = seen.select(*key, "asset", "place", "variants", F.explode(F.filter(F.array(F.lower("filename"), F.lower("original"), F.lower("notes")), lambda t: t != "")).alias("text"))
        texts = texts.where(could_be_like(F.col("variants"), F.col("text"), LIKE_LEAST)).withColumn("ratio", likeness(F.col("variants"), F.col("text"), LIKE_LEAST)).where(f"ratio >= {LIKE_LEAST}")
        close = texts.select(*key, hit(F.least("ratio", F.lit(LIKE_CAP)), F.lit(4), F.col("ratio")).alias("hit"))
        found = largest(found.withColumnRenamed("best", "hit").unionByName(close))
    got = found.where(F.col("best.score") >= LOW).select(*[F.col(c).alias(f"f_{c}") for c in key], "best")
    met = mentions.join(got, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in key], "left")
    steps = F.array(*[F.lit(m) for m in ("notes", "filename", "caption", "fuzzy")])
    method = F.when(F.col("best").isNotNull(), F.get(steps, -F.col("best.step") - 1))
    status = F.when(F.col("best.score") >= MATCHED, "matched").when(F.col("best").isNotNull(), "low_confidence").otherwise("unmatched")
    return met.select(*[mentions[c] for c in mentions.columns], F.col("best.asset").alias("asset"), F.coalesce(method, F.lit("none")).alias("method"), F.coalesce(F.round("best.score", 2), F.lit(0.0)).alias("confidence"), status.alias("status"))
