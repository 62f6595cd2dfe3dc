"""Steps whose rows must stay narrow, or whose work must be dealt evenly, when tables grow."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from papyrine.functions import evidence as E

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_best_hits_are_sorted_as_narrow_rows(spark):
    for name in ("jn16_best_match", "jn16b_like_match"):
        text = plan(queries()[name](spark, SF_DIR))
        found = re.findall(r"partial_max\((hit#|line#|struct\(|[A-Za-z]+)", text)
        assert "hit#" in found and set(found) <= {"hit#", "line#", "struct("}
        assert text.count("REPARTITION_BY_NUM") >= 2


def test_context_counts_do_not_multiply_lines(spark):
    assert "Expand" not in plan(queries()["cp1_context"](spark, SF_DIR))


def test_texts_lie_in_parts_of_bounded_rows(spark, monkeypatch):
    from papyrine.sources import tables

    monkeypatch.setattr(tables, "TEXTS", 10)
    assert tables.spread_texts(spark.range(1000)).rdd.getNumPartitions() == 100
    assert "REPARTITION_BY_NUM" in plan(queries()["ag33_bigrams"](spark, SF_DIR))


def test_first_spellings_shuffle_texts_and_no_words(spark):
    text = plan(queries()["set2_first_spelling"](spark, SF_DIR)).split("== Physical Plan ==")[1]
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text


def test_label_variants_are_dealt_and_made_once(spark):
    text = plan(queries()["fn18_label_variants"](spark, SF_DIR)).split("== Physical Plan ==")[1]
    assert "Exchange" in text and "regexp_extract" not in text


def test_method_phrases_run_only_where_their_words_are(spark):
    from papyrine.functions import evidence_rules as R

    text = plan(spark.range(1).select(E.methods(F.col("id").cast("string"), (), R.METHOD_PHRASES)))
    assert ", conducted)" in text.split("== Physical Plan ==")[1]
    texts = ["All WERE Used. The samples from here were carried out", "cells Measured By mass and Performed with an old tool", "made via one long Method", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", E.methods(F.col("t"), (), R.METHOD_PHRASES).alias("m")).orderBy("i").collect()
    assert [[m.name for m in r.m] for r in got] == [["The samples from here were carried out"], ["Performed with an old tool", "Measured By mass and Performed with an old tool"], ["via one long Method"], []]
