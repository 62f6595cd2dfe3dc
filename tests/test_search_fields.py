"""Families of columns and scores over all fields, on literal rows."""

from pyspark.sql import functions as F

from papyrine.functions import column_rules as C
from papyrine.operators import search as S
from papyrine.plans.search import ASSET_FIELDS


def test_column_families(spark):
    names = ["Gene ID", "Locus-Tag", "gene_names", "UniProt", " drug ", "sample id", "Cell  line", "Morphology", "log 2 FC", "P-value", "adj.P", "adj p val", "Percent_dead", "LC50", "concentration", "__FDR__", "﻿gene", "", None, "x"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = [r.f for r in df.select("i", C.column_family(F.col("n")).alias("f")).orderBy("i").collect()]
    assert got == ["gene", "gene", "unknown", "protein", "compound", "treatment", "sample", "phenotype", "statistical_value", "statistical_value", "unknown", "statistical_value", "statistical_value", "statistical_value", "treatment", "statistical_value", "gene", "unknown", "unknown", "unknown"]


def test_keyword_score_of_five_fields(spark):
    row = ("Toxin a", "toxin " * 9, None, "toxin", "no", 2000, "t")
    df = spark.createDataFrame([row], "title string, abstract string, summary string, tags string, metadata string, year int, x string")
    (r,) = df.select(S.keyword_score(["Toxin", "NO"], S.FIELD_WEIGHTS).alias("s")).collect()
    assert r.s == 1 * 5 + 5 * 3 + 1 * 2.5 + 1 * 1.0  # five of nine count; the second term is in the metadata alone


def test_asset_score_of_seven_fields(spark):
    blank = dict.fromkeys(ASSET_FIELDS, "")
    rows = [blank | {"title": "Vip toxin binds", "text": "a toxin"}, blank | {"node_type": "vip", "key_finding": "VIP TOXIN", "table_summary": None}, blank]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in ASSET_FIELDS))
    got = [r.s for r in df.select(S.asset_keyword_score("vip toxin", ASSET_FIELDS).alias("s")).collect()]
    assert sorted(got, reverse=True) == [2 * 3 + 1 * 0.5, 1.5 * 3 + 0.5 * 0.5, 0.0]
