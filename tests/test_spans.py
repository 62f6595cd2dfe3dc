"""Mentions, references and captions on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from papyrine.functions import span_rules as R
from papyrine.operators import spans as S


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "i long, t string")


def test_mentions(spark):
    text = "First. See Suppl. Fig. S1A and Table 2, 3. The data set 4 is in Dataset 5b\nof Supplementary Data 6; SI Appendix, Appendix B2! Figures 1-3, and 4 end"
    rows = S.mentions(texts(spark, text, None, "", "nothing"), "i", "t").orderBy("start").collect()
    assert [(r.kind, r.found, r.label, r.asset_type, r.subpanel, r.supplementary) for r in rows] == [
        ("figure", "Suppl. Fig. S1A", "Figure S1", "figure", "A", True),
        ("table", "Table 2, 3", "Table 2, 3", "table", "", False),
        ("dataset", "Dataset 5b", "Dataset 5", "dataset", "B", False),
        ("dataset", "Supplementary Data 6", "Dataset S6", "dataset", "", True),
        ("supplementary", "SI Appendix", "SI Appendix", "supplementary", "", True),
        ("supplementary", "Appendix B2", "Appendix B2", "supplementary", "", True),
        ("figure", "Figures 1-3, and 4", "Figure 1-3, and 4", "figure", "", False),
    ]
    assert all(text[r.start : r.end] == r.found for r in rows)
    assert rows[0].sentence == "See Suppl. Fig. S1A and Table 2, 3."
    assert rows[2].before.endswith("is in") and rows[2].after.startswith("of Supplementary")


def test_spans_against_a_loop():
    rng = random.Random(4)
    patterns = [("a", re.compile(r"x+y?")), ("b", re.compile(r"[xy]+z?")), ("c", re.compile("z|y"))]
    for _ in range(300):
        text = "".join(rng.choices("xyz ", k=30))
        seen, want = [], []
        for kind, p in patterns:
            for m in p.finditer(text):
                if not any(s <= m.start() and m.end() <= e for s, e in seen):
                    seen.append(m.span())
                    want.append((kind, m.span()))
        assert [(k, m.span()) for k, m in S.outer_spans(text, patterns)] == want


def test_sentences():
    text = "One. Two here\nThree! Four"
    assert [S.sentence_at(text, p, p + 1) for p in (0, 5, 14, 22)] == ["One.", "Two here", "Three!", "Four"]


@pytest.mark.parametrize(
    ("text", "kind", "number", "label"),
    [
        ("Supplemental Table 3A", "supplementary_table", "3A", "Supplementary Table 3A"),
        ("(Table S4", "table_s_label", "S4", "Table S4"),
        ("Tables S1, S2 and S3", "tables_s_range", "S1, S2 and S3", "Table S1, S2 and S3"),
        ("Suppl. Dataset 2", "supplementary_data", "2", "Suppl. Dataset 2"),
        ("Supplementary Data Set 2", "supplementary_data", "2", "Supplementary Data 2"),
        ("Additional 7", "additional_file", "7", "Additional 7"),
        ("Additional file 7", "additional_file", "7", "Additional File 7"),
        ("Supporting Information Table 1", "supporting_info_table", "1", "Supporting Information Table 1"),
        ("Figure 2 in the supporting material", "supplemental_material", "2", "Figure 2 in the supporting material"),
        ("Supplementary File", "supplementary_file", "", "Supplementary File"),
        ("see https://a.b/suppl_1.XLSX now", "supplementary_url", "", "https://a.b/suppl_1.XLSX"),
    ],
)
def test_references(spark, text, kind, number, label):
    rows = S.supplement_references(texts(spark, f"{text}. {text}."), "i", "t").where(F.col("ref_type") == kind).collect()
    assert [(r.number, r.label) for r in rows] == [(number, label)]
    assert rows[0].source_text.startswith(text[:5])


def test_captions(spark):
    long = "a caption that is told in words enough to be of a high quality, since it goes on for more than a hundred characters"
    text = f"Intro. Figure 1. {long}\nREFERENCES and more. Fig. 2A. Short  but\nfair caption here Supplementary Figure S3. tiny. Figure 1. again, this is not taken. fig 4b. A caption of the last item\n 1.69 (1.36)"
    rows = S.captions(texts(spark, text), "i", "t", "figure").collect()
    assert [(r.label, r.number, r.caption, r.quality, r.panels) for r in rows] == [
        ("Figure 1", "1", long, "high", []),
        ("Fig. 2A", "2A", "Short but fair caption here", "low", ["A"]),
        ("fig 4b", "4b", "A caption of the last item", "low", ["B"]),
    ]
    (last,) = S.captions(texts(spark, "Table S2: " + "word " * 800), "i", "t", "table").collect()
    assert (last.label, last.number, len(last.caption), last.confidence) == ("Table S2", "S2", 2499, "high")
    (sup,) = S.captions(texts(spark, "Supplementary Table 2. A caption of this table\n* a note"), "i", "t", "table").collect()
    assert (sup.label, sup.caption) == ("Supplementary Table S2", "A caption of this table")


def test_bare_references(spark):
    rows = S.captions(texts(spark, "as in Figure 2 and fig. 3A or Figure 2; Figure 4. no", None, ""), "i", "t", "figure").collect()
    assert [(r.label, r.quality, r.source, r.confidence, r.panels) for r in rows] == [("Figure 2", "none", "reference_only", "low", []), ("Figure 3A", "none", "reference_only", "low", ["A"]), ("Figure 4", "none", "reference_only", "low", [])]
    assert S.captions(texts(spark, "Table 1 and TABLE s1 and Table S1"), "i", "t", "table").count() == 2


def test_rules_compile():
    for rules in (R.MENTIONS, R.SUPPLEMENTS):
        assert all(re.compile(p, re.IGNORECASE) for _, p in rules)
