"""Classifiers and rubrics on literal rows, with the fixed rule tables."""

import pytest
from pyspark.sql import functions as F

from papyrine.functions import classify as C
from papyrine.functions import rule_tables as R


def _rows(spark, schema, rows, **columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()]


def _scored(spark, texts, rules, default):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    label, score = C.scored(F.col("b"), 0.4, 0.2, 0.95, default, 0.3)
    rows = df.select("i", C.intent(F.col("text"), rules).alias("b")).select("i", label.alias("l"), score.alias("s")).orderBy("i").collect()
    return [(r.l, r.s) for r in rows]


def test_query_intents(spark):
    texts = ["Which table supports the claim?", "LC50 and mortality of the larvae", "qPCR expression transcript fpkm", "hello", None, "", "image panel, table column"]
    want = [("claim_support_search", 0.8), ("bioassay_search", 0.8), ("expression_search", 0.95), ("evidence_search", 0.3), ("evidence_search", 0.3), ("evidence_search", 0.3), ("figure_search", 0.8)]
    assert _scored(spark, texts, R.QUERY_INTENTS, "evidence_search") == want


def test_more_hits_than_the_cap_do_not_break_ties(spark):
    """Seven hits and three score alike, so the first named category wins."""
    text = "figure image panel; table tabular spreadsheet column row header"
    assert _scored(spark, [text], R.QUERY_INTENTS, "evidence_search") == [("figure_search", 0.95)]


def test_agent_intents_and_plans(spark):
    assert _scored(spark, ["compare different papers", "what is the role of it", "nothing"], R.AGENT_INTENTS, "literature_question") == [
        ("entity_comparison_question", 0.8),
        ("literature_question", 0.8),
        ("literature_question", 0.3),
    ]
    rows = _rows(spark, "x string", [("gap_question",), ("other",), (None,)], p=C.tool_plan(F.col("x")))
    assert [r[0] for r in rows] == [["gap_search", "unified_graph_query"], ["cross_asset_query"], ["cross_asset_query"]]


def test_dataset_types(spark):
    rows = [(["log2FC", "pAdj", "gene-id"], ["x"], ""), (["Mortality", "dead"], [], None), (["q"], [], "zzz"), ([], [], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h array<string>, c array<string>, t string")
    df = df.select("i", "h", C.dataset_words(F.col("h"), F.col("c"), F.col("t")).alias("w")).withColumn("b", C.dataset_type(F.col("w")))
    label, score = C.scored(F.col("b"), 0.7, 0.05, 0.95, "unknown", 0.0)
    df = df.select("i", "h", "w", label.alias("l"), score.alias("s")).withColumn("k", C.matched_keywords(F.col("w"), F.col("l")))
    got = [(r.l, r.s, r.k, [(x.keyword, x.headers) for x in r.c]) for r in df.withColumn("c", C.key_columns(F.col("h"), F.col("k"))).orderBy("i").collect()]
    assert got == [
        ("differential_expression", 0.8, ["log2fc", "padj"], [("log2fc", ["log2FC"]), ("padj", ["pAdj"])]),
        ("bioassay", 0.8, ["mortality", "dead"], [("mortality", ["Mortality"]), ("dead", ["dead"])]),
        ("unknown", 0.0, [], []),
        ("unknown", 0.0, [], []),
    ]


@pytest.mark.parametrize(
    ("source", "section", "role"),
    [
        ("Title", "Methods", "title"),
        ("summary.md", None, "summary"),
        ("chunks", "x", "chunks"),
        ("raw", "raw:Literature  cited", "references"),
        ("raw", "raw:<b>Results</b> and discussion", "results"),
        ("raw", "Conclusions", "discussion"),
        ("raw", "raw:Homologous competition", "results"),
        ("raw", "raw:Insect rearing: strains", "methods"),
        ("raw", "Background", "introduction"),
        ("raw", "Page 12", "raw_text"),
        ("raw", "raw: ", "unknown"),
        (None, None, "unknown"),
    ],
)
def test_section_roles(spark, source, section, role):
    assert _rows(spark, "a string, b string", [(source, section)], r=C.section_role(F.col("a"), F.col("b"))) == [(role,)]


def test_evidence_roles(spark):
    rows = [("claim", "high", True, False), ("claim", "medium", False, False), ("claim", "medium", False, True), ("claim", "low", False, True), ("result", "low", False, False), ("figure", "low", False, False), ("text", "low", False, False), ("text", "high", False, False), ("text", "medium", False, False)]
    got = _rows(spark, "k string, c string, b boolean, l boolean", rows, r=C.evidence_role(F.col("k"), F.col("c"), F.col("b"), F.col("l")))
    assert [r[0] for r in got] == ["boilerplate", "weak_claim", "claim", "weak_claim", "supporting_result", "figure_context", "weak_evidence", "direct_evidence", "background"]


def test_relations(spark):
    rows = [("As described in Table 2", None), ("Table 2 lists doses", ""), ("is plotted", "These confirm"), (None, "results suggest"), (None, None)]
    got = _rows(spark, "a string, b string", rows, r=C.relation(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == ["method_detail", "reports_data", "illustrates", "supports", "unknown"]


def test_gap_quality(spark):
    long = "It is open how the Vip3A receptor acts in the signaling pathway of the midgut of larvae that were fed with it for days"
    rows = [
        (["an item of more than twenty characters"] * 3, long, 0.9, "Contradiction", "what is missing", "why it matters"),
        ([], "Little is known", 0.9, "scope", "", None),
        (["short", "an item of more than twenty characters"], "Further studies are needed on this topic", 0.81, None, "x" * 10, "y" * 10),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e array<string>, s string, c double, k string, m string, w string")
    parts = C.gap_quality(*[F.col(x) for x in "esckmw"])
    score = C.weighted([parts[n] for n in ("grounding", "specificity", "novelty")], R.GAP_WEIGHTS)
    got = df.select("i", *[c.alias(n) for n, c in parts.items()], score.alias("score")).orderBy("i").collect()
    flat = [(round(r.grounding, 3), round(r.specificity, 3), round(r.novelty, 3), r.overclaim, r.score) for r in got]
    assert flat[0][:4] == (0.9, 1.0, 0.85, "low")
    assert abs(flat[0][4] - 0.9225) < 0.0006  # a tie at three places
    assert flat[1:] == [(0.1, 0.0, 0.15, "high", 0.078), (0.6, 0.2, 0.6, "low", 0.46), (0.1, 0.2, 0.4, "low", 0.21)]


def test_hypothesis_quality(spark):
    rows = [
        ("A higher and measurable share of larvae dies after the second day of feeding on the treated diet", "Knockdown by RNAi in vivo at pH 7.45 and 50 % (w/v), then select agent handling", "short", ["a", "b"], True, "x"),
        (None, None, None, None, False, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, e string, r string, s array<string>, g boolean, t string")
    parts = C.hypothesis_quality(*[F.col(x) for x in "persgt"])
    got = df.select("i", *[c.alias(n) for n, c in parts.items()]).orderBy("i").collect()
    flat = [(round(r.testability, 3), round(r.rationale, 3), round(r.feasibility, 3), r.over_specific, len(r.warnings)) for r in got]
    assert flat == [(1.0, 0.65, 0.75, "high", 1), (0.3, 0.3, 0.3, "low", 0)]


def test_discussion_points(spark):
    same = "The same start of a sentence that is longer than sixty characters in all, "
    text = " ".join([
        "Short one.",
        "This pathway and its signal cascade are similar to that of others.",
        "These results are of interest to nobody in particular.",
        same + "first.",
        same + "second.",
        "However, the role is unclear and unknown to us all!",
        "x" * 501 + ".",
    ])
    rows = _rows(spark, "t string", [(text,), (None,), ("",), (" ".join(f"Sentence number {k:02d} of a longer text here." for k in range(30)),)], p=C.discussion_points(F.col("t")))
    got = [[(x.place, x.kind, x.confidence) for x in r[0]] for r in rows]
    assert got[0] == [(1, "mechanism", "medium"), (2, "interpretation", "low"), (3, "interpretation", "low"), (5, "uncertainty", "medium")]
    assert got[1:3] == [[], []]
    assert [x[0] for x in got[3]] == list(range(10))


def test_guardrails(spark):
    rows = [("We prove it, a novel breakthrough", 1, 0, 0), ("We prove it, a novel breakthrough", 3, 0, 0), ("fine", 0, 0, 0), ("fine", 4, 2, 2), (None, None, None, None)]
    issues, risk = C.guardrails(F.col("a"), F.col("n"), F.col("b"), F.col("l"))
    got = _rows(spark, "a string, n long, b long, l long", rows, x=issues, r=risk)
    assert got == [
        (["overclaim_risk"], "medium"),
        ([], "low"),
        (["no_references"], "medium"),
        (["missing_provenance", "no_source_path", "no_source_path"], "high"),
        (["no_references"], "medium"),
    ]


def test_caption_kinds(spark):
    rows = [("Western blot of the toxin", None), ("A tree", "with bootstrap"), (None, "Schematic of steps"), ("An overview", ""), ("plain", "words"), (None, None)]
    got = _rows(spark, "a string, b string", rows, r=C.caption_kind(F.col("a"), F.col("b"), R.FIGURE_KINDS))
    assert [r[0] for r in got] == ["gel_or_blot", "phylogeny", "domain_structure", "workflow_model", "unknown", "unknown"]
    rows = [("LC50 values", None), ("Primer pairs", None), ("A regression", "chi-square"), ("Data not shown", None), ("none", None)]
    got = _rows(spark, "a string, b string", rows, r=C.caption_kind(F.col("a"), F.col("b"), R.TABLE_KINDS))
    assert [r[0] for r in got] == ["toxicity_or_bioassay", "primer_or_plasmid", "statistics_or_model", "supplementary_index", "unknown"]
