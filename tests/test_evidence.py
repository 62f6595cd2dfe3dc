"""Evidence, questions and table statistics on literal rows, with the fixed rule tables."""

import pytest
from pyspark.sql import functions as F

from papyrine.functions import evidence as E


def _one(spark, column, *values):
    """Results of a column of ``t`` over texts, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", column.alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


LONG = "It was seen that the treated larvae of both groups died within three days of the start of it."


def test_sections(spark):
    text = f"A title\nAbstract\n{LONG}\n  1. Materials and Methods \n{LONG} One.\nResults and Discussion\n{LONG} Two.\n{LONG} Three.\n2 Methods\nmore\n"
    got = {s.section: (s.quality, s.text) for s in _one(spark, E.sections(F.col("t")), text)[0]}
    assert got["abstract"] == ("found", LONG)
    assert got["methods"] == ("found", f"{LONG} One. more")
    both = f"{LONG} Two. {LONG} Three."
    assert got["results_and_discussion"] == ("found", both)
    assert got["results"] == got["discussion"] == ("combined", both)
    assert got["introduction"] == got["conclusion"] == ("fallback_full", text)  # the body is short: the whole text


def test_sections_without_headings(spark):
    body = LONG * 6
    plain, blank, none = _one(spark, E.sections(F.col("t")), body, " \n\t", None)
    assert {(s.text, s.quality) for s in plain[:6]} == {(body, "fallback_full")}
    assert {(s.text, s.quality) for s in blank + none} == {("", "missing")}
    assert [s.text for s in _one(spark, E.sections(F.col("t"), most=10), body)[0]][:2] == [body[:10]] * 2


@pytest.mark.parametrize(
    ("line", "label"),
    [
        ("METHODS", "methods"),
        ("Discussion of the results", "results_and_discussion"),
        ("General discussion", "discussion"),
        ("Findings", "results"),
        ("Summary", "conclusion"),
        ("Background and abstract", "abstract"),
        ("3. " + "Results of this long heading that is made of words alone and of nothing else at all b", "results"),
        ("The results, as we saw them, do not make a heading of a line that is longer than eighty characters", None),
        ("Acknowledgements", None),
    ],
)
def test_headings(spark, line, label):
    assert _one(spark, E.heading_label(F.col("t")), line) == [label]


def test_key_results(spark):
    text = "Short. We found that mortality was higher in the group. The yield was not associated with any dose! It was observed by others in the field. Nothing of interest is in this sentence here. Findings differ"
    rows = _one(spark, E.key_results(F.col("t"), "Results"), text, None, "", "x" * 700)
    assert [(r.place, r.direction, r.confidence) for r in rows[0]] == [(1, "increase", "high"), (2, "no_association", "low"), (3, "descriptive", "medium")]
    assert rows[1:] == [[], [], []]
    directed = _one(spark, E.key_results(F.col("t"), "Results", 1, True), text)[0]
    assert [(r.place, r.section) for r in directed] == [(1, "Results")]


def test_chained_results(spark):
    told = "We found that the mortality was higher in the treated group than before. "
    plain = "Nothing at all of any interest is in this sentence of the text. "
    schema = "results string, discussion string, abstract string, conclusion string"
    rows = [(told * 3, plain * 4, plain, plain), (plain * 4, told * 6, plain, plain), (plain * 4, plain * 4, told, plain), (told, plain, plain, plain), (told * 2, plain, "", ""), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    texts = {n: F.col(n) for n in ("abstract", "results", "discussion", "conclusion")}
    got = [[x.section for x in r.k] for r in df.select("i", E.chained_results(texts).alias("k")).orderBy("i").collect()]
    assert got == [["Results"] * 3, ["Discussion"] * 5, ["Abstract_Conclusion"], [], ["Full_text"] * 2, []]


def test_core_findings(spark):
    text = "First we say a thing that is of no use. And then we say another of them. Taken together, the toxin kills larvae. A last sentence that ends it all here."
    df = spark.createDataFrame([(0, text, text, "We found a higher mortality in all of the groups."), (1, "", None, "We found a higher mortality in all of the groups."), (2, None, None, None)], "i int, c string, a string, r string")
    df = df.withColumn("k", E.key_results(F.col("r"), "Results"))
    got = [[(x.section, x.confidence, x.finding[:10]) for x in r.f] for r in df.select("i", E.core_findings(F.col("c"), F.col("a"), F.col("k")).alias("f")).orderBy("i").collect()]
    assert got == [[("Conclusion", "medium", "Taken toge"), ("Conclusion", "low", "A last sen")], [("Results", "medium", "We found a")], []]


def test_methods(spark):
    text = "The western blotting was performed by us. RNA-seq data; proteins were measured using a new sensor. Then western blotting was performed by us."
    rows = _one(spark, E.methods(F.col("t")), text, None, "")
    got = [(m.name, m.kind, m.confidence) for m in rows[0]]
    assert got[:3] == [("western blotting", "assay", "medium"), ("western blot", "assay", "medium"), ("rna-seq", "sequencing", "medium")]
    assert ("The western blotting was performed", "experiment", "low") in got
    assert ("measured using a new sensor", "experiment", "low") in got
    assert rows[0][2].quote.startswith("The western blotting was performed by us. RNA-seq data")
    assert rows[1:] == [[], []]
    many = ". ".join(["assay analysis sequencing microscopy imaging crystallography docking profiling proteomics survey validation binding culture elisa"])
    assert len(_one(spark, E.methods(F.col("t")), many)[0]) == 12


def test_method_noise_and_scope(spark):
    noise, flags = E.method_noise(F.col("t"))
    rows = spark.createDataFrame([(0, "As described above, samples were used"), (1, "qPCR was used on the samples of all groups of the second year"), (2, None)], "i int, t string").select("i", noise.alias("n"), flags.alias("f")).orderBy("i").collect()
    assert [(r.n, r.f) for r in rows] == [
        (True, ["generic_method_phrase", "missing_specific_method_name", "low_information_method"]),
        (False, ["generic_method_phrase"]),
        (True, ["missing_specific_method_name", "low_information_method"]),
    ]
    assert _one(spark, E.out_of_scope(F.col("t")), "Tell me a joke", "A joke on toxin", "hello", None) == [True, False, False, False]


@pytest.mark.parametrize(
    ("question", "intent"),
    [
        ("Which species is it?", "search_by_species"),
        ("How to measure it by protocol", "method_query"),
        ("Which protocol", "search_by_method"),
        ("Which claims are made", "claim_query"),
        ("compare CASP3 in the supplementary table", "supplementary_entity_comparison_query"),
        ("Is MAP2K4 a gene", "supplementary_entity_query"),
        ("Is Log2FC in a supplement", "hybrid_search"),
        ("where is p53 found", "supplementary_entity_query"),
        ("the latest work", "search_by_year"),
        ("hello", "hybrid_search"),
        (None, "hybrid_search"),
    ],
)
def test_literature_intents(spark, question, intent):
    assert _one(spark, E.literature_intent(F.col("t")), question) == [intent]


TYPES = [("a", ("alpha", "axe"), ("x", "y", "z")), ("b", ("beta",), ("x", "y")), ("c", ("gamma", "gamma"), ())]


def test_types_by_two_tiers(spark):
    scored = E.two_tiers(F.col("t"), TYPES, (0.70, 0.15, 0.98), (0.40, 0.10, 0.65), 0.30, 2)
    got = [(r.label, round(r.confidence, 2), r.alternatives) for r in _one(spark, E.best_type(scored), "beta", "x y", "y", "alpha axe beta gamma", "beta x y", "beta gamma", "none", None)]
    assert got == [("b", 0.85, []), ("a", 0.6, ["b"]), ("a", 0.3, []), ("a", 0.98, ["b", "c"]), ("b", 0.85, ["a"]), ("c", 0.98, ["b"]), ("unknown", 0.0, []), ("unknown", 0.0, [])]


def test_table_statistics(spark):
    rows = [
        (0, ["Gene", "p_value", "log2FC"], [["g", "0.0004", "1"], ["h", "0.02", "2"], ["i", "1.5", "x"], ["j", "n/a", None]] + [["k", "0.5", ""]] * 16 + [["late", "0.0001", ""]]),
        (1, ["Kind"], [["0.01"]]),
        (2, ["zz", "FDR"], [["a"]]),
        (3, [], []),
    ]
    df = spark.createDataFrame(rows, "i int, h array<string>, r array<array<string>>")
    fields = E.stat_fields(F.col("h"))
    got = df.select("i", fields.alias("f"), E.stat_confidence(fields).alias("c"), E.p_thresholds(F.col("h"), F.col("r")).alias("p")).orderBy("i").collect()
    assert [[(x.field, x.columns) for x in r.f] for r in got] == [
        [("p_value", ["p_value"]), ("log2FC", ["log2FC"]), ("fold_change", ["log2FC"]), ("n", ["Gene"])],
        [("n", ["Kind"])],
        [("fdr", ["FDR"])],
        [],
    ]
    assert [r.c for r in got] == [0.7, 0.4, 0.4, 0.0]
    assert tuple(got[0].p) == (0.0004, 0.5, 2, 1, 1)
    assert [r.p for r in got[1:]] == [None, None, None]


def _typed(spark, tiers, rules, reasons, *texts, headers=()):
    from papyrine.functions import type_tables as T

    words = F.regexp_replace(F.lower(F.concat_ws(" ", F.array(*map(F.lit, headers)), F.col("t"))), r"[_.\-]", " ")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("w", words).withColumn("b", E.best_type(E.two_tiers(F.col("w"), rules, *tiers)))
    keys = E.key_columns(F.col("b.label"), F.array(*map(F.lit, headers)).cast("array<string>"))
    kind = E.subtype(F.col("w"), F.col("b.label"))
    rows = df.select("i", "b.*", E.reason(F.col("w"), F.col("b.label"), rules, tiers[3], reasons).alias("why"), keys.alias("keys"), kind.alias("sub")).orderBy("i").collect()
    assert T.TABLE_TYPES and len(T.FIGURE_TYPES) == 13
    return rows


def test_table_types_by_the_fixed_words(spark):
    from papyrine.functions import type_tables as T

    headers = ("Gene_ID", "log2FC", "padj", "Fold.Change", "note")
    (r,) = _typed(spark, T.TABLE_TIERS, T.TABLE_TYPES, T.TABLE_REASONS, "", headers=headers)
    assert (r.label, round(r.confidence, 2), r.why) == ("differential_expression", 0.95, "Matched headers: log2fc, padj, fold change")
    assert [(k.key, k.columns) for k in r.keys] == [("gene", ["Gene_ID"]), ("log2fc", ["log2FC"]), ("padj", ["padj"])]
    got = _typed(spark, T.TABLE_TIERS, T.TABLE_TYPES, T.TABLE_REASONS, "LC50 of larvae", "counts", "adduct", "spectra pcr mutant", "none of it", None)
    assert [(r.label, r.why) for r in got[:3]] == [("lc50_table", "Matched headers: lc50, lc50"), ("gene_expression", "Matched headers: counts"), ("metabolomics", "Weak match: adduct")]
    assert (got[3].label, got[3].confidence, got[3].why) == ("proteomics", 0.35, "Weak match: spectra")
    assert [(r.label, r.confidence, r.why) for r in got[4:]] == [("unknown", 0.0, "No matching patterns found.")] * 2


def test_figure_types_by_the_fixed_words(spark):
    from papyrine.functions import type_tables as T

    got = _typed(spark, T.FIGURE_TIERS, T.FIGURE_TYPES, T.FIGURE_REASONS, "Confocal microscopy of the midgut", "western_blot_1.png", "SDS-PAGE of a protein, agarose gel", "band of some kDa", "a ladder", "Crystal structure", "x")
    assert [(r.label, round(r.confidence, 2), r.sub, r.why) for r in got] == [
        ("microscopy", 0.98, "confocal", "Matched keywords: microscop, confocal"),
        ("western_blot", 0.85, "", "Matched keywords: western blot"),
        ("gel_image", 0.98, "agarose gel", "Matched keywords: sds page, agarose gel"),
        ("western_blot", 0.6, "", "Partial match: band, kda"),
        ("gel_image", 0.3, "", "Weak match: ladder"),
        ("structure_model", 0.85, "X-ray crystallography", "Matched keywords: crystal structure"),
        ("unknown", 0.0, "", ""),
    ]


def test_two_tiers_plan_does_not_grow_with_the_words(spark):
    few = (("a", ("alpha",), ("beta",)),)
    many = tuple((f"t{i}", tuple(f"w{i}x{j}" for j in range(20)), ("beta",)) for i in range(20))
    df = spark.createDataFrame([("w3x1 w3x2 beta",), (None,)], "t string")
    sizes = []
    for rules in (few, many):
        plan = df.select(E.best_type(E.two_tiers(F.col("t"), rules, (0.7, 0.1, 0.95), (0.5, 0.1, 0.7), 0.3, 2)).alias("b"))
        sizes.append(plan._jdf.queryExecution().optimizedPlan().toString().count("Contains("))
    assert sizes[0] == sizes[1] and sizes[1] <= 2
    assert [(r.b.label, r.b.confidence) for r in plan.collect()] == [("t3", 0.9), ("unknown", 0.0)]


def test_stat_headers_are_put_in_lower_case_once(spark):
    df = spark.createDataFrame([(["P-Value", "other"], [["0.01", "x"], ["2", "y"]])], "h array<string>, r array<array<string>>")
    out = df.select(E.stat_fields(F.col("h")).alias("f"), E.p_thresholds(F.col("h"), F.col("r")).alias("p"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2
    row = out.collect()[0]
    assert ["P-Value"] in [f["columns"] for f in row.f] and (row.p.low, row.p.below_05) == (0.01, 1)
