"""Dictionary tags on literal rows."""

import pytest

from papyrine.operators.tagging import Matcher, TagRule, problems, score_tags, tag_hits, term_pattern

RULES = [
    TagRule("toxin", "vip3", ("Vip3A", "vip  three"), ("vip3[a-z]+",), (r"not vip",), weight=1.0, min_score=2.0),
    TagRule("method", "blot", ("western blot",), weight=2.0, min_score=2.0, required_sections=("results",)),
    TagRule("host", "moth", ("moth",), weak_sections=("introduction",)),
]


def _scores(spark, rows, rules=RULES):
    df = spark.createDataFrame(rows, "id long, source string, text string, tag string")
    got = score_tags(tag_hits(df, "id", "source", "text", rules), "id", rules).collect()
    return sorted((r.id if r.id is not None else -1, r.tag, r.hits, r.score, r.assignable_score, r.confidence, r.assigned) for r in got)


def test_scores(spark):
    rows = [
        (1, "title", "A study of VIP3A", "x"),  # the term and the pattern: two hits of weight 3
        (1, "raw", "## Methods\nwestern  blot\n## Results\na western\nblot of a moth. Moths\n", "x"),
        (2, "raw", "It is not vip3A that works", "x"),  # excluded
        (2, "abstract", "moth", "x"),
        (3, "raw", "# References\nmoth, vip3A\n# Introduction\nmoth and vip three\n", "x"),
        (4, "raw", None, "x"),
        (5, "raw", "", "x"),
        (None, None, "a moth", None),
    ]
    assert _scores(spark, rows) == [
        (-1, "moth", 1, 1.0, 1.0, "medium", True),
        (1, "blot", 2, 5.0, 4.0, "high", True),
        (1, "moth", 1, 2.0, 2.0, "high", True),
        (1, "vip3", 2, 6.0, 6.0, "high", True),
        (2, "moth", 1, 2.5, 2.5, "high", True),
        (3, "moth", 2, 1.0, 0.0, "low", False),
        (3, "vip3", 3, 1.0, 1.0, "low", False),
    ]


def test_repeated_rows_and_places_count_once(spark):
    row = (7, "raw", "moth moth MOTH", "x")
    assert _scores(spark, [row, row]) == [(7, "moth", 1, 1.0, 1.0, "medium", True)]
    assert _scores(spark, []) == []


def test_exclusion_reaches_eighty_characters():
    m = Matcher(RULES[0])
    assert list(m.hits("not vip" + " " * 80 + "Vip3A", 80)) != []
    assert list(m.hits("not vip" + " " * 73 + "Vip3A", 80)) == []


def test_terms():
    assert term_pattern("  ") is None
    assert term_pattern("a+  b") == r"(?<!\w)a\+\s+b(?!\w)"


def test_problems():
    known = [("toxin", "vip3"), ("method", "blot"), ("host", "moth")]
    assert problems(RULES, known) == []
    wrong = [TagRule("a", "b", include=("(",)), TagRule("a", "b", exclude=("[",)), TagRule(" ", "c")]
    assert [p.split(":")[0] for p in problems(wrong, [("a", "z")])] == [
        "b.include has invalid pattern '('",
        "a/b is repeated",
        "b.exclude has invalid pattern '['",
        "a rule has no name",
        "a/z of the ontology is missing",
        " /c is outside the ontology",
        "a/b is outside the ontology",
    ]


def test_invalid_patterns_raise(spark):
    import re

    with pytest.raises(re.error):
        tag_hits(spark.createDataFrame([(1, "a", "b")], "id long, source string, text string"), "id", "source", "text", [TagRule("a", "b", include=("(",))])


def test_quick_and_slow_searches_agree():
    import random

    from papyrine.operators.tagging import lowered

    rng = random.Random(3)
    rule = TagRule("a", "b", ("Vip3A", "Vip  three", "s", "kİ", "straße"), ("vip3[a-z]+", r"Moth\w", r"\bmo\S+", "[^m]oth", r"\Wm"), (r"not vip",))
    m = Matcher(rule)
    pieces = ["vip3A", "VIP3ab", "Vip", "three", "not", " ", "\n", "moth", "MOTHS", "s", "S", "ſ", "kİ", "straße", "STRASSE", "-", "K", "vip3avip3a"]
    for _ in range(400):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        assert list(m.hits(text, 8, lowered(text))) == list(m.hits(text, 8))
