"""Tables in texts and labels matched to assets, on literal rows and against plain loops."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from papyrine.operators import matching as M
from papyrine.operators import table_text as T


def structure(spark, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r for r in T.table_structure(rows, "t", **options).orderBy("i").collect()]


def test_gate(spark):
    got = structure(spark, None, "", "short\nx", "one line that is longer than twenty characters", "plain prose of a line\nand more plain prose of another", "a  b\nc  d  e\nf  g  h  i\nwords and more words")
    assert [(r.status, r.method, r.confidence, r.header) for r in got] == [("structure_pending", "unavailable", "none", None)] * 4 + [("complex_structure_skipped", "skipped_complex", "none", None)] * 2


def test_markdown_tables(spark):
    (r,) = structure(spark, "Caption\n| Gene | Dose |\n|:---|---:|\n| a | 1 |\n| b | |\n||\n| c | 3 | more |\n")
    assert (r.status, r.method, r.header, r.cells) == ("simple_structure_extracted", "markdown_like", ["Gene", "Dose"], [["a", "1"], ["b", ""], ["c", "3", "more"]])
    assert (r.width, r.empty_rows, r.confidence) == (3, 0, "medium")  # two of three rows agree
    (r,) = structure(spark, "| 1 | 2 |\n| 3 | 4 |\nfurther words here")
    assert r.confidence == "medium" and r.header == ["1", "2"]
    (r,) = structure(spark, "Gene | Dose\na | 1\nb | 2 and more", bare_pipes=True)
    assert (r.method, r.header, r.cells, r.confidence) == ("markdown_like", ["Gene", "Dose"], [["a", "1"], ["b", "2 and more"]], "high")


def test_tab_delimited(spark):
    (r,) = structure(spark, "Gene\tDose\ta\nx\t1\n\ny\t2\t3\t4\r\nno tab in this line")
    assert (r.method, r.header, r.cells, r.width) == ("tab_delimited", ["Gene", "Dose", "a"], [["x", "1"], ["y", "2", "3", "4"]], 4)
    assert r.confidence == "medium"


def test_aligned_by_gaps(spark):
    (r,) = structure(spark, "1.5  2.5  x  z\nGene  Dose  Time  Place\n3   4  5  6\nlonely line")
    assert (r.method, r.header, r.cells) == ("whitespace_aligned", ["Gene", "Dose", "Time", "Place"], [["1.5", "2.5", "x", "z"], ["3", "4", "5", "6"]])
    assert r.confidence == "high"
    (r,) = structure(spark, "1  2  3\n4  5  6\n7  8  9\n10  11  12")
    assert r.header == ["1", "2", "3"] and len(r.cells) == 3 and r.confidence == "medium"
    wide = "  ".join(f"c{i}" for i in range(31))
    assert [r.status for r in structure(spark, f"{wide}\n{wide}", "\n".join(["a  b"] * 101), "\n".join(["a  b"] * 100))] == ["complex_structure_skipped"] * 2 + ["simple_structure_extracted"]


def test_flat_cells(spark):
    (r,) = structure(spark, "|only bar|\n|another bar|\nGene  Dose  Time  a  1  2  b  3  4")
    assert (r.method, r.header, r.cells) == ("whitespace_flat", ["Gene", "Dose", "Time"], [["a", "1", "2"], ["b", "3", "4"]])


def flat_by_hand(cells):
    """The rule as a loop: of 3 to 12 columns the one whose header and number of rows score best."""
    best, width = 0.0, 0
    for n in range(3, 13):
        if n > len(cells) // 2 or (len(cells) % n and len(cells) % n < n - 2):
            continue
        share, rows = sum(bool(re.search("[A-Za-z]", c)) for c in cells[:n]) / n, len(cells) // n - 1
        if share >= 0.3 and rows >= 1 and share + min(rows * 0.1, 0.5) > best + 1e-12:
            best, width = share + min(rows * 0.1, 0.5), n
    return width


def test_flat_widths_against_a_loop(spark):
    rng = random.Random(6)
    many = [[rng.choice(["a", "b1", "7", "8.5"]) for _ in range(rng.randint(6, 40))] for _ in range(60)]
    got = structure(spark, *["|x|\n|y|\n" + "  ".join(c) for c in many])
    for cells, r in zip(many, got, strict=True):
        n = flat_by_hand(cells)
        assert (len(r.header) if r.header else 0) == n
        if n:
            assert r.header == cells[:n] and r.cells == [cells[i : i + n] for i in range(n, len(cells) - n + 1, n)]


def test_delimited_texts(spark):
    rows = [(1, ' , \nName;x, b ,"c, d"\n1,2,3,4,5\n\n"two\nlines",x\n', 0), (2, None, 0), (3, "", 0), (4, "a;b;c\n1;2", 0), (5, "a\tb\tc;d\n", 0), (6, "a,b\rc", 0), (7, "\n\n", 0), (8, ",".join(map(str, range(60))), 0)]
    df = spark.createDataFrame(rows, "k int, t string, status int")
    got = {r.k: (r.status, r.delimiter, r.n_rows, r.n_columns, r.header, r.empty_rows, r.shown) for r in T.delimited_structure(df, "k", "t").collect()}
    assert got[1] == ("parsed", ",", 5, 5, ["Name;x", "b", "c, d"], 2, [["1", "2", "3", "4", "5"], [], ["two\nlines", "x"]])
    assert got[2][:3] == got[3][:3] == ("empty", ",", 0)
    assert got[4] == ("parsed", ";", 2, 3, ["a", "b", "c"], 0, [["1", "2"]])
    assert got[5][1] == "\t" and got[6][0] == "failed" and got[7] == ("parsed", ",", 2, 0, [], 2, [])
    assert got[8][3] == 60 and got[8][4] == [str(i) for i in range(50)]
    assert T.delimited_structure(df, "k", "t", shown=1).where("k = 1").first().shown == [["1", "2", "3", "4", "5"]]


def test_ratio_is_that_of_difflib(spark):
    rng = random.Random(7)
    pairs = [("".join(rng.choices("abcAB 1", k=rng.randint(0, 14))), "".join(rng.choices("abcAB 1", k=rng.randint(0, 20)))) for _ in range(10_000)]
    pairs += [("x" * 300 + "y", "xy" * 150), ("", ""), ("a", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", M.likeness(F.array("a"), F.col("b")).alias("r"), M.likeness(F.array("a"), F.col("b"), 0.6).alias("high"), M.could_be_like(F.array("a"), F.col("b"), 0.6).alias("may")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got, strict=True):
        exact = SequenceMatcher(None, a, b).ratio()
        assert r.r == exact and r.high == (exact if exact >= 0.6 else 0.0) and (r.may or exact < 0.6)
    none = spark.createDataFrame([(None, "x")], "a string, b string").select(M.likeness(F.array("b"), F.col("a")).alias("r"))
    assert none.first().r is None


def test_variants(spark):
    def of(label):
        return spark.createDataFrame([(label,)], "l string").select(M.search_variants(F.col("l")).alias("v")).first().v

    assert of("Figure") == ["Figure"]
    assert of("Figure S1") == ["Figure S1", "Figure_S1", "Figure-S1", "FigureS1", "figure_S1", "figure-S1", "figureS1", "Fig_S1", "Fig-S1", "FigS1", "Fig._S1", "Fig.S1", "Fig S1", "S1", "Figure_1", "Figure-1", "Figure 1", "Fig_1", "Fig.1", "1"]
    assert of("Odd name 2")[:2] == ["Odd name 2", "Odd name_2"] and of("Odd name 2")[-1] == "2" and len(of("Table 3")) == 14


ASSETS = [
    ("p", "a1", "figure_image", "fig_s1.png", None, None, 1),
    ("p", "a2", "supplementary_table", "data.xlsx", "Table S2.xlsx", "", 2),
    ("p", "a3", "figure_image", "image3.png", "", "shows Figure S7 in full", 3),
    ("p", "a4", "supplementary_pdf", "suppl.pdf", None, None, 4),
    ("p", "a5", "dataset", "reads.tsv", None, None, 5),
    ("q", "b1", "figure_image", "f.png", None, None, 1),
]
NOTES = [("p", "Figure S4", "Figure S4 - see image3.png"), ("p", "Figure S5", "Figure S5 - no name"), ("p", "Dataset of reads", "x")]


def matched(spark, mentions, assets=None, notes=None, **options):
    m = spark.createDataFrame(mentions, "mention int, paper string, label string, kind string")
    a = spark.createDataFrame(assets or ASSETS, "paper string, asset string, type string, filename string, original string, notes string, place int")
    n = spark.createDataFrame(notes if notes is not None else NOTES, "paper string, label string, line string")
    return {r.mention: (r.asset, r.method, r.confidence, r.status) for r in M.match_labels(m, a, n, **options).collect()}


def test_steps_of_the_match(spark):
    got = matched(spark, [
        (1, "p", "Figure S4", "figure"), (2, "p", "Figure S5", "figure"), (3, "p", "Figure S1", "figure"), (4, "p", "Table S2", "table"), (5, "p", "Figure S7", "figure"), (6, "p", "", "figure"), (7, "p", None, None),
        (8, "p", "Dataset of reeds", "dataset"), (9, "q", "Table S2", "table"), (10, "none", "Figure S1", "figure"), (11, "p", "Figure S1", "figure"), (12, "p", "zzz qqq", "other"), (13, "p", "suppl", "supplementary"),
    ])
    assert got[1] == ("a3", "notes", 0.95, "matched")
    assert got[2] == ("a1", "notes", 0.85, "matched")
    assert got[3] == got[11] == ("a1", "filename", 0.9, "matched")
    assert got[4] == ("a2", "filename", 0.9, "matched")
    assert got[5] == ("a3", "caption", 0.8, "matched")
    assert got[6] == got[7] == got[9] == got[10] == got[12] == (None, "none", 0.0, "unmatched")
    assert got[8] == ("a5", "notes", 0.75, "matched")
    assert got[13] == ("a4", "filename", 0.9, "matched")


def cascade(mention, assets, notes, types):
    """The five steps as a plain loop over one paper."""
    _, paper, label, kind = mention
    if not label:
        return None, "none", 0.0, "unmatched"
    own = sorted((a for a in assets if a[0] == paper), key=lambda a: a[6])
    lines = {n[1]: n[2] for n in sorted(n for n in notes if n[0] == paper)}
    target = types.get(kind, "")
    head, _, num = label.rpartition(" ")
    brief = M.SHORT_FORMS.get(head, head)
    spelled = [label]
    if " " in label:
        spelled += [h + s + num for h, seps in ((head, "_-"), (head.lower(), "_-"), (brief, "_-")) for s in [*seps, ""]] + [f"{brief}._{num}", f"{brief}.{num}", f"{brief} {num}", num]
        if num.startswith("S"):
            b = num[1:]
            spelled += [f"{head}_{b}", f"{head}-{b}", f"{head} {b}", f"{brief}_{b}", f"{brief}.{b}", b]
    spelled = [v.lower() for v in spelled]
    typed = [a for a in own if a[2] == target]
    fits = [a for a in own if not target or a[2] == target or (target == "supplementary_pdf" and "supplementary" in a[2])]
    tried = []
    note = None
    if label in lines:
        named = [a for a in own if any(x and x.lower() in lines[label].lower() for x in a[3:5])]
        note = (named[0], 0.95) if named else (typed[0], 0.85) if typed else None
    if note is None and typed:
        r = max((SequenceMatcher(None, v, n.lower()).ratio() for v in spelled for n in lines), default=0)
        note = (typed[0], min(r, 0.75)) if r >= 0.6 else None
    tried.append(("notes", note))
    exact = [a for a in fits if any(x and v in x.lower() for x in a[3:5] for v in spelled)]
    tokens = [(max((len(set(re.findall("[a-z0-9]+", v)) & set(re.findall("[a-z0-9]+", x.lower()))) / len(set(re.findall("[a-z0-9]+", v))) for x in a[3:5] if x for v in spelled if re.findall("[a-z0-9]+", v)), default=0), a) for a in fits]
    top = max((t for t, _ in tokens), default=0)
    tried.append(("filename", (exact[0], 0.9) if exact else (next(a for t, a in tokens if t == top), min(top, 0.85)) if top >= 0.5 else None))
    noted = [a for a in (own if not target else typed) if a[5] and label.lower() in a[5].lower()]
    tried.append(("caption", (noted[0], 0.8) if noted else None))
    if max((t[1][1] for t in tried if t[1]), default=0) < 0.7:
        ratios = [(max((SequenceMatcher(None, v, x.lower()).ratio() for x in a[3:6] if x for v in spelled), default=0), a) for a in fits]
        top = max((r for r, _ in ratios), default=0)
        tried.append(("fuzzy", (next(a for r, a in ratios if r == top), min(top, 0.65)) if top >= 0.45 else None))
    best, method, score = None, "none", 0.0
    for name, hit in tried:
        if hit and hit[1] > score:
            best, method, score = hit[0], name, hit[1]
    if score < 0.5:
        return None, "none", 0.0, "unmatched"
    return best[1], method, score, "matched" if score >= 0.7 else "low_confidence"


def test_match_against_a_loop(spark):
    rng = random.Random(12)
    words = ["Figure", "Table", "Dataset", "fig", "tab", "s1", "S2", "S11", "3", "map", "of", "x"]
    kinds = ["figure", "table", "dataset", "supplementary", "other"]

    def name():
        return rng.choice(["", None, "_".join(rng.choices(words, k=rng.randint(1, 3))) + ".png", " ".join(rng.choices(words, k=2))])

    assets = [(p, f"{p}{i}", rng.choice([*M.KIND_TYPES.values(), "supplementary_note"]), name(), name(), name(), i) for p in "pqr" for i in range(9)]
    mentions = [(i, rng.choice("pqrs"), f"{rng.choice(words)} {rng.choice(words)}" if i % 5 else rng.choice(words), rng.choice(kinds)) for i in range(150)]
    notes = [(rng.choice("pqr"), f"{rng.choice(words)} {rng.choice(words)}", f"line {rng.choice(assets)[3]} {i}") for i in range(20)]
    got = matched(spark, mentions, assets, notes)
    for m in mentions:
        asset, method, score, status = cascade(m, assets, notes, M.KIND_TYPES)
        found = got[m[0]]
        assert (found[0], found[1], found[3]) == (asset, method, status) and abs(found[2] - score) < 0.0051, m
    assert {g[1] for g in got.values()} >= {"notes", "filename", "fuzzy", "none"}


@pytest.mark.parametrize("name", ["jn16_best_match", "jn16b_like_match", "tx16_table_text", "src8_table_structure"])
def test_registered(name):
    from papyrine.plans.registry import oracle_sql, queries

    assert name in queries() and (name in oracle_sql()) == (name != "jn16b_like_match")
