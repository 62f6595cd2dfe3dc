"""Repeated phrases, JSON repair and representatives, on literal rows and against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from papyrine.functions import repair as P
from papyrine.operators import representatives as D


def cleaned(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.cleaned_words(F.col("t")).alias("w"))
    df = df.withColumn("long", F.size("w") >= P.LEAST_WORDS)
    for k in P.PHRASE_WORDS:
        df = df.withColumn("w", F.when(F.col("long"), P.without_repeat(F.col("w"), k)).otherwise(F.col("w")))
    return [" ".join(r.w) for r in df.orderBy("i").collect()]


def by_hand(text):
    for a in P.ARTEFACTS:
        text = text.replace(a, "")
    words = text.split()
    if len(words) > 8:
        for k in (5, 6):
            for i in range(len(words) - 2 * k):
                if words[i : i + k] == words[i + k : i + 2 * k] and len(" ".join(words[i : i + k])) > 12:
                    words = words[: i + k] + words[i + 2 * k :]
                    break
    return " ".join(words)


def test_repeated_phrases(spark):
    told = "alpha beta gamma delta epsilon"
    texts = [None, "", "null null a  b undefined", f"{told} {told} end", f"{told} {told}", f"so {told} {told} {told} x", "a b c d e a b c d e f g", f"{told} zeta {told} zeta eta"]
    got = cleaned(spark, *texts)
    assert got == [by_hand(t or "") for t in texts]
    assert got[2] == "a b" and got[3] == f"{told} end" and got[4] == f"{told} {told}"  # the very last phrase stays
    assert got[6] == texts[6]  # too short a phrase
    rng = random.Random(2)
    many = [" ".join(rng.choices(["alpha", "beta", "of"], k=rng.randint(0, 60))) for _ in range(120)] + [" ".join(["longer", "words"] * 3000)]
    assert cleaned(spark, *many) == [by_hand(t) for t in many]


@pytest.mark.parametrize(
    ("text", "value", "how"),
    [
        (' {"a": 1} ', {"a": 1}, "plain"),
        ("3", 3, "plain"),
        ('Answer:\n```json\n{"a": [1, 2]}\n```\nbye', {"a": [1, 2]}, "fenced"),
        ('```\n{"a": 1,}\n```', {"a": 1}, "repaired"),
        ('so {"a": {"b": "}"}} and {"c": 2}', {"a": {"b": "}"}}, "repaired"),
        ('{"a": [1, 2 , ] , }', {"a": [1, 2]}, "repaired"),
        ('{"a": "x, }", "b": [1, {"c": "y', {"a": "x, }", "b": [1, {"c": "y"}]}, "repaired"),
        ('{"a": 1, "b": ', {"a": 1}, "repaired"),
        ('{"a": 1, "bcd', {"a": 1}, "repaired"),
        ('{"a": 1, "b\\', {"a": 1}, "repaired"),
        ('{"a": "say \\"no\\"", ', {"a": 'say "no"'}, "repaired"),
        ('["x", "y', ["x", "y"], "repaired"),
        ("{", {}, "repaired"),
        ('{"a": [1, 2}', None, "none"),
        ("no json at all", None, "none"),
        ('"k": 69}', None, "none"),
        ("", None, "none"),
    ],
)
def test_json(text, value, how):
    found, way = P.found_json(text)
    assert way == how and (found is None if how == "none" else json.loads(found) == value)


def test_json_column(spark):
    rows = spark.createDataFrame([(1, '{"k": 2'), (2, None), (3, "[]")], "i int, t string").select("i", P.json_of(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r.j and tuple(r.j) for r in rows] == [('{"k": 2}', "repaired"), None, ("[]", "plain")]


def test_cut_off_objects_stay_json():
    rng = random.Random(4)
    whole = json.dumps({"a": [1, {"b": 'q"\\', "c": None}], "d": {"e": [[], {}], "f": "x,y:z"}, "g": True})
    for cut in range(1, len(whole)):
        mended = P.repaired(whole[:cut])
        kept = json.loads(mended) if P._loads(mended) else None
        if kept is None:  # only a number, word or escape that is itself cut
            assert whole[cut - 1] in "tTrueNonlfas\\" or rng is None, whole[:cut]


def test_scores(spark):
    rows = spark.createDataFrame([(1.0, ["x"], 2000), (None, [], None), (0.5, None, 0)], "s double, t array<string>, y int")
    got = [r.r for r in rows.select(D.score(F.col("s"), F.col("t"), F.col("y")).alias("r")).collect()]
    assert got == pytest.approx([0.6, 0.0, 0.2])


def chosen(rows, most):
    order = sorted(rows, key=lambda r: (-r[2], r[1]))
    taken, buckets = [], []
    for _, key, _, year in order:
        b = (year or 0) // 5
        if len(taken) < most and not (len(taken) >= 2 and buckets.count(b) >= 2):
            taken.append(key)
            buckets.append(b)
    if len(taken) < min(3, most):
        taken += [key for _, key, _, _ in order if key not in taken][: most - len(taken)]
    return taken


def test_representatives_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(g, g * 100 + i, rng.choice([0.1, 0.4, rng.random()]), rng.choice([None, 1999, 2000, 2003, 2011, 2024][: rng.randint(1, 6)])) for g in range(25) for i in range(rng.randint(1, 14))]
    rows += [(99, i, 0.5, 2001) for i in range(9)]  # one bucket only
    df = spark.createDataFrame([(*r, "x") for r in rows], "topic int, paper int, score double, year int, place string").drop("place")
    for most in (5, 2):
        got = {}
        for r in D.representatives(df, "topic", "paper", most).orderBy("topic", "place").collect():
            got.setdefault(r.topic, []).append(r.paper)
        assert got == {g: chosen([r for r in rows if r[0] == g], most) for g in {r[0] for r in rows}}
