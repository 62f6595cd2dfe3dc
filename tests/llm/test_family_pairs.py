"""A family of lines near the threshold: what the last round of op6 compares, against plain loops."""

import random

from papyrine.llm import fuzzy_lines as L
from papyrine.llm import linking
from papyrine.llm.linking import deal
from papyrine.llm.scratch import Scratch


def _near(rng, line, changes):
    out = list(line)
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice("abcdefghijklmnop")
    return "".join(out)


def test_a_pair_of_many_buckets_is_met_once(spark, monkeypatch):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(250))
    rows = [(i, _near(rng, base, 4)) for i in range(120)]
    met = []
    distinct = type(spark.range(0)).distinct

    def counted(self):
        if self.columns == ["a", "b"]:
            met.append((self.count(), distinct(self).count()))
        return distinct(self)

    between = linking._between

    def last(*args):
        monkeypatch.setattr(type(spark.range(0)), "distinct", counted)
        try:
            return between(*args)
        finally:
            monkeypatch.setattr(type(spark.range(0)), "distinct", distinct)

    monkeypatch.setattr(linking, "_between", last)
    L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert met and all(n == d for n, d in met) and sum(n for n, _ in met) > 0


def test_buckets_of_two_are_told(spark):
    posts = [(k, i) for k, ids in ((1, (5, 9)), (2, (4, 5, 9)), (3, (7,)), (4, (1, 2, 3, 4)), (5, (2, 8))) for i in ids]
    shared, _ = deal(spark.createDataFrame(posts, "key bigint, id bigint"), Scratch(spark, "twos"), twos=True)
    assert {(r["key"], r["id"], r["two"]) for r in shared.collect()} == {(k, i, k in (1, 5)) for k, i in posts if k != 3}


def test_halves_of_cells_bound_more_tightly(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(250)) for _ in range(12)]
    texts = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    both = {r["id"]: r for r in L.parities(texts).join(L.parities(texts, "q", half=True), "id").collect()}
    tighter = 0
    for a in range(len(lines)):
        for b in range(a):
            one, two = [{x[i : i + L.WIDTH] for i in range(len(x) - L.WIDTH + 1)} for x in (lines[a], lines[b])]
            bits = [sum(((f(both[a], j) ^ f(both[b], j)) & (1 << 64) - 1).bit_count() for j in range(L.WORDS)) for f in (lambda r, j: r[f"p{j}"], lambda r, j: r[f"q{j}"], lambda r, j: r[f"p{j}"] ^ r[f"q{j}"])]
            assert bits[0] <= bits[1] + bits[2] <= len(one ^ two)
            tighter += bits[0] < bits[1] + bits[2]
    assert tighter > 40
