"""Greedy choices that need few rounds and no table of all pairs."""

import random

import pytest

from papyrine.operators import greedy
from papyrine.operators import vectors as V


def test_overlapping_sets_take_few_rounds(spark, monkeypatch):
    """A chain of sets decided one after the other: one round for each set, if only what is best everywhere is taken."""
    sets = {i: {i, i + 1} for i in range(60)}
    frame = spark.createDataFrame([(s, m) for s, ms in sets.items() for m in ms], "set bigint, member bigint")
    names = []
    monkeypatch.setattr(greedy, "written", lambda df, name, own=greedy.written: names.append(name) or own(df, name))
    assert {r.set for r in greedy.disjoint_sets(frame).collect()} == set(range(0, 60, 2))
    assert len(names) <= 10


@pytest.mark.parametrize(("sets", "members"), [(1, 10), (3, 10), (4096, 1)])
def test_batches_of_any_size_give_the_same(spark, monkeypatch, sets, members):
    rng = random.Random(5)
    own = {i: {i, *rng.sample(range(25), rng.randint(1, 6))} for i in range(25)}
    frame = spark.createDataFrame([(s, m) for s, ms in own.items() for m in ms], "set bigint, member bigint")
    taken, want = set(), set()
    for s in sorted(own, key=lambda s: (-len(own[s]), s)):
        rest = own[s] - taken
        if len(own[s]) >= 2 and len(rest) >= 2:
            want |= {(s, m) for m in rest}
            taken |= rest
    monkeypatch.setattr(greedy, "BATCH_SETS", sets)
    monkeypatch.setattr(greedy, "BATCH_MEMBERS", members)
    assert {(r.set, r.member) for r in greedy.disjoint_sets(frame).collect()} == want


@pytest.mark.parametrize("listed", [1, 4])
def test_capped_lists_are_those_of_all_pairs(spark, listed):
    rng = random.Random(7)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    rows += [(100 + i, 0, rows[0][2]) for i in range(6)] + [(200, None, rows[1][2]), (201, 1, [0.0, 0.0, 0.0])]
    vectors = V.as_vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))
    want = {(r.label, r.a, r.b): r.cosine for r in V.degree_capped(V.similar_pairs(vectors, 0.15), 2).collect()}
    got = {(r.label, r.a, r.b): r.cosine for r in V.degree_capped_vectors(vectors, 0.15, 2, listed=listed).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # no more rows than lists have places, whatever the blocks
    lists = V.best_lists(vectors, -1.0, 3, rows=8).groupBy("end").count().collect()
    assert {r["count"] for r in lists} == {3}
