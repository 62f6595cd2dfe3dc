"""Choices in rounds against the loops that they stand for."""

import random

import pytest

from papyrine.operators import greedy, topics
from papyrine.operators import vectors as V


def sets_by_hand(sets, least):
    taken, out = set(), {}
    for s in sorted(sets, key=lambda s: (-len(sets[s]), s)):
        rest = sets[s] - taken
        if len(sets[s]) >= least and len(rest) >= least:
            out[s] = rest
            taken |= rest
    return out


@pytest.mark.parametrize(("n", "links", "least", "seed"), [(40, 60, 1, 1), (40, 90, 2, 2), (60, 300, 3, 3), (30, 12, 2, 4)])
def test_disjoint_sets(spark, n, links, least, seed):
    rng = random.Random(seed)
    sets = {i: {i} for i in range(n)}
    for _ in range(links):
        a, b = rng.sample(range(n), 2)
        sets[a].add(b)
        sets[b].add(a)
    frame = spark.createDataFrame([(s, m) for s, ms in sets.items() for m in ms], "set bigint, member bigint")
    got = {}
    for r in greedy.disjoint_sets(frame, least).collect():
        got.setdefault(r.set, set()).add(r.member)
    assert got == sets_by_hand(sets, least)


def test_a_chain_of_sets(spark):
    sets = {i: {i, i + 1} for i in range(12)}
    frame = spark.createDataFrame([(s, m) for s, ms in sets.items() for m in ms], "set bigint, member bigint")
    got = {r.set for r in greedy.disjoint_sets(frame).collect()}
    assert got == set(sets_by_hand(sets, 2)) == {0, 2, 4, 6, 8, 10}
    assert greedy.disjoint_sets(frame.limit(0)).isEmpty()


@pytest.mark.parametrize(("n", "links", "most", "seed"), [(20, 80, 1, 1), (20, 120, 3, 2), (8, 28, 2, 3)])
def test_capped_matching(spark, n, links, most, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))): rng.choice([0.1, 0.5, 0.5, rng.random()]) for _ in range(links)}
    frame = spark.createDataFrame([(a, b, w, "x") for (a, b), w in pairs.items()], "a bigint, b bigint, weight double, kind string")
    used, want = dict.fromkeys(range(n), 0), set()
    for (a, b), _ in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        if used[a] < most and used[b] < most:
            want.add((a, b))
            used[a], used[b] = used[a] + 1, used[b] + 1
    got = greedy.capped_matching(frame, most)
    assert got.columns == frame.columns and {(r.a, r.b) for r in got.collect()} == want
    assert greedy.capped_matching(frame.limit(0), most).isEmpty()


def vectors(spark, rows):
    return V.as_vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))


def cosine(x, y):
    return sum(p * q for p, q in zip(x, y, strict=True)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5


def test_pairs_and_communities(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, i % 2, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(80)]
    odd = [(100, None, [1.0] * 6), (101, 0, [0.0] * 6), (102, 0, None), (103, 0, [1.0] * 5)]
    e = vectors(spark, rows + odd)
    want = {(a, b): cosine(x, y) for a, k, x in rows for b, l, y in rows if k == l and a < b and cosine(x, y) >= 0.8}
    for block in (7, 1024):
        got = {(r.a, r.b): r.cosine for r in V.similar_pairs(e, 0.8, block).collect()}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    near = {i: {i} for i, _, _ in rows}
    for a, b in want:
        near[a].add(b)
        near[b].add(a)
    grouped = {m: s for s, ms in sets_by_hand(near, 2).items() for m in ms}
    outer = V.communities(e, V.similar_pairs(e, 0.8))
    assert {r.vec_id: r.community for r in outer.collect()} == {i: grouped.get(i, i) for i, _, _ in rows + odd}
    inner = {r.vec_id: r.community for r in V.nested_communities(e, outer, 0.9).collect()}
    group = {i: grouped.get(i, i) for i, _, _ in rows}
    vec = {i: x for i, _, x in rows}
    close = {i: {i} for i in vec}
    for a in vec:
        for b in vec:
            if a < b and group[a] == group[b] and cosine(vec[a], vec[b]) >= 0.9:
                close[a].add(b)
                close[b].add(a)
    inside = {m: s for s, ms in sets_by_hand(close, 2).items() for m in ms}
    assert {i: inner[i] for i in vec} == {i: inside.get(i, i) for i in vec}


def test_seeded_clusters(spark):
    import hashlib

    rng = random.Random(6)
    vec = {i: [rng.gauss(0, 1) for _ in range(5)] for i in range(47)}
    got = V.seeded_clusters(vectors(spark, [(i, 0, x) for i, x in vec.items()]), most=6).collect()
    free, want = sorted(vec, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()), []
    for c in range(1, 7):
        if free:
            seed = free[0]
            near = sorted(free[1:], key=lambda i: (1 - cosine(vec[seed], vec[i]), i))[:9]
            want += [(c, m, p) for p, m in enumerate([seed, *near])]
            free = [i for i in free if i not in {seed, *near}]
    assert sorted((r.cluster, r.vec_id, r.place) for r in got) == sorted(want)
    own = [m for c, m, _ in want if c == 2]
    told = [cosine(vec[a], vec[b]) for i, a in enumerate(own) for b in own[i + 1 :]]
    assert abs(next(r.cohesion for r in got if r.cluster == 2) - sum(told) / len(told)) < 1e-9
    lone = V.seeded_clusters(vectors(spark, [(1, 0, [1.0, 2.0])])).collect()
    assert [(r.cluster, r.vec_id, r.cohesion) for r in lone] == [(1, 1, 0.5)]


def test_topics(spark):
    rng = random.Random(9)
    names = [f"t{i}" for i in range(14)]
    kw = {t: rng.sample(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"], rng.randint(1, 5)) for t in names}
    ti = {t: rng.choices(["on", "The", "of", "toxin", "moth"], k=rng.randint(0, 6)) for t in names}
    pa = {t: rng.sample(range(20), rng.randint(1, 8)) for t in names}
    ve = {t: [[rng.gauss(0, 1) for _ in range(3)] for _ in range(rng.randint(0, 2))] for t in names}

    def frame(d, kind):
        return spark.createDataFrame([(t, x) for t, xs in d.items() for x in xs], f"topic string, item {kind}")

    v = frame(ve, "array<double>").withColumnRenamed("item", "v")
    found = topics.topic_similarity(frame({t: [w.upper() for w in ws] for t, ws in kw.items()}, "string"), frame(ti, "string"), frame(pa, "bigint"), v)
    got = {(r.a, r.b): r for r in found.collect()}

    def jaccard(a, b):
        a, b = {x.lower() if isinstance(x, str) else x for x in a}, {x.lower() if isinstance(x, str) else x for x in b}
        return len(a & b) / len(a | b) if a and b else 0.0

    want = {}
    for a in names:
        for b in names:
            if a < b and jaccard(kw[a], kw[b]) > 0:
                near = [cosine(x, y) for x in ve[a] for y in ve[b]]
                want[a, b] = (jaccard(kw[a], kw[b]), 0.4 * jaccard(kw[a], kw[b]) + 0.25 * jaccard(ti[a], ti[b]) + 0.1 * jaccard(pa[a], pa[b]) + 0.25 * (sum(near) / len(near) if near else 0.0))
    assert set(got) == set(want) and all(abs(got[p].similarity - want[p][1]) < 1e-9 for p in want)
    used, merged = set(), set()
    for p, (k, s) in sorted(want.items(), key=lambda x: (-round(0.4 * x[1][1] + 0.6 * x[1][0], 12), x[0])):
        if k >= 0.28 and not used & set(p):
            merged.add(p)
            used |= set(p)
    assert {(r.a, r.b) for r in topics.merged_topics(found).collect()} == merged

