"""Odd sketches, fuzzy lines and the multi-index against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import multi_index, odd_sketch, shingles
from papyrine.llm.components import components
from papyrine.llm.fuzzy_lines import dedup_lines, keep_lines
from papyrine.llm.scratch import Scratch

SPACE = " \t\n\r\x0b\x0c"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(text):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def closure(nodes, links):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(40)]
    base = rng.choices(vocabulary, k=100)
    for k in range(60):  # near copies of one text, at distances around the threshold
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    return texts + [texts[0].upper(), texts[1], "", "  ", "one", "ONE", "one two", None, "É é"]


def test_shingles_match_plain_python():
    texts = corpus() + ["a\x1cb c d e f", "x" * 5000, " ".join("abcdefg" * 400)]
    hashed = list(shingles.sets(texts))
    plain = [shingle_set(t) for t in texts]
    assert [len(h) for h in hashed] == [len(p) for p in plain]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(plain[i] & plain[j])


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    mul, add = shingles.permutations(odd_sketch.SAMPLES, 11)
    for share in (0.6, 0.75, 0.9):
        errors = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            same = int(1000 * share)
            rest = (1000 - same) // 2
            a, b = pool[: same + rest], np.concatenate([pool[:same], pool[same + rest :]])
            s = [odd_sketch.odd_sketch(shingles.minima(np.sort(x), mul, add)).view(np.uint64) for x in (a, b)]
            errors.append(odd_sketch.estimate(int(np.bitwise_count(s[0] ^ s[1]).sum())) - share)
        assert abs(np.mean(errors)) < 0.03


def test_near_duplicates(spark):
    texts = corpus()
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string").repartition(5)
    got = {r.doc_id: r for r in odd_sketch.near_duplicates(docs).collect()}
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = closure(range(len(texts)), links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_near_duplicates_edges(spark):
    schema = "doc_id bigint, text string"
    assert odd_sketch.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "Q R S T U V"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")]
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (None, None, True)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 45), (60, 60), (None, 3), (7, None)]
    df = spark.createDataFrame(chain, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 45: 40, 50: 40, 60: 60}
    assert components(df.limit(0), Scratch(spark, "test")).isEmpty()


def lines_by_hand(rows):
    found = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            line = line.strip(SPACE).lower()
            if line:
                found.setdefault(line, []).append((d, i))
    keys = list(found)
    sets = [{k[i : i + 8] for i in range(max(1, len(k) - 7))} for k in keys]
    links = [(i, j) for i in range(len(keys)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    best = closure(range(len(keys)), links)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(best[i], []).extend(found[k])
    return {x: min(g) for g in groups.values() for x in g}


def test_fuzzy_lines(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghij kl", k=rng.randint(5, 120))) for _ in range(25)]
    rows = []
    for d in range(40):
        picked = [list(rng.choice(base)) for _ in range(4)]
        for p in picked:
            if rng.random() < 0.5 and len(p) > 20:
                p[rng.randrange(len(p))] = rng.choice("xyzé")
        rows.append((d, "\n".join("".join(p) for p in picked)))
    rows += [(40, None), (41, ""), (42, " \n\t\nABC\nabc "), (43, "x" * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, line string")
    got = {(r.doc_id, r.line_no): (r.keeper_doc, r.keeper_line) for r in dedup_lines(df).collect()}
    assert got == lines_by_hand(rows)
    assert dedup_lines(df.limit(0)).isEmpty()
    kept = {r.doc_id: r.text for r in keep_lines(df).collect()}
    assert len(kept) == len(rows) and kept[40] is None and kept[42] == " \n\t\nABC"


def test_fuzzy_lines_stay_native(spark):
    df = spark.createDataFrame([(1, "a line of text\nanother line of text")], "doc_id bigint, text string")
    plan = dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 20, 120)] + rng.normal(scale=0.06, size=(120, 16))
    vectors = [list(map(float, v)) for v in np.concatenate([base, near])]
    labels = [int(x) for x in rng.integers(0, 3, len(vectors))]
    rows = [(i, v, lab) for i, (v, lab) in enumerate(zip(vectors, labels, strict=True))]
    rows += [(200, vectors[0], labels[0]), (201, [2 * x for x in vectors[0]], labels[0]), (202, vectors[0], None), (203, [0.0] * 16, 1), (204, None, 1), (205, [float("nan")] * 16, 1), (206, [None] * 16, 1), (207, [1.0, 0.0], 1), (208, [1.0, 0.0], 1), (209, [1e308] * 16, 1), (210, [1e308] * 16, 1), (None, vectors[0], labels[0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicate_vectors(df, block=8, codewords=4).collect()}
    links = []
    good = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    for a, (i, v, lab) in enumerate(good):
        for j, w, other in good[:a]:
            if lab == other and len(v) == len(w):
                x, y = v / np.abs(v).max(), w / np.abs(w).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((i, j))
    best = closure([r[0] for r in rows if r[0] is not None], links)
    degree = {i: sum(i in x for x in links) for i in best}
    assert {i: got[i] for i in best} == {i: (degree[i], best[i], best[i] == i) for i in best}
    assert got[None] == (0, None, True) and len(links) > 50
    assert multi_index.near_duplicate_vectors(df.limit(0)).isEmpty()


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(2)
    left, right = rng.random(7), rng.random(5)
    cells = list(multi_index.multi_sequence(left, right, 0.9))
    sums = [left[i] + right[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells)
    assert len(cells) == int((left[:, None] + right[None, :] <= 0.9).sum())


@pytest.mark.parametrize("column", ["text"])
def test_no_local_checkpoint(spark, column):
    df = odd_sketch.near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))
    assert "LocalCheckpoint" not in df._jdf.queryExecution().toString() and df.select(F.max(column if column in df.columns else "doc_id")).count() == 1
