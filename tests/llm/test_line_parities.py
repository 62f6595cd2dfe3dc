"""The parities of lines bound their difference surely, and keep families below the threshold out of verification."""

import random

from papyrine.llm import fuzzy_lines as L
from papyrine.llm.scratch import Scratch


def _shingles(line):
    return {line[i : i + L.WIDTH] for i in range(max(len(line) - L.WIDTH, 0) + 1)}


def _near(rng, line, changes):
    out = list(line)
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice("abcdefghijklmnopé中\U0001f600")
    return "".join(out)


def test_cells_never_differ_in_more_places_than_sets(spark):
    rng = random.Random(3)
    lines = ["", "a", "abcdefgh", "ab" * 200, "x" * 3000, "é中\U0001f600" * 5]
    lines += ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.choice((7, 9, 40, 300, 2500)))) for _ in range(20)]
    lines += [_near(rng, line, 4) for line in lines if line]
    found = L.parities(spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")).collect()
    cells = {r["id"]: [r[f"p{j}"] & (1 << 64) - 1 for j in range(L.WORDS)] for r in found}
    assert len(cells) == len(lines)
    tight = 0
    for a in range(len(lines)):
        for b in range(a):
            one, two = _shingles(lines[a]), _shingles(lines[b])
            repeats = sum(max(len(x) - L.WIDTH, 0) + 1 - len(s) for x, s in ((lines[a], one), (lines[b], two)))
            differ = sum((x ^ y).bit_count() for x, y in zip(cells[a], cells[b], strict=True))
            assert differ - repeats <= len(one ^ two)
            tight += differ * 2 > len(one ^ two)
    assert tight > 300


def test_families_below_the_threshold_are_not_verified(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(250))
    # nine places of eight shingles each: about 0.6 of two lines' shingles are in common
    rows = [(i, _near(rng, base, 4)) for i in range(150)] + [(200 + i, x) for i, x in enumerate([base, base + "!", base])]
    made = {}
    table = Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        made[name] = made.get(name, 0) + (out.count() if name in ("first", "round-1", "between") else 0)
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    found = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sets = {i: _shingles(x.lower().strip()) for i, x in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) * 100 >= 75 * len(sets[a] | sets[b]):
                links += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["doc_id"]: r["keeper_doc"] for r in found} == {i: root(i) for i in sets}
    assert sum(made.values()) < 4 * (links + len(rows))
