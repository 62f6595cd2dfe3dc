"""Queries that must see the whole table, against brute force on small made-up tables."""

import datetime
import random
import re
from collections import Counter, defaultdict

from papyrine.plans.registry import queries


def test_degree_capped_pairs_of_all_vectors(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")

    def cosine(x, y):
        return sum(p * q for p, q in zip(x, y, strict=True)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5

    pairs = [(cosine(x, y), a, b) for a, k, x in rows for b, l, y in rows if k == l and a < b]
    used: dict[int, int] = {}
    want = []
    for c, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if c >= 0.15 and used.get(a, 0) < 3 and used.get(b, 0) < 3:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.append((a, b, round(c, 9)))
    found = queries()["rk27_degree_capped_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b, round(r.cosine, 9)) for r in found) == sorted(want)
    assert {r.a % 5 for r in found} == set(range(5))


def test_merged_phases_of_all_years(spark, tmp_path):
    ids = range(400)
    spark.createDataFrame([(i, "a b", "en", "s", 3) for i in ids], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    years = [1990 + i % 35 for i in ids if i % 11]
    lo = min(years)
    width = 5 if max(years) - lo >= 15 else 3
    parts = [p for k in range(9) if (p := sorted(y for y in years if (y - lo) // width == k))]
    want: list[list[int]] = []
    for p in parts:
        if want and len(want[-1]) < 60:
            want[-1] += p
        else:
            want.append(p)
    if len(want) > 1 and len(want[-1]) < 60:
        tail = want.pop()
        want[-1] += tail
    found = queries()["tm1b_merged_phases"](spark, str(tmp_path)).collect()
    assert sorted((r.phase, r.first_year, r.last_year, r.n) for r in found) == [(i, p[0], p[-1], len(p)) for i, p in enumerate(want)]
    assert len(want) > 1 and sum(r.n for r in found) == len(years)


LOREM = ["Alphabetic", "alphabetic", "Bravissimo", "contrasts", "dénouement", "elephants", "short", "with", "gratitude", "harmonica"]


def _documents(spark, path, n=60):
    """Texts of four languages and of none, some over 2,000 characters; returns the rows."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        text = ". ".join(" ".join(rng.choices(LOREM, k=12)) for _ in range(40 if i % 7 == 0 else 3)) + f" onlyword{chr(97 + i % 26)}{chr(97 + i // 26)}."
        rows.append((i + (70_000 if i % 5 == 0 else 0), text, ("en", "de", "fr", "es", None)[i % 5], f"s{i % 3}", len(text)))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return rows


def test_inverted_index_of_all_words(spark, tmp_path):
    want = defaultdict(set)
    for i, text, *_ in _documents(spark, tmp_path):
        for w in re.findall("[a-z]{8,}", text.lower()):
            want[w, i // 65_536].add(i)
    found = queries()["ag17_inverted_index"](spark, str(tmp_path)).collect()
    assert {(r.word, r.block): (r.postings, r.docs) for r in found} == {k: (len(v), ",".join(map(str, sorted(v)))) for k, v in want.items()}
    assert len(found) == len(want)


def test_words_of_sources_of_whole_texts(spark, tmp_path):
    topics = defaultdict(set)
    for _, text, _, source, _ in _documents(spark, tmp_path):
        topics[source] |= set(re.findall("[a-z]{5,}", text.lower()))
    want = {(a, b): round(len(topics[a] & topics[b]) / len(topics[a] | topics[b]), 6) for a in topics for b in topics if a < b}
    assert {(r.a, r.b): r.jaccard for r in queries()["gr4c_source_words"](spark, str(tmp_path)).collect()} == want


def test_table_bodies_of_all_orders(spark, tmp_path):
    rng = random.Random(5)
    rows = [(o, 10 * o + n, 1, n, rng.choice("NAR")) for o in range(1, 30) for n in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = []
    for o in range(1, 30):
        flags = "".join(r[4] for r in rows if r[0] == o)
        want += [(o, m.start(), m.end() - 1, m.end() - m.start()) for m in re.finditer("[AR]+", flags)]
    found = queries()["cp18_table_bodies"](spark, str(tmp_path)).collect()
    assert sorted((r.doc, r.first_line, r.last_line, r["rows"]) for r in found) == sorted(want)


def test_method_shift_of_all_customers(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([5, 57, 311, 420, 999, 1203]), rng.choice("ab"), datetime.datetime(rng.choice([1996, 1999]), 1, 1)) for _ in range(14)]
    rows.append((1349, "a", datetime.datetime(2000, 1, 1)))
    spark.createDataFrame(rows, "o_custkey bigint, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for p in "ab":
        old, new = ({c % 50 for c, q, d in rows if q == p and (d.year < 1998) == early} for early in (True, False))
        want[p] = (len(new - old), len(new & old))
    found = queries()["tm7_method_shift"](spark, str(tmp_path)).collect()
    assert {r.o_orderpriority: (r.added, r.stable) for r in found} == want


def _top(counts, n):
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


def test_texts_of_all_languages(spark, tmp_path):
    docs = _documents(spark, tmp_path)
    low = {i: text.lower() for i, text, *_ in docs}

    def rows(name, *cols):
        return sorted(tuple(r[c] for c in cols) for r in queries()[name](spark, str(tmp_path)).collect())

    def windows(text):
        return [text[k : k + 1200] for k in range(0, max(1, len(text) - 150), 1050)]

    assert rows("tx3_sliding_windows", "doc_id", "chunk", "chunk_text") == sorted((i, k, w) for i, text, *_ in docs for k, w in enumerate(windows(text)))

    sentences = [(i, k, x.strip(" ")) for i, text, *_ in docs for k, x in enumerate(re.split(r"(?<=[.!?])[ \n\t]+", text))]
    assert rows("tx11_flat_chunks", "doc_id", "place", "chunk", "chunk_id") == sorted((i, k, x[:1200], f"doc:{i}:{k:04d}") for i, k, x in sentences if len(x) >= 15)

    spelt: dict = {}
    for i, text, *_ in docs:
        for w in re.findall("[A-Za-z]+", text):
            spelt.setdefault((i, w.lower()), w)
    assert rows("set2_first_spelling", "doc_id", "word") == sorted((i, w) for (i, _), w in spelt.items())

    n = Counter(w for t in low.values() for w in re.findall("[a-z]{4,}", t) if w not in ("that", "with", "this", "from"))
    assert rows("ag32_keyword_top", "word", "n") == sorted(_top(n, 30))

    pairs = Counter(f"{a} {b}" for t in low.values() for w in [re.findall("[a-z]{3,}", t)] for a, b in zip(w, w[1:], strict=False))
    assert rows("ag33_bigrams", "bigram", "n") == sorted(_top(pairs, 20))

    by = defaultdict(Counter)
    for i, _, _, source, _ in docs:
        by[source].update(re.findall("[a-z]{5,}", low[i]))
    assert rows("fn32_topic_name", "source", "topic") == sorted((s, " / ".join(w for w, _ in _top(c, 3))) for s, c in by.items())

    facets = []
    for i, t in low.items():
        scores = {s: round(min(1.0, 0.08 * w * t.count(s)), 6) for s, w in (("that", 1.0), ("with", 2.0), ("from", 1.0))}
        facets += [(i, s, x, r) for r, (s, x) in enumerate(_top({s: x for s, x in scores.items() if x > 0.02}, 2), 1)]
    assert rows("rk25_facet_classification", "doc_id", "signal", "score", "r") == sorted(facets)

    first: dict = {}
    for i in sorted(low):
        category = next((c for c, s in (("a", "ononst"), ("b", "thatin"), ("c", "rewh")) if s in low[i]), "other")
        first.setdefault((category, low[i][:60]), i)
    kept = defaultdict(list)
    for (category, _), i in first.items():
        kept[category].append(i)
    assert rows("rk34_categorised_extract", "category", "doc_id") == sorted((c, i) for c, ids in kept.items() for i in sorted(ids)[:4])


def test_embedding_records_of_whole_texts(spark, tmp_path):
    docs = [(1, "x", "en", "a", 1), (2, "", "de", "a", 0), (3, "".join(random.Random(1).choices("abc ", k=5000)), "fr", "b", 5000), (4, "y" * 900, None, "b", 900)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = [("metadata", i, 0, " ".join(x for x in (lang, source) if x)) for i, _, lang, source, _ in docs]
    want += [("summary", i, 0, text) for i, text, *_ in docs if text]
    want += [("text", i, k, text[s : s + 1600]) for i, text, *_ in docs if text for k, s in enumerate(range(0, max(1, len(text) - 180), 1420))]
    found = queries()["cp12_embedding_records"](spark, str(tmp_path)).collect()
    assert sorted((r.level, r.doc_id, r.chunk, r.record) for r in found) == sorted(want)
