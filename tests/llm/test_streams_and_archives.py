"""URL filters, archives, mixing, sharding, counts, decontamination, toxicity and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import decontaminate, feistel, mixing, toxicity, warc
from papyrine.llm.host_reputation import RULES, judge, page_outcomes
from papyrine.llm.scratch import Scratch
from papyrine.llm.token_rollup import TokenRollup, count_tokens, deletes, inserts, revisions


def test_rules_and_reputation(spark):
    urls = {1: "http://A.example.org/es/x", 2: "http://example.org/en/12?q", 3: "http://xexample.org/es/", 4: "https://h.com/fr/#a", 5: "http://org", 6: None, 7: "no scheme", 8: "x://Y.com/de/a/b#c", 9: "http://bad.net/1", 10: "http://good.net/1", 11: "http://u:p@h.org:80/a"}
    pages = spark.createDataFrame([(k, u, "z") for k, u in urls.items()] + [(100 + i, f"http://bad.net/{i}", "") for i in range(60)] + [(200 + i, f"http://good.net/{i}", "") for i in range(60)], "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)] + [(5, None)], "page_id bigint, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, outcomes, rules=RULES).collect()}
    assert len(got) == 131
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/fr/", "allow")
    assert got[5][:3] == ("org", "", None) and got[6][:3] == ("", "", None) and got[7][:2] == ("", "")
    assert got[8] == ("y.com", "/de/a/b", "com/de/", "block")
    assert got[9][3] == "block" and got[10][3] == "allow"
    assert got[11][:3] == ("u:p@h.org:80", "/a", None)
    assert judge(pages.limit(0), outcomes.limit(0)).isEmpty()


def test_few_labels_block_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.net/1"), (2, "http://b.net/2"), (3, "http://c.net/3")], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (9, None, None)], "doc_id bigint, quality int, toxic int")
    assert {r.verdict for r in judge(pages, page_outcomes(pages, labels)).collect()} == {"allow"}


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://a/\r\nX: y", long), (3, "http://b/", long), (9, None, long), (1, "u", None), (2, "u", "short"), (4, "u", "short"), (7, "u", "x" * 100), (7, "u", "x" * 100), (8, "u", "\0tail\n")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, id string").repartition(3)
    got = {}
    for r in warc.warc_digest(pages).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    assert sum(map(len, got.values())) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == long and i != 3
        assert got[i][0] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
    path = str(tmp_path / "arc")
    warc.write_captures(pages, path)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert all(c.request and c.metadata for c in captures)
    assert {bytes(c.response.content) for c in captures if c.response} == {(h or "").encode() for _, _, h in rows}
    ids = {c.response.record_id for c in captures if c.response}
    assert all(c.revisit.refers_to in ids for c in captures if c.revisit)
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    assert warc.warc_digest(pages.limit(0)).isEmpty()


def fill(sizes, weights, most):
    total, level, held = sum(sizes), 0.0, set()
    while True:
        rest = total - sum(most * sizes[i] for i in held)
        open_ = [i for i in range(len(sizes)) if i not in held]
        if not open_:
            return [most * s for s in sizes]
        level = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in held else level * weights[i] for i in range(len(sizes))]
        held |= set(over)


def test_mixing(spark):
    rng = random.Random(2)
    names = ["b", "a", "Z", "é", "", None]
    shares = [300, 20, 5, 40, 100, 10]
    rows, k = [], 0
    for name, n in zip(names, shares, strict=True):
        for _ in range(n):
            rows.append((k, " ".join(["w"] * rng.randint(0, 30)), name))
            k += 1
    rows += [(k, None, "a"), (None, "x y", "b")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id bigint, text string, source string, size int, draw string")
    got = mixing.mix_digest(docs.repartition(7)).collect()
    assert len(got) == len(rows)
    order = sorted([n for n in names if n is not None]) + [None]
    by = {n: [r for r in rows if r[2] == n] for n in order}
    sizes = [sum(len((t or "").split()) for _, t, _ in by[n]) for n in order]
    targets = dict(zip(order, fill(sizes, [1, 2, 3, 1, 2, 3], 3), strict=True))
    source = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r.taken <= 3 * r.size and abs(r.target - targets[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[n] - targets[n]) <= 16 for n in order)
    again = mixing.mix_digest(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(counts.get(r.doc_id, 0) * r.size == r.taken for r in got)
    assert mixing.mix_digest(docs.limit(0)).isEmpty()


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i % 2 else "y") for i in range(40)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("x", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(docs, weights=weights).select("source").distinct().collect()} == {"x"}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 39, 41, 500])
def test_shards(spark, n):
    rows = [(i, "é" * (i % 4), "s") for i in range(n)]
    docs = spark.createDataFrame([*rows, *([(None, None, "s")] * (n > 3))], "doc_id bigint, text string, shard string").repartition(5)
    got = feistel.shard_digest(docs).collect()
    assert len(got) == docs.count()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
        data = b"" if r.doc_id is None else ("é" * (r.doc_id % 4)).encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    counts = [len(shards.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1
    again = feistel.shard_digest(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 10, 97, 1000):
        got = [r.p for r in spark.range(n).select(feistel.permute(F.col("id"), n, 7).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))


def test_repeated_rows_shard(spark):
    docs = spark.createDataFrame([(1, "a")] * 200, "doc_id bigint, text string").repartition(4)
    got = feistel.shard_digest(docs).collect()
    assert len({(r.shard, r.slot) for r in got}) == 200


def test_rollup(spark):
    counts = spark.createDataFrame([(1, "s", "en", 5), (2, "s", "en", 7), (3, None, None, 1), (4, "t", "en", None)], "doc_id bigint, source string, lang string, n bigint")
    roll = TokenRollup(spark, Scratch(spark, "roll").path("totals"))
    assert roll.totals().isEmpty()
    assert roll.commit("a", inserts(counts, "n", "v1")) and not roll.commit("a", inserts(counts, "n", "v1"))
    one = counts.where("doc_id = 1")
    assert roll.commit("b", revisions(one, "n", "v1", one.withColumn("n", F.lit(50)), "n", "v2"))
    assert roll.commit("c", deletes(counts.where("doc_id = 3"), "n", "v1"))
    assert roll.commit("empty", inserts(counts.limit(0), "n", "v1"))
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in roll.totals().collect()}
    assert got == {("s", "en", "v1"): (1, 7), ("s", "en", "v2"): (1, 50)}


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    import os

    from papyrine.llm import token_rollup as R

    path = f"{R.TOKENIZERS}/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    rng = random.Random(1)
    texts = [None, "", "a", "Héllo  wörld's\n\n 123", " ".join(rng.choices(["the", "théa", "x1", "don't", "\n"], k=60000)), "z" * 200000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("t", pat_str=R.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.v for r in count_tokens(docs, {"v": path}).collect()}
    assert got == {i: len(plain.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(40)] + [None, "", "A b", items_long := " ".join(rng.choices(vocabulary, k=400))]
    docs = []
    for i in range(120):
        filler = rng.choices(vocabulary, k=rng.choice([0, 5, 50, 3000]))
        body = items[i % 40].split()
        if i % 3 == 1 and len(body) > 30:
            body[rng.randrange(len(body))] = "changed"
        if i % 3 == 2 and len(body) > 20:
            body = body[: len(body) // 2] + rng.choices(vocabulary, k=300) + body[len(body) // 2 :]
        at = rng.randint(0, len(filler))
        docs.append(" ".join(filler[:at] + body + filler[at:]).upper())
    docs += [None, "", "a B", items_long + " x y"]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int").repartition(4)
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    from tests.llm.test_near_duplicates import shingle_set

    sets = [shingle_set(t) for t in items]
    want = set()
    for i, t in enumerate(docs):
        own = shingle_set(t)
        for k, s in enumerate(sets):
            if s and 100 * len(s & own) >= 75 * len(s):
                want.add((i, k, len(s & own), len(s)))
    assert {tuple(r) for r in decontaminate.find_leaks(d, b).collect()} == want
    assert {tuple(r) for r in decontaminate.find_leaks(d, b, item_bytes=2000).collect()} == want
    left = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert left == set(range(len(docs))) - {w[0] for w in want}
    assert decontaminate.find_leaks(d.limit(0), b).isEmpty() and decontaminate.find_leaks(d, b.limit(0)).isEmpty()


def test_toxicity_learns(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lin", "mor", "tas")]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(vocabulary, k=rng.randint(5, 60))
        toxic = i % 6 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["slur", "grunt" + rng.choice(["o", "ella", "issimo", "ande"])]))
        rows.append((i, " ".join(text)))
        if i < 600:
            labels.append((i, int(i % 10 != 1), int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge_toxicity(docs, lab).collect()}
    held = range(600, 900)
    right = sum(got[i].toxic == (i % 6 == 0) for i in held)
    assert right >= 0.98 * len(held)
    assert not got[1000].toxic and got[1000].p_toxic == got[1001].p_toxic
    left = {r.doc_id for r in toxicity.without_toxic(docs, lab).collect()}
    assert left == {i for i, r in got.items() if not r.toxic}
    assert toxicity.judge_toxicity(docs.limit(0), lab).isEmpty()
    assert not any(r.toxic for r in toxicity.judge_toxicity(docs, lab.limit(0)).collect())


def test_chain_uses_earlier_category():
    rng = np.random.default_rng(0)
    n = 400
    first = rng.integers(0, 2, n)
    x = toxicity.Rows(first * 2 + rng.integers(0, 2, n), np.arange(n), n, 4)
    labels = np.column_stack([first, first]).astype(float)
    chain = toxicity.fit_chain(x, labels, np.arange(n) % toxicity.FOLDS)
    assert len(chain.models[1].chain) == 1 and chain.models[1].chain[0] > 0


def test_best_cut():
    p, y = np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1.0, 0.0, 0.0])
    assert 0.2 < toxicity.best_cut(p, y) < 0.8
    assert toxicity.best_cut(np.zeros(0), np.zeros(0)) == 0.5


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60)), "en", f"s{i % 3}", 0) for i in range(150)]
    rows[10] = (10, rows[9][1] + " more", "en", "s0", 0)
    item = " ".join(rng.choices(vocabulary, k=30))
    rows[20] = (20, rows[20][1] + " " + item, "en", "s1", 0)
    for i in range(30, 90):
        if i % 2:
            rows[i] = (i, rows[i][1] + " nasty", "en", rows[i][3], 0)
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(30 <= i < 90 and i % 2)) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
    want = set(range(150)) - {i for i in range(30, 90) if i % 2} - {10, 20}
    assert {r.doc_id for r in kept.collect()} == want
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= want and len({(r.shard, r.slot) for r in out}) == len(out)


def test_mixing_tied_rows(spark):
    """Rows that agree in id, size and text share a draw; as many of them are taken as fit."""
    rows = [(None, "a b c", "s")] * 900 + [(i, "w " * 10, "t") for i in range(30)] + [(7, "x y", "u")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix_digest(docs).collect()
    assert len(got) == len(rows)
    for size, target in {(r.source_size, r.target) for r in got}:
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size for r in own)


def test_mix_keeps_every_column(spark):
    rows = [(i, "a b", "s" if i % 3 else "t", f"d{i}", "w", "u", 1, 2, "r", "c", "q") for i in range(30)]
    names = ["doc_id", "text", "source", "draw", "whole", "upto", "shard", "slot", "repetitions", "copy", "size"]
    docs = spark.createDataFrame(rows, names)
    mixed = mixing.mix(docs)
    assert mixed.columns == names and mixed.dtypes == docs.dtypes
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in rows}


def test_warc_null_ids_and_long_payloads(spark):
    same, long = "z" * 200, "ü" * 700_000
    pages = spark.createDataFrame([(None, "u", same), (3, "u", same), (5, "v", same), (None, "u", "y" * 150), (None, "w", "y" * 150), (8, "w", long), (9, "x", long)], "page_id bigint, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_digest(pages).collect())
    assert got == sorted([("None", 200, "revisit", 3), ("3", 200, "response", None), ("5", 200, "revisit", 3), ("None", 150, "response", None), ("None", 150, "response", None), ("8", 1_400_000, "response", None), ("9", 1_400_000, "revisit", 8)])


def test_clean_judges_rows(spark):
    item = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, f"a b {item} c", "k"), (None, "clean words only here now", "k"), (4, f"{item} x", "k"), (4, "other clean words stand here", "k"), (5, None, "k"), (6, "", "k")], "doc_id bigint, text string, item_id string")
    left = [(r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(None, "clean words only here now"), (4, "other clean words stand here"), (5, None), (6, "")]))


def test_near_dedup_rows(spark):
    from papyrine.llm.pipeline import near_dedup

    words = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(words), " ".join(words[:-1] + ["end"]), " ".join(reversed(words))
    rows = [(None, one), (None, one), (3, near), (9, other), (9, "short text of its own here"), (None, "alone is this text of mine"), (None, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = near_dedup(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    again = near_dedup(spark, docs.repartition(2), "")
    kept = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    assert kept == sorted((str(r.doc_id), str(r.text)) for r in again.collect())
    assert ("3", near) in kept and ("None", one) not in kept and ("None", "alone is this text of mine") in kept
    assert sum(k[0] == "9" for k in kept) == 1 and ("5", "None") in kept and ("None", "None") in kept


def test_rollup_refuses_other_deltas(spark):
    counts = spark.createDataFrame([("s", "en", 5)], "source string, lang string, n bigint")
    roll = TokenRollup(spark, Scratch(spark, "roll").path("totals"))
    assert roll.commit("a", inserts(counts, "n", "v1")) and not roll.commit("a", inserts(counts, "n", "v1"))
    with pytest.raises(ValueError):
        roll.commit("a", inserts(counts.withColumn("n", F.lit(6)), "n", "v1"))
    for k in range(4):
        assert roll.commit(f"b{k}", inserts(counts, "n", "v1"))
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "en", "v1", 5, 25)]
    assert roll.committed("b0") and not roll.committed("c")


def test_one_pass_for_several_blocks(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(30))) for i in range(30)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    found = decontaminate.find_leaks(docs, items, item_bytes=2000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_shared_folder_needed_on_clusters(spark, monkeypatch):
    from papyrine.llm import scratch

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch.shared_folder(Session())


class Interrupted(TokenRollup):
    """Lets another writer in just before it publishes for the first time."""

    other = None

    def _publish(self, draft, version):
        meanwhile, self.other = self.other, None
        if meanwhile:
            meanwhile()
        return super()._publish(draft, version)


def test_two_writers(spark):
    counts = spark.createDataFrame([(1, "s", "en", 10)], "doc_id bigint, source string, lang string, n bigint")
    path = Scratch(spark, "roll").path("totals")
    a, b = Interrupted(spark, path), TokenRollup(spark, path)
    a.other = lambda: b.commit("b", inserts(counts, "n", "v1"))
    assert a.commit("a", inserts(counts.withColumn("n", F.lit(7)), "n", "v1"))  # b came first, nothing is lost
    assert [tuple(r) for r in b.totals().collect()] == [("s", "en", "v1", 2, 17)] and a.committed("a") and a.committed("b")
    a.other = lambda: b.commit("c", inserts(counts, "n", "v1"))
    assert not a.commit("c", inserts(counts, "n", "v1"))  # the same batch by two writers counts once
    assert [tuple(r) for r in a.totals().collect()] == [("s", "en", "v1", 3, 27)]
    a.other = lambda: b.commit("d", inserts(counts.withColumn("n", F.lit(1)), "n", "v1"))
    with pytest.raises(ValueError):
        a.commit("d", inserts(counts, "n", "v1"))
    files, root = a._hadoop(path)
    names = sorted(s.getPath().getName() for s in files.listStatus(root))
    assert [n for n in names if n[0] == "v"] == [f"v{k:012d}" for k in range(1, 5)] and len(names) == 8  # no draft is left


def test_old_versions_stay_for_their_time(spark):
    counts = spark.createDataFrame([(1, "s", "en", 10)], "doc_id bigint, source string, lang string, n bigint")
    path = Scratch(spark, "roll").path("totals")
    roll = TokenRollup(spark, path)
    roll.commit("a", inserts(counts, "n", "v1"))
    held = roll.totals()
    for k in range(3):
        roll.commit(f"b{k}", inserts(counts, "n", "v1"))
    assert [tuple(r) for r in held.collect()] == [("s", "en", "v1", 1, 10)]  # a reader of an old version can end
    assert TokenRollup(spark, path, keep_s=0).commit("z", inserts(counts, "n", "v1"))
    assert [n for n, _ in roll._markers()] == [5]
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "en", "v1", 5, 50)]
    assert roll.committed("a")


def test_maintained_totals(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    import os

    from papyrine.llm import token_rollup as R

    if not os.path.exists(f"{R.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"):
        pytest.skip("no vocabulary")
    made = {}
    for n in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(f"{R.TOKENIZERS}/{n}.tiktoken", "rb") as f:
            made[n] = tiktoken.Encoding(n, pat_str=R.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "théâtre", "x1", "\n", "don't"], k=rng.randint(0, 40))) if i % 7 else None, rng.choice(["en", "de", None]), rng.choice(["s", None])) for i in range(60)]
    rows += [(3, rows[3][1], "en", "s"), (None, "some words", "de", "s")]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in range(40)] + [(3, 0, 1), (3, 0, 1), (None, 0, 1)]
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    want = {}
    for i, text, lang, source in rows:
        if i not in toxic:
            n = "byte_bpe_50k" if lang == "en" else "byte_bpe_multi_50k"
            d, t = want.get((source, lang, n), (0, 0))
            want[source, lang, n] = (d + 1, t + len(made[n].encode_ordinary(text or "")))
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, lang string, source string, tokens int")
    got = R.maintain(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in got} == want
    assert R.maintain(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).isEmpty()


def test_repeated_items_and_several_passes(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(6)
    texts = {i: " ".join(rng.choices(words, k=40)) for i in range(40)}
    rows = [*texts.items(), *[(0, texts[0])] * 500, *[(100 + i, texts[1]) for i in range(30)]]
    items = spark.createDataFrame(rows, "item_id bigint, text string").repartition(3)
    docs = spark.createDataFrame([(i, f"before {texts[i]} after") for i in range(0, 40, 3)] + [(900, texts[1]), (901, "nothing of it at all here"), (902, None)], "doc_id bigint, text string")
    want = {(i, i) for i in range(0, 40, 3)} | {(900, 1)} | {(900, 100 + i) for i in range(30)}
    seen = []
    build = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda ids, texts: (seen.append(len(ids)), build(ids, texts))[1])
    for size in (1 << 20, 900):
        seen.clear()
        found = decontaminate.find_leaks(docs, items, item_bytes=size)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
        assert sum(seen) == 70 and (size > 900 or max(seen) <= 20)  # equal items are sent once
        assert sorted(r.doc_id for r in decontaminate.clean(docs, items, item_bytes=size).collect()) == [901, 902]
