"""The secret network is fitted, calibrated and given its threshold on all findings."""

import numpy as np

from papyrine.llm import secret_network as S


def rows(rng, n, letters, secret):
    return [(bytes(rng.choice(np.frombuffer(letters, np.uint8), S.WIDTH)), secret) for _ in range(n)]


def test_all_windows_count(spark, monkeypatch):
    rng = np.random.default_rng(2)
    found = rows(rng, 150, b"0123456789abcdef", True) + rows(rng, 250, b"aeioustrn ", False)
    windows = spark.createDataFrame(found + found[:40], "window binary, secret boolean")
    seen = {}
    fit, count = S.fit_packs, S.counted_scores
    monkeypatch.setattr(S, "fit_packs", lambda packs, share: seen.update(fitted=sum(r.n for r in packs.collect()), packs=packs.count()) or fit(packs, share, batch=4))
    monkeypatch.setattr(S, "counted_scores", lambda held, net: seen.update(held=held.count()) or count(held, net))
    net = S.train(windows, pack=60)
    assert seen["fitted"] + seen["held"] == 400 and seen["packs"] > 2
    again = S.train(windows.repartition(5), pack=60)
    assert (net.weights == again.weights).all() and net.threshold == again.threshold
    p = S.probabilities(net, S.codes_of([w for w, _ in found]))
    taken = p >= net.threshold
    assert taken[:150].mean() > 0.95 and taken[150:].mean() < 0.05


def test_counted_scores_stand_for_repeated_ones():
    score, y, count = np.array([-2.0, -1, 0.5, 1, 3]), np.array([0, 1, 0, 1, 1.0]), np.array([5, 1, 2, 3, 4])
    many = np.repeat(score, count), np.repeat(y, count)
    assert np.allclose(S.calibrate(score, y, count), S.calibrate(*many))
    assert S.recall_threshold(1 / (1 + np.exp(-score)), y, count, recall=0.8) == S.recall_threshold(1 / (1 + np.exp(-many[0])), many[1], recall=0.8)
