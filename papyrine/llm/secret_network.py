"""Secrets in whole texts: three rules, and a character network that judges every other candidate with its context.

The rules give *base* findings.  Candidates are runs of twelve or more of ``[A-Za-z0-9+/_.-]`` that mix letters with digits or
both cases.  A small convolutional network (character vectors, one convolution, largest and mean activations of left context, candidate and right
context, one linear layer) gives each a probability.  It is trained on all labelled findings, distinct windows and whether they are secrets: these are dealt
into packs by hash, each round every pack goes one epoch on from the common weights, and their mean is the next start.  In half of the training steps a window's context is blanked, so that the look of a value counts too.
A quarter of the windows is held out; on all of it scores are calibrated (Platt) and the threshold is set, the highest that still finds
``RECALL`` of the held-out secrets, moved midway to the next lower score of another finding.

Texts are read once.  What is found goes to a scratch table (a row per text, windows of 88 bytes), the network is fitted on
it, and a further pass over that table scores it.  Long candidates are cut into windows that cover them whole;
the largest score counts.

A finding's span is that of the whole match in code points, end exclusive.  Defined cases: a null text is empty and has no finding; rows that
repeat an id, or have none, are judged each; without a labelled secret the network adds nothing; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.scratch import Scratch, prepare_python

#: Kinds in the order that parts equal starts; the last is the network's.
KINDS = ("assign", "access", "hex", "learned")
LEFT, INSIDE, RIGHT = 24, 48, 16
WIDTH = LEFT + INSIDE + RIGHT
LEAST = 12
#: Distinct windows in a pack, about; parts of a score that are told apart when held-out scores are counted; parts of one in sums of weights.
PACK, STEPS, EXACT = 4096, 1024, float(1 << 36)
RECALL = 0.99
#: Bytes of text that are searched at once.
CHUNK = 1 << 22

_NAMES = re.compile(rb"password|passwd|secret|token|api_?key")
_VALUE = re.compile(rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_MIXED = re.compile(rb"[0-9].*?[A-Za-z]|[A-Za-z].*?[0-9]|[a-z][A-Z]")

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.-"]] = True

#: Characters as the network knows them: 0 for none, printable ASCII, one for other controls, one for bytes of other characters.
_CHARS = 98
_CHAR = np.full(256, 96, np.uint8)
_CHAR[32:127] = np.arange(1, 96)
_CHAR[128:] = 97
_CHAR[0] = 0


def rule_spans(data: bytes, runs: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules' findings in bytes; ``runs`` are the maximal candidate runs, which hold access keys and hex."""
    found = []
    last = 0
    for m in _NAMES.finditer(data.lower()):  # lower() of bytes changes A-Z only
        if m.start() >= last and (v := _VALUE.match(data, m.end())):
            last = v.end()
            if len(v[1]) >= 8:
                found.append((0, m.start(), v.end()))
    for a, b in runs:
        if b - a >= 16:
            found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(data, a, b)]
        if b - a >= 32:
            found += [(2, m.start(), m.end()) for m in _HEX.finditer(data, a, b)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def windows(data: bytes, low: int, high: int, start: int, end: int) -> list[bytes]:
    """Windows that cover a candidate of the text ``data[low:high]``: left context, up to 48 bytes of it, right context."""
    out = []
    for a in range(start, end, INSIDE):
        b = min(a + INSIDE, end)
        out.append(data[max(low, a - LEFT) : a].rjust(LEFT, b"\0") + data[a:b].ljust(INSIDE, b"\0") + data[b : min(high, b + RIGHT)].ljust(RIGHT, b"\0"))
    return out


def search(texts: Sequence[bytes]) -> Iterator[tuple[list[dict], list[dict]]]:
    """Base findings and other candidates of each text, spans in code points."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield from _search(held)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield from _search(held)


def _search(texts: list[bytes]) -> Iterator[tuple[list[dict], list[dict]]]:
    data = b"\n".join(texts) + b"\n"  # no pattern crosses a line
    codes = np.frombuffer(data, np.uint8)
    inside = _RUN[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= LEAST
    runs = list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))
    base = rule_spans(data, runs)
    covered = np.zeros(0, np.int64) if not base else np.array([[a, b] for _, a, b in sorted(base, key=lambda s: s[1:])])
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    out: list[tuple[list[dict], list[dict]]] = [([], []) for _ in texts]
    if not base and not runs:
        yield from out
        return
    points = np.concatenate([[0], np.cumsum((codes & 0xC0) != 0x80)])

    def place(position: int) -> int:
        return int(np.searchsorted(bounds, position, "right")) - 1

    def span(d: int, a: int, b: int) -> dict:
        return {"start": int(points[a] - points[bounds[d]]), "end": int(points[b] - points[bounds[d]])}

    hidden = np.maximum.accumulate(covered[:, 1]) if len(covered) else None  # how far any finding reaches that starts so early
    for kind, a, b in base:
        d = place(a)
        out[d][0].append({"kind": kind, **span(d, a, b), "windows": []})
    for a, b in runs:
        if not _MIXED.search(data, a, b):
            continue
        d = place(a)
        tiles = windows(data, int(bounds[d]), int(bounds[d + 1]) - 1, a, b)
        under = hidden is not None and (k := int(np.searchsorted(covered[:, 0], b, "left"))) > 0 and hidden[k - 1] > a
        out[d][1].append({"base": bool(under), **span(d, a, b), "windows": tiles})
    yield from out


SCAN = "id bigint, base array<struct<kind:int,start:bigint,end:bigint>>, candidates array<struct<base:boolean,start:bigint,end:bigint,windows:array<binary>>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, candidates) of every text, read whole."""
    prepare_python(docs.sparkSession)
    spans = [("start", pa.int64()), ("end", pa.int64())]
    kinds = [pa.list_(pa.struct([("kind", pa.int32()), *spans])), pa.list_(pa.struct([("base", pa.bool_()), *spans, ("windows", pa.list_(pa.binary()))]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(search(batch.column("text").to_pylist()))
            columns = [pa.array([f[j] for f in found], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "base", "candidates"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, SCAN)


@dataclass
class Network:
    """Weights of the network, its calibration and its threshold."""

    chars: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0


DEPTH, REACH, FILTERS = 8, 5, 24
_PARTS = ((0, LEFT), (LEFT, LEFT + INSIDE), (LEFT + INSIDE, WIDTH))


def codes_of(found: Sequence[bytes]) -> np.ndarray:
    """Windows as rows of character numbers."""
    return _CHAR[np.frombuffer(b"".join(found), np.uint8)].reshape(len(found), WIDTH)


def _activations(net: Network, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.pad(codes, ((0, 0), (REACH // 2, REACH // 2)))
    near = np.lib.stride_tricks.sliding_window_view(net.chars[padded], REACH, axis=1)  # (n, WIDTH, DEPTH, REACH)
    flat = near.reshape(len(codes), WIDTH, DEPTH * REACH)
    return flat, np.maximum(flat @ net.filters + net.shift, 0)


def _features(active: np.ndarray) -> np.ndarray:
    return np.concatenate([*[active[:, a:b].max(1) for a, b in _PARTS], active[:, LEFT : LEFT + INSIDE].mean(1)], axis=1)


def logits(net: Network, codes: np.ndarray, block: int = 512) -> np.ndarray:
    """Raw scores of windows, before calibration."""
    out = [_features(_activations(net, codes[i : i + block])[1]) @ net.weights + net.bias for i in range(0, len(codes), block)]
    return np.concatenate(out) if out else np.zeros(0)


def probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    return _sigmoid(net.scale * logits(net, codes) + net.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def first_weights(seed: int = 11) -> list[np.ndarray]:
    """Weights to start from, with their first and second moments."""
    rng = np.random.default_rng(seed)
    own = [rng.normal(0, 0.3, (_CHARS, DEPTH)), rng.normal(0, (2 / (DEPTH * REACH)) ** 0.5, (DEPTH * REACH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 4 * FILTERS), np.zeros(1)]
    return own + [np.zeros_like(p) for p in own] * 2


def _network(weights: Sequence[np.ndarray]) -> Network:
    return Network(*weights[:4], float(weights[4][0]))


def epoch(start: Sequence[np.ndarray], codes: np.ndarray, y: np.ndarray, share: tuple[float, float], t: int, rng: np.random.Generator, *, batch: int = 64, rate: float = 0.005, ridge: float = 1e-4) -> list[np.ndarray]:
    """Weights and moments after one pass of gradient descent (Adam) on the cross entropy; ``share`` weighs other findings and secrets, ``t`` counts the steps before."""
    state = [p.copy() for p in start]
    own, first, second = state[:5], state[5:10], state[10:]
    weight = np.where(y > 0, share[1], share[0])
    order = rng.permutation(len(y))
    for i in range(0, len(y), batch):
        at = order[i : i + batch]
        seen = codes[at].copy()
        blank = rng.random(len(at)) < 0.5
        seen[blank, :LEFT] = 0
        seen[blank, LEFT + INSIDE :] = 0
        net = _network(own)
        flat, active = _activations(net, seen)
        z = _features(active)
        err = (_sigmoid(z @ net.weights + net.bias) - y[at]) * weight[at] / len(at)
        back = err[:, None] * net.weights
        grown = np.zeros_like(active)
        rows, cols = np.arange(len(at))[:, None], np.arange(FILTERS)[None, :]
        for j, (a, b) in enumerate(_PARTS):
            grown[rows, a + active[:, a:b].argmax(1), cols] += back[:, j * FILTERS : (j + 1) * FILTERS]
        grown[:, LEFT : LEFT + INSIDE] += back[:, None, 3 * FILTERS :] / INSIDE
        grown *= active > 0
        d_flat = (grown @ net.filters.T).reshape(len(at), WIDTH, DEPTH, REACH)
        padded = np.pad(seen, ((0, 0), (REACH // 2, REACH // 2)))
        d_chars = np.zeros_like(own[0])
        for r in range(REACH):
            np.add.at(d_chars, padded[:, r : r + WIDTH].ravel(), d_flat[..., r].reshape(-1, DEPTH))
        d_chars[0] = 0  # no character stays no character
        gradients = [d_chars, np.tensordot(flat, grown, ([0, 1], [0, 1])), grown.sum((0, 1)), z.T @ err + ridge * net.weights, np.array([err.sum()])]
        t += 1
        for p, g, m, v in zip(own, gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return state


def packs_of(windows: DataFrame, n: int, pack: int = PACK) -> DataFrame:
    """(pack, n, windows, secrets): ``n`` rows (window, secret, draw) dealt by hash into rows of about ``pack`` windows, in order of their draw."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("window", "ascending")])
        y = np.array(table.column("secret").to_pylist(), np.uint8).tobytes()
        return pa.table({"pack": table.column("pack")[:1].cast(pa.int32()), "n": pa.array([len(table)], pa.int32()), "windows": pa.array([b"".join(table.column("window").to_pylist())], pa.binary()), "secrets": pa.array([y], pa.binary())})

    dealt = windows.withColumn("pack", F.pmod(F.xxhash64(F.lit(4), "window"), F.lit(max(1, round(n / pack)))).cast("int"))
    return dealt.groupBy("pack").applyInArrow(one, "pack int, n int, windows binary, secrets binary")


def fit_packs(packs: DataFrame, share: tuple[float, float], *, rounds: int = 10, batch: int = 64, seed: int = 11) -> Network:
    """A network from written packs: in each round their epochs from the same start, averaged by size; the same on every run.

    Only sums come to the driver, a row for each weight; they are of whole numbers, so their order does not count.
    """
    spark = packs.sparkSession
    state, total, most = first_weights(seed), *packs.agg(F.sum("n"), F.max("n")).first()
    shapes = [p.shape for p in state]
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(state)
        done = number * -(-most // batch)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number, done=done) -> Iterator[pa.RecordBatch]:
            for given in batches:
                for row in given.to_pylist():
                    codes = _CHAR[np.frombuffer(row["windows"], np.uint8)].reshape(row["n"], WIDTH)
                    new = epoch(sent.value, codes, np.frombuffer(row["secrets"], np.uint8).astype(float), share, done, np.random.default_rng([seed, number, row["pack"]]), batch=batch)
                    flat = np.concatenate([p.ravel() for p in new])
                    yield pa.RecordBatch.from_arrays([pa.array([np.rint(flat * row["n"] * EXACT).astype(np.int64)], pa.list_(pa.int64()))], names=["sums"])

        sums = packs.mapInArrow(run, "sums array<bigint>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        flat = np.array([float(r.x) for r in sums.orderBy("i").collect()]) / EXACT / total
        ends = np.cumsum([0, *[int(np.prod(x)) for x in shapes]])
        state = [flat[a:b].reshape(x) for a, b, x in zip(ends[:-1], ends[1:], shapes, strict=True)]
        state[10:] = [np.maximum(v, 0) for v in state[10:]]
        sent.destroy()
    return _network(state)


def counted_scores(windows: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, secret, count) of all rows (window, secret), raw scores rounded down to ``STEPS`` parts, so that their number is bounded."""
    sent = windows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.floor(np.clip(logits(sent.value, codes_of(batch.column("window").to_pylist())), -40, 40) * STEPS)
            yield pa.RecordBatch.from_arrays([pa.array(score.astype(np.int32)), batch.column("secret")], names=["score", "secret"])

    rows = windows.select("window", "secret").mapInArrow(run, "score int, secret int").groupBy("score", "secret").count().orderBy("score", "secret").collect()
    return np.array([r.score / STEPS for r in rows]), np.array([r.secret for r in rows], float), np.array([r["count"] for r in rows], float)


def calibrate(score: np.ndarray, y: np.ndarray, count: np.ndarray | None = None, *, rounds: int = 50) -> tuple[float, float]:
    """Scale and offset of a logistic curve through held-out scores, each so often as ``count`` says, by Newton steps on smoothed targets."""
    count = np.ones(len(y)) if count is None else count
    pos, neg = (count * y).sum(), (count * (1 - y)).sum()
    if not pos or not neg:
        return 1.0, 0.0
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([score, np.ones_like(score)])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        gradient = x.T @ (count * (p - goal)) + 1e-3 * (w - [1.0, 0.0])
        curve = (x * (count * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, gradient), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def recall_threshold(p: np.ndarray, y: np.ndarray, count: np.ndarray | None = None, *, recall: float = RECALL) -> float:
    """The highest threshold that still finds ``recall`` of the secrets, midway (in logits) to the next lower score of the others."""
    count = np.ones(len(y)) if count is None else count
    order = np.argsort(-p, kind="stable")
    order = order[y[order] > 0]
    if not len(order):
        return 1.0
    found = np.cumsum(count[order])
    high = p[order][np.searchsorted(found, np.ceil(recall * found[-1]))]
    lower = p[(y == 0) & (p < high)]
    low = lower.max() if len(lower) else 1e-3
    a, b = np.log(np.clip([high, low], 1e-9, 1 - 1e-9)) - np.log1p(-np.clip([high, low], 1e-9, 1 - 1e-9))
    return float(min(high, _sigmoid(np.array((a + b) / 2))))


def train(windows: DataFrame, *, pack: int = PACK) -> Network | None:
    """A network from labelled findings (window binary, secret boolean); None if either class is empty.

    All distinct windows are used; one with both labels is a secret.  A quarter, chosen by hash, is held out for calibration and threshold,
    unless either part would lack a class.
    """
    prepare_python(windows.sparkSession)
    scratch = Scratch(windows.sparkSession, "network")
    once = windows.groupBy("window").agg(F.max(F.col("secret").cast("int")).alias("secret")).withColumn("draw", F.xxhash64(F.lit(3), "window"))
    once = scratch.table(once.withColumn("held", F.col("draw") % 4 == 0), "windows")
    n = {(r.held, r.secret): r["count"] for r in once.groupBy("held", "secret").count().collect()}
    if not all(any((held, s) in n for held in (True, False)) for s in (0, 1)):
        scratch.drop(once)
        return None
    apart = len(n) == 4  # else too few to hold any out
    other, secrets = (n.get((False, s), 0) + (0 if apart else n.get((True, s), 0)) for s in (0, 1))
    packs = scratch.table(packs_of(once.where("not held") if apart else once, other + secrets, pack), "packs")
    net = fit_packs(packs, ((other + secrets) / 2 / other, (other + secrets) / 2 / secrets))
    score, y, count = counted_scores(once.where("held") if apart else once, net)
    scratch.drop(once, packs)
    net.scale, net.offset = calibrate(score, y, count)
    net.threshold = recall_threshold(_sigmoid(net.scale * score + net.offset), y, count)
    return net


def labelled(scanned: DataFrame) -> DataFrame:
    """(window, secret): candidates under a base finding are secrets, the others are not."""
    one = scanned.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c"))
    return one.select(F.explode("c.windows").alias("window"), F.col("c.base").alias("secret"))


def find_secrets(scanned: DataFrame, net: Network | None) -> DataFrame:
    """(id, findings): base findings and candidates beside them that the network takes, by start and then kind.

    A finding has kind, start, end and p; p is null for base findings, which stay whatever the network says.
    """
    prepare_python(scanned.sparkSession)
    schema = "id bigint, findings array<struct<kind:string,start:bigint,end:bigint,p:double>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    sent = scanned.sparkSession.sparkContext.broadcast(net)  # some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out = [[{"kind": KINDS[f["kind"]], "start": f["start"], "end": f["end"], "p": None} for f in row] for row in batch.column("base").to_pylist()]
            if own is not None:
                open_ = [(d, c) for d, row in enumerate(batch.column("candidates").to_pylist()) for c in row if not c["base"]]
                for i in range(0, len(open_), 1000):
                    part = open_[i : i + 1000]
                    p = probabilities(own, codes_of([w for _, c in part for w in c["windows"]]))
                    ends = np.cumsum([0, *[len(c["windows"]) for _, c in part]])
                    for (d, c), q in zip(part, np.maximum.reduceat(p, ends[:-1]), strict=True):
                        if q >= own.threshold:
                            out[d].append({"kind": KINDS[-1], "start": c["start"], "end": c["end"], "p": float(q)})
            for row in out:
                row.sort(key=lambda f: (f["start"], KINDS.index(f["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], names=["id", "findings"])

    return scanned.mapInArrow(run, schema)


def _listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: for every row of ``docs``."""
    scanned = Scratch(docs.sparkSession, "secrets").table(scan(docs), "scanned")
    net = train(labelled(scanned))
    base = F.filter("findings", lambda f: f["kind"] != KINDS[-1])

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return find_secrets(scanned, net).select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:-1]], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))
