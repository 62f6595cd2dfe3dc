"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model also gets the earlier categories'
probabilities.  In training those are out-of-fold predictions, so a later model sees them as honest as they
will be for new texts.  Each model is a logistic regression on the presence of words and word beginnings
(4, 5 and 6 bytes, so inflected forms of a stem are known), hashed to ``1 << FEATURE_BITS`` places; the features
that tell the classes apart best are chosen within each training fold.

The fit uses a bounded sample of labelled rows (``sample_rows``, a documented parameter); all texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm import shingles
from papyrine.llm.scratch import Scratch, prepare_python

FEATURE_BITS = 22
PREFIXES = (4, 5, 6)
FOLDS, FEATURES = 5, 2048
#: Labelled ids that the fit uses at most, and bytes of a text that may be among them.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """Hashed words and word beginnings of each text, repeats kept; words are runs of letters, digits and non-ASCII."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > shingles.CHUNK:
            yield from _features(held)
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield from _features(held)


def _features(texts: list[bytes]) -> Iterator[np.ndarray]:
    codes = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    letter = _LETTER[codes]
    starts = np.flatnonzero(~letter[:-1] & letter[1:]) + 1
    ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    up, down = shingles._powers.upto(len(codes))
    values = shingles._VALUE[codes]
    values *= up
    np.cumsum(values, out=values)
    base, scale, length = values[starts - 1], down[starts], ends - starts
    down_bits = np.uint64(64 - FEATURE_BITS)
    rows = [(shingles.mix((values[ends - 1] - base) * scale + np.uint64(5)) >> down_bits).astype(np.int32)]
    for p in PREFIXES:
        last = np.minimum(starts + p, ends) - 1
        hashed = (shingles.mix((values[last] - base) * scale + np.uint64(1000 + p)) >> down_bits).astype(np.int32)
        rows.append(np.where(length > p, hashed, -1))
    table = np.stack(rows)
    first = np.searchsorted(starts, np.cumsum([1, *[len(t) + 1 for t in texts]]))
    for d in range(len(texts)):
        own = table[:, first[d] : first[d + 1]].ravel()
        yield own[own >= 0]


@dataclass
class Linear:
    """Weights of the chosen features, of the earlier categories' logits, and a bias."""

    index: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Distinct features of rows, laid out one after the other."""

    feature: np.ndarray
    row: np.ndarray
    n: int
    width: int

    def take(self, keep: np.ndarray) -> Rows:
        place = (np.cumsum(keep) - 1).astype(np.int32)
        inside = keep[self.row]
        return Rows(self.feature[inside], place[self.row[inside]], int(keep.sum()), self.width)


def fit_linear(x: Rows, y: np.ndarray, chain: np.ndarray, *, most: int = FEATURES, ridge: float = 0.005, rounds: int = 200) -> Linear:
    """Logistic regression by accelerated gradient steps on the features that part the classes best."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    prior = float(np.clip((pos + 0.5) / (len(y) + 1), 1e-4, 1 - 1e-4))
    n_chain = chain.shape[1]
    if not pos or not neg:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(n_chain), float(np.log(prior / (1 - prior))))
    size = x.width
    a = np.bincount(x.feature[y[x.row] > 0], minlength=size)
    b = np.bincount(x.feature, minlength=size) - a
    score = np.zeros(size)
    seen = np.flatnonzero(a + b >= 3)
    gap = np.log((a[seen] + 0.5) / (pos + 1)) - np.log((b[seen] + 0.5) / (neg + 1))
    score[seen] = np.abs(gap) / np.sqrt(1 / (a[seen] + 0.5) + 1 / (b[seen] + 0.5))
    index = np.sort(np.argsort(-score, kind="stable")[:most])
    index = index[score[index] > 2.0]
    place = np.full(size, -1, np.int32)
    place[index] = np.arange(len(index))
    at = place[x.feature]
    row, col = x.row[at >= 0], at[at >= 0]
    w, c, bias = np.zeros(len(index)), np.zeros(n_chain), float(np.log(prior / (1 - prior)))
    # step sizes by column: a feature's own curvature, times the features that share its rows
    load = np.bincount(row, minlength=x.n).astype(float) + (chain**2).sum(1) + 1
    curve = np.bincount(col, weights=load[row], minlength=len(index)) / 4 / x.n + ridge / x.n * 10
    curve_c = (chain**2 * load[:, None]).sum(0) / 4 / x.n + 1e-3
    curve_b = load.mean() / 4
    vw, vc, vb = w.copy(), c.copy(), bias
    t = 1.0
    for _ in range(rounds):
        z = np.bincount(row, weights=vw[col], minlength=x.n) + chain @ vc + vb
        err = (_sigmoid(z) - y) / x.n
        nw = vw - (np.bincount(col, weights=err[row], minlength=len(index)) + ridge / x.n * 10 * vw) / curve
        nc = vc - (chain.T @ err + 1e-3 * vc) / curve_c
        nb = vb - err.sum() / curve_b
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / nt
        vw, vc, vb = nw + m * (nw - w), nc + m * (nc - c), nb + m * (nb - bias)
        w, c, bias, t = nw, nc, nb, nt
    return Linear(index, w, c, bias)


def predict(model: Linear, x: Rows, chain: np.ndarray) -> np.ndarray:
    """Probabilities of rows."""
    weight = np.zeros(x.width)
    weight[model.index] = model.weights
    return _sigmoid(np.bincount(x.row, weights=weight[x.feature], minlength=x.n) + chain @ model.chain + model.bias)


@dataclass
class Chain:
    """Models in order, and the cut that parts the last category best in out-of-fold predictions."""

    models: list[Linear]
    cut: float


def best_cut(p: np.ndarray, y: np.ndarray, *, cost: float = 3.0, least: float = 0.05, most: float = 0.5) -> float:
    """Probability that maximises hits - cost * false alarms, midway (in logits) to the next lower score."""
    order = np.argsort(-p, kind="stable")
    gain = np.cumsum(np.where(y[order] > 0, 1.0, -cost))
    if not len(p) or gain.max() <= 0:
        return most
    # of equal scores only the last is a place to cut
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.flatnonzero(last)[np.argmax(gain[last])])
    low = p[order][at + 1] if at + 1 < len(p) else least
    middle = _sigmoid((_logit(p[order][at : at + 1]) + _logit(np.array([low]))) / 2)[0]
    return float(np.clip(middle, least, most))


def fit_chain(x: Rows, labels: np.ndarray, folds: np.ndarray) -> Chain:
    """One model per column of ``labels`` (NaN: unknown); earlier categories enter as out-of-fold logits."""
    chain = np.zeros((x.n, 0))
    models, cut = [], 0.5
    for j in range(labels.shape[1]):
        y = labels[:, j]
        known = ~np.isnan(y)
        out = np.zeros(x.n)
        for f in range(FOLDS):
            train = known & (folds != f)
            if train.any() and (folds == f).any():
                m = fit_linear(x.take(train), y[train], chain[train])
                out[folds == f] = predict(m, x.take(folds == f), chain[folds == f])
        if known.any():
            models.append(fit_linear(x.take(known), y[known], chain[known]))
            cut = best_cut(out[known], y[known])
        else:
            models.append(Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(j), -10.0))
        chain = np.column_stack([chain, _logit(out)])
    return Chain(models, cut)


def score_texts(texts: Sequence[str | None], models: list[Linear], tables: list[np.ndarray], used: np.ndarray) -> np.ndarray:
    """(texts, categories) probabilities."""
    out = np.zeros((len(texts), len(models)))
    for r, found in enumerate(features(texts)):
        found = np.unique(found[used[found]])
        logits: list[float] = []
        for j, m in enumerate(models):
            z = float(tables[j][found].sum()) + m.bias + float(np.dot(m.chain, logits[: len(m.chain)]) if len(m.chain) else 0.0)
            out[r, j] = _sigmoid(np.array(z))
            logits.append(float(_logit(out[r, j])))
    return out


def weight_tables(models: list[Linear]) -> tuple[list[np.ndarray], np.ndarray]:
    """Dense weights of each model, and which places any of them uses."""
    tables, used = [], np.zeros(1 << FEATURE_BITS, bool)
    for m in models:
        dense = np.zeros(1 << FEATURE_BITS, np.float32)
        dense[m.index] = m.weights
        used[m.index] = True
        tables.append(dense)
    return tables, used


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Fit the chain on at most ``sample_rows`` labelled ids, chosen by a hash, with texts of ``sample_bytes`` at most.

    ``labels`` has doc_id and a 0/1 column per category; nulls are unknown.  Of repeated labels of an id the
    larger counts, of repeated rows the text of the smallest hash, so the sample is bounded in rows and bytes.
    Without labels, every probability is near 0.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    scratch = Scratch(spark, "toxic")
    order = F.xxhash64(F.lit(17), "doc_id")
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(order, "doc_id").limit(sample_rows)
    chosen = scratch.table(chosen, "sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(f) for f in features(batch.column("text").to_pylist())]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))], names=[*names, "features"])

    # the sample is bounded by sample_rows, so it may be broadcast
    texts = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    sampled = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    one = sampled.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    joined = one.join(F.broadcast(chosen), "doc_id").select("doc_id", *[F.col(c).cast("double").alias(c) for c in categories], "text")
    schema = "doc_id bigint, " + ", ".join(f"`{c}` double" for c in categories) + ", features array<int>"
    table = joined.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(extract, schema).toArrow().sort_by("doc_id")
    lists = table.column("features").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    feature = lists.flatten().to_numpy()
    # features of fewer than three rows are never chosen; the others are numbered closely
    seen = np.bincount(feature, minlength=1 << FEATURE_BITS) >= 3
    number = (np.cumsum(seen) - 1).astype(np.int32)
    common = seen[feature]
    x = Rows(number[feature[common]], np.repeat(np.arange(len(counts), dtype=np.int32), counts)[common], len(counts), int(seen.sum()))
    places = np.flatnonzero(seen)
    del feature, common, lists, seen, number
    y = np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in categories])
    ids = table.column("doc_id").to_numpy().astype(np.uint64)
    del table
    chain = fit_chain(x, y, (shingles.mix(ids + np.uint64(9)) % np.uint64(FOLDS)).astype(np.int64))
    for m in chain.models:
        m.index = places[m.index]
    return chain


def score(docs: DataFrame, models: list[Linear], categories: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>...) for every row of ``docs``; a null or empty text gets the categories' base rates."""
    spark = docs.sparkSession
    prepare_python(spark)
    sent = spark.sparkContext.broadcast(models)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables, used = weight_tables(own)
        for batch in batches:
            p = score_texts(batch.column("text").to_pylist(), own, tables, used)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(p[:, j]) for j in range(len(own))]], names=["id", *[f"p_{c}" for c in categories]])

    schema = "id bigint, " + ", ".join(f"`p_{c}` double" for c in categories)
    scored = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return scored.withColumnRenamed("id", id_col)


CHAIN = ("low_quality", "toxic")


def chain_labels(labels: DataFrame) -> DataFrame:
    """The given labels as chain: low quality first, whose probability helps to tell toxic texts from junk."""
    low: Column = F.lit(1) - F.col("quality")
    return labels.select("doc_id", low.alias("low_quality"), "toxic")


def judge_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic for every document.

    Toxic is p_toxic at or over ``threshold``; without one, the cut found in the out-of-fold predictions.
    """
    chain = train(docs, chain_labels(labels), CHAIN, sample_rows=sample_rows)
    cut = chain.cut if threshold is None else threshold
    return score(docs, chain.models, CHAIN).withColumn("toxic", F.col("p_toxic") >= F.lit(cut))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` whose toxic probability stays below the threshold or cut; columns unchanged, texts not shuffled."""
    spark = docs.sparkSession
    chain = train(docs, chain_labels(labels), CHAIN, sample_rows=sample_rows)
    cut = chain.cut if threshold is None else threshold
    prepare_python(spark)
    sent = spark.sparkContext.broadcast(chain.models)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables, used = weight_tables(own)
        for batch in batches:
            p = score_texts(batch.column(at).to_pylist(), own, tables, used)
            yield batch.filter(pa.array(p[:, -1] < cut))

    return docs.mapInArrow(run, docs.schema)
