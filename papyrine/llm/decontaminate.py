"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set: partition j holds sizes in (2^(j-1), 2^j].  A
document's shingles, in order of place, are cut into blocks of 2^j, and every two neighbouring blocks make a
window, so a passage copied from an item of partition j lies whole in one window, whose set is at most
four times as large as the item.  That bounds the Jaccard similarity of item and window from below for
a given containment, however long the document is.  Windows and items are compared by ``SAMPLES`` MinHash
samples: one equal sample makes a candidate.  A window that holds half of an item misses all samples with
probability under (1 - 1/9)^96 = 1e-5; one that holds 3/4 with (1 - 1/6)^96 = 3e-8.
Candidates are verified by exact containment of the item's shingles in the whole document's.

Block minima of one level come from the level below, so all partitions together cost about as much as one.
Items are sent to the executors in blocks of bounded bytes, ``PASS_BLOCKS`` of them for each pass over the
documents, which stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm import shingles
from papyrine.llm.scratch import Scratch, prepare_python

SAMPLES = 96
SEED = 31
LEAST = 3
FILTER_BITS = 20
#: Bytes of item texts that are indexed and sent at once.
ITEM_BYTES = 8 << 20
#: Blocks of items that one pass over the documents looks for; a worker holds their indexes.
PASS_BLOCKS = 8
#: Shingles of a document whose samples are computed together.
SPAN = 1 << 14
PAIR = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint"


def partition_of(n: int) -> int:
    """Number of the size partition of an item of ``n`` shingles."""
    return max(LEAST, (n - 1).bit_length())


@dataclass
class Level:
    """Sketches of one size partition: keys of samples, sorted, with the items that have them."""

    keys: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    """Items of one block, by size partition."""

    ids: list[int]
    sets: list[np.ndarray]
    levels: dict[int, Level]
    seen: np.ndarray


def _keys(low: np.ndarray) -> np.ndarray:
    """Samples (rows of ``SAMPLES``) as keys that also tell which sample it is."""
    return shingles.mix(low.astype(np.uint64) + (np.arange(1, low.shape[-1] + 1, dtype=np.uint64) << np.uint64(32)))


def build_index(ids: list[int], texts: list[str | None]) -> Index:
    """Index of a block of items; items without words are left out."""
    mul, add = shingles.permutations(SAMPLES, SEED)
    kept = [(i, s) for i, s in zip(ids, shingles.sets(texts), strict=True) if len(s)]
    parts: dict[int, list[tuple[np.ndarray, int]]] = {}
    seen = np.zeros(1 << FILTER_BITS, bool)
    for k, (_, s) in enumerate(kept):
        keys = _keys(shingles.minima(s, mul, add).astype(np.uint32)[None, :])[0]
        seen[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        parts.setdefault(partition_of(len(s)), []).append((keys, k))
    levels = {}
    for j, found in parts.items():
        keys = np.concatenate([x for x, _ in found])
        items = np.repeat([k for _, k in found], SAMPLES)
        order = np.argsort(keys, kind="stable")
        levels[j] = Level(keys[order], items[order])
    return Index([i for i, _ in kept], [s for _, s in kept], levels, seen)


def _block_minima(seq: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """(blocks, SAMPLES) minima over blocks of 2^LEAST shingles; the last block may be shorter."""
    width = 1 << LEAST
    short = (seq >> np.uint64(32)).astype(np.uint32)
    missing = -len(short) % width
    if missing:
        short = np.concatenate([short, np.repeat(short[-1:], missing)])
    grid = np.ascontiguousarray(short.reshape(-1, width).T)
    out = []
    for at in range(0, grid.shape[1], SPAN >> LEAST):
        part = grid[:, at : at + (SPAN >> LEAST)]
        low = np.multiply.outer(mul, part[0]) + add[:, None]
        for row in part[1:]:
            value = np.multiply.outer(mul, row)
            value += add[:, None]
            np.minimum(low, value, out=low)
        out.append(low.T)
    return np.concatenate(out)


def candidates(blocks: np.ndarray, index: Index) -> np.ndarray:
    """Items that share a sample with a window of the document of these block minima, as places in the index."""
    level = LEAST
    found = []
    for j in range(LEAST, max(index.levels) + 1):
        while level < j:
            even, odd = blocks[0::2], blocks[1::2]
            joined = even.copy()
            np.minimum(joined[: len(odd)], odd, out=joined[: len(odd)])
            blocks, level = joined, level + 1
        if j not in index.levels:
            continue
        windows = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
        for at in range(0, len(windows), 2048):
            keys = _keys(windows[at : at + 2048]).ravel()
            keys = keys[index.seen[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
            if len(keys):
                own = index.levels[j]
                keys = np.unique(keys)
                a, b = np.searchsorted(own.keys, keys, "left"), np.searchsorted(own.keys, keys, "right")
                found += [own.items[x:y] for x, y in zip(a[b > a], b[b > a], strict=True)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _shared(item: np.ndarray, doc: np.ndarray) -> int:
    at = np.searchsorted(doc, item)
    at[at == len(doc)] = 0
    return int((doc[at] == item).sum())


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 75,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item): documents that hold ``percent`` or more of an item's shingles.

    Items of fewer than five words are one shingle, found in documents that are that sequence.  Null and
    empty texts, on either side, are in no pair; neither are rows of null id.  Rows that repeat an id
    each give their own pairs; equal pairs are given once.
    """
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    texts = texts.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "leaks")
    found = docs.sparkSession.createDataFrame([], PAIR)
    for sent, last in _passes(items, item_col, item_text_col, item_bytes):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            indexes = [b.value for b in sent]
            for batch in batches:
                out: list[tuple[int, int, int, int]] = []
                ids = batch.column("id").to_pylist()
                for doc, seq in zip(ids, shingles.sequences(batch.column("text").to_pylist()), strict=True):
                    out += [(doc, *hit) for hit in _hits(seq, indexes, percent)]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shared", "n_item"])

        part = texts.mapInArrow(search, PAIR)
        found = found.unionByName(part if last else _done(scratch, part, sent))
    return found.distinct()


def _done(scratch: Scratch, part: DataFrame, sent: list[Broadcast]) -> DataFrame:
    """A pass written, and its indexes taken from driver and executors."""
    part = scratch.table(part, "pass")
    for b in sent:
        b.destroy()
    return part


def _passes(items: DataFrame, item_col: str, item_text_col: str, item_bytes: int) -> Iterator[tuple[list[Broadcast], bool]]:
    """For each pass over the documents the broadcast indexes of its items, in blocks of about ``item_bytes``, and whether it is the last.

    Equal items are sent once, so that a block is bounded however often an item is repeated.  A pass's indexes are built when it is
    asked for; whoever asks for the next has written what the last one found.
    """
    spark = items.sparkSession
    prepare_python(spark)
    known = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    known = known.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).alias("t")).distinct()
    known = Scratch(spark, "items").table(known, "items")
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // item_bytes))
    for start in range(0, blocks, PASS_BLOCKS):
        sent = []
        for block in range(start, min(blocks, start + PASS_BLOCKS)):
            rows = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()  # bounded by item_bytes
            index = build_index([r["i"] for r in rows], [r["t"] for r in rows])
            if index.levels:
                sent.append(spark.sparkContext.broadcast(index))
        if sent:
            yield sent, start + PASS_BLOCKS >= blocks


def _hits(seq: np.ndarray, indexes: list[Index], percent: int) -> Iterator[tuple[int, int, int]]:
    """(item id, shared, size) of the items that a document's shingles hold."""
    if not len(seq):
        return
    mul, add = shingles.permutations(SAMPLES, SEED)
    blocks, whole = _block_minima(seq, mul, add), None
    for index in indexes:
        near = candidates(blocks, index)
        if len(near) and whole is None:
            whole = np.unique(seq)
        for k in near:
            n, size = _shared(index.sets[k], whole), len(index.sets[k])
            if n * 100 >= size * percent:
                yield index.ids[k], n, size


def clean(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 75,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Rows of ``docs`` that hold no item, columns unchanged; each row is judged by its own text, whatever its id.

    Rows whose text is null or empty stay.  The rows are filtered where they are read; nothing is shuffled.  A benchmark of more than
    ``PASS_BLOCKS * item_bytes`` takes several passes, between which the rows are written.
    """
    at = docs.columns.index(text_col)
    scratch = Scratch(docs.sparkSession, "clean")
    for sent, last in _passes(items, item_col, item_text_col, item_bytes):

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            indexes = [b.value for b in sent]
            for batch in batches:
                found = [next(_hits(seq, indexes, percent), None) is None for seq in shingles.sequences(batch.column(at).to_pylist())]
                yield batch.filter(pa.array(found, pa.bool_()))

        kept = docs.mapInArrow(keep, docs.schema)
        docs = kept if last else _done(scratch, kept, sent)
    return docs
