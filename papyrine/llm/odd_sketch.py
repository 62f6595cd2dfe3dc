"""MinHash near-duplicates with odd sketches.

1.  Every text gives its shingle set, ``BANDS`` * ``ROWS`` MinHash samples, a key per band, and an odd
    sketch: each (sample number, sample) toggles one bit of a ``BITS``-bit map.  The XOR of two sketches is the
    sketch of the samples that differ, and its population count estimates their number and so the similarity.
2.  Texts with equal sets become one node.  A pair of nodes is a candidate if they share a band's key and
    their sketches and sizes do not exclude the wanted similarity; it is confirmed on full sets.
3.  ``linking`` makes components of the confirmed pairs: about n comparisons for a group of n copies, no
    pair between components left out, no bucket capped.

A pair at the threshold 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6, and passes the sketches
with all but 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm import shingles
from papyrine.llm.components import components
from papyrine.llm.linking import deal, link, similar
from papyrine.llm.runs import GROUP, blocks, runs
from papyrine.llm.scratch import Scratch, kept_by, prepare_python

BANDS, ROWS = 32, 4
#: MinHash samples folded into a sketch (the bands use the first of them), and its bits.
SAMPLES, BITS = 256, 1024
SEED = 11
LANES = BITS // 64
#: Nodes of a bucket that meet each other in one group.
BLOCK = 1024
#: Most differing bits of two sketches.  At a similarity of 0.75 they differ in 113 bits on average with a standard
#: deviation of 15, so 178 are 4.3 deviations more; that many stand for an estimate of 0.575.
SKETCH_LIMIT = 178

SIGNATURE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        *[T.StructField(f"s{i}", T.LongType()) for i in range(LANES)],
    ]
)
SET = T.StructType([T.StructField("id", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the numbered samples, as ``LANES`` 64-bit words."""
    where = shingles.mix(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    parity = (np.bincount(where.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def estimate(differing: int, samples: int = SAMPLES, bits: int = BITS) -> float:
    """Similarity that a count of differing sketch bits stands for."""
    if 2 * differing >= bits:
        return 0.0
    return max(0.0, 1 + bits / (4 * samples) * float(np.log(1 - 2 * differing / bits)))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mul, offset = shingles.permutations(SAMPLES, SEED)
    used = BANDS * ROWS
    weights = shingles.multipliers(used, SEED + 2).reshape(BANDS, ROWS)
    salt = shingles.multipliers(BANDS, SEED + 4)
    for batch in batches:
        m = batch.num_rows
        n, f1, f2 = np.zeros(m, np.int64), np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        bands, sketch = np.zeros((m, BANDS), np.uint64), np.zeros((m, LANES), np.int64)
        for i, s in enumerate(shingles.sets(batch.column("text").to_pylist())):
            n[i] = len(s)
            if len(s):
                f1[i], f2[i] = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles.mix(s + np.uint64(77)))
                low = shingles.minima(s, mul, offset)
                bands[i] = shingles.mix((shingles.mix(low[:used]).reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64) + salt)
                sketch[i] = odd_sketch(low)
        offsets = pa.array(np.arange(0, m * BANDS + 1, BANDS, dtype=np.int32))
        columns = [batch.column("id"), pa.array(n), _long(f1), _long(f2), pa.ListArray.from_arrays(offsets, _long(bands.ravel()))]
        columns += [pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(LANES)]
        yield pa.RecordBatch.from_arrays(columns, names=SIGNATURE.names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = list(shingles.sets(batch.column("text").to_pylist()))
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), _long(values))], names=SET.names)


def _similar_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _close(a: str, b: str) -> Column:
    """The sketches of sides a and b do not exclude the wanted similarity."""
    words = [F.bit_count(F.col(f"s{i}{a}").bitwiseXOR(F.col(f"s{i}{b}"))) for i in range(LANES)]
    return reduce(add, words) <= SKETCH_LIMIT


class _Verifier:
    """Confirms candidates on full sets; a text's set is made once."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch):
        self.texts, self.nodes, self.percent, self.scratch = texts, nodes, percent, scratch
        self.known: DataFrame | None = None

    def _need(self, wanted: DataFrame) -> DataFrame:
        """Sets of at least the wanted ids."""
        if self.known is not None:
            wanted = self.scratch.table(wanted.join(self.known.select("id"), "id", "left_anti"), "wanted")
        if self.known is None or not wanted.isEmpty():
            if self.known is None:
                wanted = self.scratch.table(wanted, "wanted")
            found = kept_by(self.texts, wanted, ["id"]).mapInArrow(_sets, SET)
            found = self.scratch.table(found, "sets")
            self.known = found if self.known is None else self.known.unionByName(found)
        return self.known

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are similar enough, as a written table."""
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        known = self._need(wanted)
        both = pairs.select("a", "b").join(known.toDF("a", "sa"), "a").join(known.toDF("b", "sb"), "b")
        return self.scratch.table(both.where(similar(F.col("sa"), F.col("sb"), F.size("sa") + F.size("sb"), self.percent)).select("a", "b"), "links")

    def rest(self, mixed: DataFrame, label: DataFrame) -> DataFrame:
        """Links between components that meet in a bucket: one for each node and component that are linked.

        First the sketches of a bucket's nodes, in blocks, name (node, component) pairs with a close member;
        then the node meets the component's members in blocks until one is confirmed on full sets.
        Only such pairs and links leave a task, never the candidates.
        """
        percent, lanes = self.percent, [f"s{i}" for i in range(LANES)]
        sides = self.scratch.table(mixed.join(self.nodes, "id"), "sides")
        met = blocks(sides.where("component <> main"), sides, "key", BLOCK)
        group = ["key", *GROUP]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, group):
                asks = t.column("asks").to_numpy()
                k = int(asks.sum())
                if not 0 < k < len(asks):
                    continue
                col = {c: t.column(c).to_numpy() for c in ("id", "component", "main", "n", *lanes)}
                a, b = {c: v[:k] for c, v in col.items()}, {c: v[k:] for c, v in col.items()}
                other = (b["component"] == b["main"])[None, :] | (a["id"][:, None] < b["id"][None, :])
                close = other & (a["component"][:, None] != b["component"][None, :]) & _close_matrix(a, b, percent, lanes)
                x, y = np.nonzero(close)
                if len(x):
                    found = np.unique(np.stack([a["id"][x], b["component"][y]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["id", "component"])

        near_pairs = met.mapInArrow(near, "id bigint, component bigint").distinct()
        near_pairs = self.scratch.table(near_pairs, "near")
        members = label.toDF("id", "component")
        alone = near_pairs.select("component").distinct()
        alone = alone.join(members.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), "component")
        members = members.unionByName(alone).join(near_pairs.select("component").distinct(), "component", "left_semi")
        known = self._need(near_pairs.select("id").unionByName(members.select("id")).distinct())
        full = self.scratch.table(self.nodes.join(known, "id"), "full")
        columns = ["component", "id", "n", *lanes, "set"]
        asking, asked = near_pairs.join(full, "id").select(columns), members.join(full, "id").select(columns)
        met = blocks(asking, asked, "component", BLOCK // 4, (near_pairs, members))
        group2 = ["component", *GROUP]

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, group2):
                asks = t.column("asks").to_numpy()
                k = int(asks.sum())
                if not 0 < k < len(asks):
                    continue
                col = {c: t.column(c).to_numpy() for c in ("id", "n", *lanes)}
                a, b = {c: v[:k] for c, v in col.items()}, {c: v[k:] for c, v in col.items()}
                lists = t.column("set").combine_chunks()
                ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
                ends = ends - ends[0]
                links = []
                for x, row in enumerate(_close_matrix(a, b, percent, lanes)):
                    mine = flat[ends[x] : ends[x + 1]]
                    for y in np.flatnonzero(row):
                        theirs = flat[ends[k + y] : ends[k + y + 1]]
                        both = len(np.intersect1d(mine, theirs, assume_unique=True))
                        if both * 100 >= (len(mine) + len(theirs) - both) * percent:
                            links.append((int(a["id"][x]), int(b["id"][y])))
                            break
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

        return self.scratch.table(met.mapInArrow(confirm, "a bigint, b bigint").where("a <> b").distinct(), "links")


def _close_matrix(a: dict[str, np.ndarray], b: dict[str, np.ndarray], percent: int, lanes: list[str]) -> np.ndarray:
    """Pairs whose sizes and sketches do not exclude the wanted similarity."""
    differing = np.zeros((len(a["id"]), len(b["id"])), np.uint16)
    for s in lanes:
        differing += np.bitwise_count(a[s].view(np.uint64)[:, None] ^ b[s].view(np.uint64)[None, :])
    low, high = np.minimum.outer(a["n"], b["n"]), np.maximum.outer(a["n"], b["n"])
    return (differing <= SKETCH_LIMIT) & (low * 100 >= high * percent)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Linked are rows with 100 * intersection >= percent * union of their shingle sets; a component is named by
    its smallest id, and ``kept`` marks that row.  Texts that are null or without words have empty sets and
    link with nothing.  Rows of one id are one document: they share a component.  A row of null id links
    with nothing, has a null component and is kept.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    scratch = Scratch(spark, "odd")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.table(texts.mapInArrow(_signatures, SIGNATURE), "signatures")
    usable = signed.where("id is not null and n > 0")
    key = ["n", "f1", "f2"]
    groups = scratch.table(usable.groupBy(*key).agg(F.min("id").alias("rep"), F.max("id").alias("last")), "groups")
    reps = groups.select(F.col("rep").alias("id"), *key)
    nodes = scratch.table(usable.join(reps, ["id", *key], "left_semi").dropDuplicates(["id", *key]), "nodes")

    posts = nodes.select("id", F.explode("bands").alias("key"))
    nodes = nodes.select("id", "n", *[f"s{i}" for i in range(LANES)])
    verify = _Verifier(texts, nodes, percent, scratch)
    links, label = link(nodes, lambda a, b: _similar_size(f"n{a}", f"n{b}", percent) & _close(a, b), verify.pairs, scratch, deal(posts, scratch), verify.rest)

    # documents of equal sets follow their node; documents of one id follow each other
    member = usable.join(groups.select(*key, "rep"), key).select("id", "rep").where("id <> rep").distinct()
    repeated = usable.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    member = scratch.table(member.join(label.toDF("rep", "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component")), "members")
    if not repeated.isEmpty():
        everything = links.select("a", "b").unionByName(member.toDF("a", "b"))
        found = components(everything, scratch).toDF("id", "component")
    else:
        own = label.toDF("id", "component")
        found = own.unionByName(member)
    placed = signed.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
    component = F.coalesce("component", "id")
    return placed.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )

