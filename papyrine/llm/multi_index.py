"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has its own codebook, fitted by k-means on a
bounded sample, and every vector lies in the cell (i, j) of its nearest codewords.  Around a query, cells are
visited by the multi-sequence algorithm: in order of the sum of two sorted lists, one per half.  The list
values are squared lower bounds of the distance from the query's half to the codeword's region (the distance
to the bisecting plane towards the nearest codeword), so when the next cell's sum passes the squared
distance that belongs to the wanted cosine, no later cell can hold a link: the traversal reaches a recall of
1, not only the wanted 0.9, and the pairs in visited cells are verified in double precision.

Cells of any size are cut into blocks of bounded rows, and a query block meets each vector block once, so a hot
cell is spread over many tasks; what leaves a task is one count per query and a spanning forest of links.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.components import components
from papyrine.llm.scratch import Scratch, prepare_python

#: Vectors that may be used to fit codebooks; vectors of a label that a cell should hold; most codewords of a half.
SAMPLE, PER_CELL, MOST_CODEWORDS = 4096, 256, 64
#: Vectors of one cell in a block.
BLOCK = 1024
#: Slack on the squared distance, for rounding.
EPS = 1e-6


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of distinct points."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = _squares(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def region_bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and squared lower bounds of its distance to every codeword's region."""
    d = _squares(x, c)
    near = d.argmin(axis=1)
    apart = np.sqrt(_squares(c, c))[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart > 0, (d - d[np.arange(len(x)), near][:, None]) / (2 * apart), 0)
    return near, np.maximum(plane, 0) ** 2


def multi_sequence(left: np.ndarray, right: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells in order of left[i] + right[j], until the sum passes ``limit``."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; scaled by the largest entry first, against overflow."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def block_links(q: np.ndarray, x: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean matrix of the pairs with cosine or more.

    Sums of products in another order differ in the last bits; pairs that near to the threshold are summed exactly.
    """
    sims = q @ x.T
    linked = sims >= cosine
    for i, j in zip(*np.nonzero(np.abs(sims - cosine) < 1e-12), strict=True):
        linked[i, j] = float((q[i].astype(np.longdouble) * x[j]).sum()) >= cosine
    return linked


def forest(linked: np.ndarray, qid: np.ndarray, xid: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of a block's bipartite graph: every linked node with the smallest node it reaches here."""
    high = np.iinfo(np.int64).max
    lq, lx = np.where(linked.any(1), qid, high), np.where(linked.any(0), xid, high)
    while True:
        nq = np.minimum(lq, np.where(linked, lx[None, :], high).min(axis=1, initial=high))
        nx = np.minimum(lx, np.where(linked, nq[:, None], high).min(axis=0, initial=high))
        if (nq == lq).all() and (nx == lx).all():
            break
        lq, lx = nq, nx
    pairs = {(int(a), int(b)) for a, b in zip(qid, lq, strict=True) if b < a} | {(int(a), int(b)) for a, b in zip(xid, lx, strict=True) if b < a}
    return sorted(pairs)


def near_duplicate_vectors(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    codewords: int | None = None,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    ``codewords`` of each half make codewords^2 cells; by default as many as give cells of about
    ``PER_CELL`` vectors of a label.  Only vectors of one label that is not null are compared.  Vectors that are null, empty, zero or hold
    a null or non-finite component link with nothing, as do rows of null id.  Vectors of different
    length are compared within their length.  Equal vectors are links of each other.  Rows of one id
    are counted as rows, and share a component.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    prepare_python(spark)
    scratch = Scratch(spark, "imi")
    vector = F.col(vector_col).cast("array<double>")
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    usable = usable.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one value
    key = ["label", "v"]
    # equal vectors are one node with a weight; only the hash of a vector and its id are grouped
    hashed = usable.withColumn("h", F.sha2(F.to_json(F.struct("label", "v")), 256))
    groups = scratch.table(hashed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")), "groups")
    reps = groups.withColumnRenamed("rep", "id")
    nodes = hashed.join(reps, ["h", "id"]).dropDuplicates(["h"]).select("id", "h", "weight", *key, F.size("v").alias("width"))
    nodes = scratch.table(nodes, "nodes")

    parts = []
    for width in sorted(r[0] for r in nodes.select("width").distinct().collect()):  # one row per vector length
        own = nodes.where(F.col("width") == width)
        picked = own.orderBy(F.xxhash64("id")).limit(sample).select("id", "v").collect()  # bounded by ``sample``
        points = unit(np.array([r["v"] for r in sorted(picked, key=lambda r: r["id"])]))
        half = max(1, width // 2)
        if codewords is None:
            n, labels = own.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
            k = min(MOST_CODEWORDS, max(4, round((n / PER_CELL / max(labels, 1)) ** 0.5)))
        else:
            k = codewords
        books = [kmeans(points[:, :half], k, 1), kmeans(points[:, half:] if width > 1 else points[:, :0], k, 2)]
        parts.append(_links(own, width, half, books, cosine, block, scratch))
    if not parts:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("direct"))
    counts = nodes.select("h", "id", "weight").join(counts, "id", "left")
    counts = counts.select("h", F.col("id").alias("rep"), (F.coalesce("direct", F.lit(0)) + F.col("weight") - 1).alias("links"))
    members = hashed.select("id", "h").join(counts, "h")
    edges = found.where("kind = 1").select("a", "b").unionByName(members.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    placed = components(edges, scratch).toDF("id", "component")
    links = scratch.table(members.groupBy("id").agg(F.max("links").alias("links")), "counts")
    out = base.select("id").join(links, "id", "left").join(placed, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _links(nodes: DataFrame, width: int, half: int, books: list[np.ndarray], cosine: float, block: int, scratch: Scratch) -> DataFrame:
    """Rows (kind, a, b): kind 0 = node a has b links to other nodes, weights counted; kind 1 = a and b are linked."""
    limit = 2 - 2 * cosine + EPS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("v"), width))
            i, left = region_bounds(x[:, :half], books[0])
            j, right = region_bounds(x[:, half:], books[1])
            k = len(books[1])
            probes = [[a * k + b for a, b in multi_sequence(left[r], right[r], limit)] for r in range(len(x))]
            values = pa.array(x.ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), values)
            columns = [batch.column("id"), batch.column("weight"), batch.column("label"), vectors, pa.array(i * k + j), pa.array(probes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "weight", "label", "v", "cell", "probes"])

    label = nodes.schema["label"].dataType
    placed_schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("weight", T.LongType()),
            T.StructField("label", label),
            T.StructField("v", T.ArrayType(T.DoubleType())),
            T.StructField("cell", T.LongType()),
            T.StructField("probes", T.ArrayType(T.LongType())),
        ]
    )
    placed = scratch.table(nodes.select("id", "weight", "label", "v").mapInArrow(place, placed_schema), "placed")
    # how many blocks a cell has, and how many a cell's queries have
    homes = placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("xs"))
    visits = placed.select("id", "label", F.explode("probes").alias("cell"))
    asked = visits.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("qs"))
    cells = scratch.table(homes.join(asked, ["label", "cell"]), "cells")
    own = placed.select("id", "weight", "v", "label", "cell").join(cells, ["label", "cell"])
    own = own.withColumn("xb", F.pmod(F.xxhash64("id"), "xs")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qs") - 1)))
    query = placed.select("id", "weight", "v", "label", F.explode("probes").alias("cell")).join(cells, ["label", "cell"])
    query = query.withColumn("qb", F.pmod(F.xxhash64("id"), "qs")).withColumn("xb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("xs") - 1)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, a, b = [], [], []
        if left.num_rows and right.num_rows:
            qid, xid = left.column("id").to_numpy(), right.column("id").to_numpy()
            x, weight = _matrix(right.column("v").combine_chunks(), width), right.column("weight").to_numpy()
            q = _matrix(left.column("v").combine_chunks(), width)
            for at in range(0, len(q), block):
                ids = qid[at : at + block]
                linked = block_links(q[at : at + block], x, cosine) & (ids[:, None] != xid[None, :])
                n = linked @ weight
                for r in np.flatnonzero(n):
                    kind.append(0), a.append(int(ids[r])), b.append(int(n[r]))
                for r, c in forest(linked, ids, xid):
                    kind.append(1), a.append(r), b.append(c)
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by = ["label", "cell", "qb", "xb"]
    cols = [*by, "id", "weight", "v"]
    asking, asked = query.select(*cols).toDF(*cols), own.select(*cols).toDF(*cols)
    met = asking.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(compare, "kind int, a bigint, b bigint")
    return scratch.table(met, "links")
