"""Exact k-means on integer vectors with Hamerly bounds.

Every vector keeps its centroid, an upper bound of the distance to it and one lower bound of the distance to any other.
After each move of the centroids both bounds are loosened by the drift, so most vectors keep their centroid without a
distance; the rest first tighten the upper bound and then, if still in doubt, compare all centroids in exact integers.  Bounds
are rounded outwards, so they never decide a tie.  Centroid sums change only by the vectors that moved.

The state is a table that each round reads once and writes once, without a shuffle; the vector lies beside its bounds, so ids
may repeat.  A round that moves nothing leaves all centroids as they are, and so would every later one: the loop ends there.
Only sums by centroid and component meet on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.scratch import Scratch, prepare_python

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Largest magnitude of an integer component: squared distances of 64 of them stay below 2^63.
MOST = 1 << 27
#: Up to this magnitude products and their sums are whole numbers that a double holds, so a matrix product of doubles is exact.
DOUBLE = 1 << 22
#: Relative slack of the bounds, far above the rounding of a few double operations.
SLACK = 1e-12

STATE = "id bigint, v array<int>, cluster int, upper double, lower double, left_cluster int"
SCHEMA = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("left_cluster", pa.int32())])


def integers(vector: Column, *, components: int = COMPONENTS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where a component is missing, null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.when(F.abs(scale * x.cast("double")) < MOST, F.floor(scale * x.cast("double")).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {MOST}: squared distances would not fit a long"))))
    return F.when(vector.isNotNull() & (F.size(vector) == components) & ~bad, whole)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, (vectors, centroids)."""
    kind = np.float64 if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= DOUBLE else np.int64
    x, c = v.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def assign(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (of equals the smallest number), and both bounds, from all distances."""
    d = distances(v, centroids)
    rows = np.arange(len(v))
    near = d.argmin(1)
    upper = _roots(d[rows, near]) * (1 + SLACK)
    rest = d.astype(np.float64)
    rest[rows, near] = np.inf
    return near.astype(np.int32), upper, np.sqrt(rest.min(1)) * (1 - SLACK)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid went, rounded up."""
    return _roots(((new - old) ** 2).sum(1)) * (1 + SLACK)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the way to the nearest other centroid, rounded down."""
    d = distances(centroids, centroids).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(1)) / 2 * (1 - SLACK)


def step(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment and bounds after the centroids drifted, and how many vectors compared all centroids."""
    most = np.argmax(drift)
    others = np.where(cluster == most, np.delete(drift, most).max(initial=0.0), drift[most])  # what the other centroids drifted at most
    upper = (upper + drift[cluster]) * (1 + SLACK)
    lower = np.maximum(lower - others, 0.0) * (1 - SLACK)
    safe = np.maximum(lower, gaps[cluster])
    doubt = np.flatnonzero(upper >= safe)
    if len(doubt):
        own = ((v[doubt] - centroids[cluster[doubt]]) ** 2).sum(1)
        upper[doubt] = _roots(own) * (1 + SLACK)
        doubt = doubt[upper[doubt] >= safe[doubt]]
    if len(doubt):
        cluster = cluster.copy()
        cluster[doubt], upper[doubt], lower[doubt] = assign(v[doubt], centroids)
    return cluster, upper, lower, len(doubt)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _sums(rows: DataFrame, gains: bool, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of components and numbers of vectors by centroid, as Python integers; ``gains`` counts those that left negatively."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            v = np.column_stack([_vectors(batch), np.ones(batch.num_rows, np.int64)])
            now, was = _column(batch, "cluster"), _column(batch, "left_cluster")
            for j in range(k):
                total[j] += v[now == j].sum(0)
                if gains:
                    total[j] -= v[was == j].sum(0)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], names=["place", "total"])

    parts = rows.select("cluster", "left_cluster", "v").mapInArrow(run, "place int, total bigint")
    out = np.zeros(k * (width + 1), object)
    for r in parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():  # one row for each component at most
        out[r.place] = int(r.total)
    out = out.reshape(k, width + 1)
    return out[:, :-1], out[:, -1]


def seeds(vectors: DataFrame, *, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; of equal ids the smaller vector first, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("v", order.alias("o")).orderBy(F.col("o").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, watch: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector with ``components`` finite components.

    Null, shorter, longer, or partly null or non-finite vectors have no row; repeated ids have a row each, a null id is kept. With fewer
    than ``k`` vectors each is a centroid.  A component whose integer reaches 2^27 raises, as its distances might not
    fit the result's type.  ``watch`` gets a job's number of vectors that moved, round by round.
    """
    spark = vectors.sparkSession
    prepare_python(spark)
    scratch = Scratch(spark, "hamerly")
    given = vectors.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector_col), components=components, scale=scale).alias("v")).where("v is not null")
    given = scratch.table(given, "vectors")
    centroids = seeds(given, k=k, seed=seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], f"{id_col} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")

    def first(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, upper, lower = assign(_vectors(batch), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near), pa.array(upper), pa.array(lower), pa.nulls(len(near), pa.int32())], schema=SCHEMA)

    state = scratch.table(given.mapInArrow(first, STATE), "state")
    scratch.drop(given)
    total, number = _sums(state, False, components, k)
    for _ in range(rounds):
        new = np.array([[int(s) // int(number[j]) for s in total[j]] if number[j] else centroids[j] for j in range(k)], np.int64)  # // is floor
        drift, gaps = drifts(centroids, new), half_gaps(new)
        centroids = new
        if not drift.any():
            break

        def again(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = new, drift: np.ndarray = drift, gaps: np.ndarray = gaps) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                was = _column(batch, "cluster")
                near, upper, lower, _ = step(_vectors(batch), was, _column(batch, "upper"), _column(batch, "lower"), centroids, drift, gaps)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near), pa.array(upper), pa.array(lower), pa.array(was, mask=was == near)], schema=SCHEMA)

        old, state = state, scratch.table(state.mapInArrow(again, STATE), "state")
        scratch.drop(old)
        gained, more = _sums(state.where("left_cluster is not null"), True, components, k)
        total, number = total + gained, number + more
        if watch is not None:
            watch.append(state.where("left_cluster is not null").count())

    def last(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ((_vectors(batch) - centroids[_column(batch, "cluster")]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(own)], names=["id", "cluster", "distance"])

    final = scratch.table(state.select("id", "v", "cluster").mapInArrow(last, "id bigint, cluster int, distance bigint"), "distances")
    scratch.drop(state)
    own = {r.cluster: int(r.inertia) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}  # k rows
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = F.array(*[F.lit(Decimal(own.get(j, 0))).cast("bigint") for j in range(k)])
    return final.select(
        F.col("id").alias(id_col), "cluster", "distance", F.get(per, F.col("cluster")).alias("cluster_inertia"), F.lit(Decimal(sum(own.values()))).cast("bigint").alias("inertia"), F.get(F.array(*[F.lit(n) for n in named]), F.col("cluster")).alias("centroid_sha256")
    )

