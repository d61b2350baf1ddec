"""Centroid clustering (k-means on integer vectors) with ns-bounds.

A vector remembers the round in which it last met every centroid, its distance then to its own centroid and to the next
nearest one. The history of all centroids is kept. By the triangle inequality those distances stay bounds once they are loosened
by the norm of a centroid's total displacement since that round; the displacement is taken from the
history in one step, so a centroid that went away and came back loosens nothing, as summed drifts would. While
the loosened bounds cannot meet, the assignment stands. If they can, the own distance is taken anew, and where that is not enough the
vector is compared with all centroids. Every decision is exact: bounds only ever save work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import dropped, written

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components below this are multiplied as doubles without rounding; a squared distance fits a long below LARGEST.
_EXACT, LARGEST = 1 << 20, 1 << 27
#: The slack that rounding of square roots may take, relative to the numbers compared.
_SLACK = 1e-9


def _integers(dims: int, scale: float):
    """(vec_id, vec) of the usable vectors: `dims` finite components, scaled and floored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sized = np.array(pc.list_value_length(vectors).fill_null(-1)) == dims
            batch = batch.filter(pa.array(sized))
            parts = batch.column(1).flatten().cast(pa.float64())
            values = parts.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            usable = np.isfinite(values).all(axis=1)
            batch, values = batch.filter(pa.array(usable)), np.floor(values[usable] * scale)
            if len(values) and np.abs(values).max() >= LARGEST:
                raise ValueError(f"a component of {LARGEST} or more after scaling: its squared distances do not fit a long")
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(values.astype(np.int32))], ["vec_id", "vec"])

    return run


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids, as longs."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _own(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((vectors - centroids[cluster]) ** 2).sum(axis=1)


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, distance, distance to the next nearest); the smaller number where distances tie."""
    found = squared(vectors, centroids)
    cluster = found.argmin(axis=1)
    rows = np.arange(len(found))
    near = found[rows, cluster]
    found[rows, cluster] = np.iinfo(np.int64).max
    return cluster, near, found.min(axis=1)


class Bounds:
    """Loosens stored distances to one round by the centroids' displacements since each earlier one."""

    def __init__(self, history: np.ndarray):
        self.now, t = history[-1], len(history) - 1
        #: Of each earlier round: how far each centroid is from where it was, and the farthest of all others.
        self.moved = np.sqrt(np.array([[((a - b) ** 2).sum() for a, b in zip(self.now, was)] for was in history[:t]], float).reshape(t, len(self.now)))
        self.others = np.array([[np.delete(m, j).max(initial=0.0) for j in range(len(m))] for m in self.moved]).reshape(self.moved.shape)

    def stands(self, near: np.ndarray, following: np.ndarray, cluster: np.ndarray, since: np.ndarray, exact: bool = False) -> np.ndarray:
        """True where no other centroid can be as near as the own one; `near` holds for this round if `exact`."""
        upper = np.sqrt(near.astype(float)) + (0 if exact else self.moved[since, cluster])
        lower = np.sqrt(following.astype(float)) - self.others[since, cluster]
        return upper + _SLACK * (upper + np.sqrt(following.astype(float)) + 1) < lower

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, near: np.ndarray, following: np.ndarray, since: np.ndarray) -> tuple:
        """The state after this round; vectors whose bounds fail are compared with all centroids."""
        cluster, near, following, since = cluster.copy(), near.copy(), following.copy(), since.copy()
        todo = np.flatnonzero((since < 0) | ~self.stands(near, following, cluster, since))
        known = todo[since[todo] >= 0]
        if len(known):
            fresh = _own(vectors[known], self.now, cluster[known])
            held = known[self.stands(fresh, following[known], cluster[known], since[known], exact=True)]
            todo = np.setdiff1d(todo, held, assume_unique=True)
        if len(todo):
            cluster[todo], near[todo], following[todo] = _nearest(vectors[todo], self.now)
            since[todo] = len(self.moved)
        return cluster, near, following, since


_STATE = "cluster int, was int, near long, following long, since int"


def _round(history: np.ndarray, final: bool):
    """(vec_id, vec, state) after a round; in the final one `near` is the distance to the last centroids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, dims = Bounds(history), history.shape[2]
        for batch in batches:
            n = batch.num_rows
            vectors = batch.column(1).flatten().to_numpy().reshape(n, dims).astype(np.int64)
            if batch.num_columns > 2:
                state = [batch.column(i).to_numpy() for i in (2, 4, 5, 6)]
            else:
                state = [np.full(n, value, kind) for value, kind in ((0, np.int32), (0, np.int64), (0, np.int64), (-1, np.int32))]
            before = np.where(state[3] < 0, -1, state[0]).astype(np.int32)
            if len(bounds.moved) == 0:
                cluster, near, following = _nearest(vectors, bounds.now)
                since = np.zeros(n, np.int32)
            else:
                cluster, near, following, since = bounds.assign(vectors, *state)
            if final:
                near = _own(vectors, bounds.now, cluster)
            columns = [batch.column(0), batch.column(1), *[pa.array(v) for v in (
                cluster.astype(np.int32), before, near.astype(np.int64), following.astype(np.int64), since.astype(np.int32))]]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "cluster", "was", "near", "following", "since"])

    return run


def _seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id, in that order; rows without an id come last."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("vec", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r.vec for r in rows], np.int64)


def _moves(state: DataFrame, dims: int):
    """Per centroid, what the vectors that came and went change in its sum and count: at most k rows."""
    changed = state.filter(F.col("cluster") != F.col("was"))
    both = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))
    signed = changed.select("vec", F.explode(both).alias("m")).filter("m.c >= 0")
    sums = [F.sum(F.get("vec", F.lit(i)).cast("long") * F.col("m.s")).alias(f"d{i}") for i in range(dims)]
    return signed.groupBy("m.c").agg(F.sum(F.col("m.s").cast("long")).alias("n"), *sums).collect()


def clusters(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = CLUSTERS,
             rounds: int = ROUNDS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared_round) of every usable vector.

    Usable are vectors of exactly `dims` components, none null or non-finite; others have no row. Components become
    floor(scale * x). The first centroids are the vectors with the smallest seeded hashes of their ids; each round assigns
    all vectors (ties go to the smaller number), then moves every non-empty centroid to the floored mean. With fewer than k usable
    vectors there are as many centroids as vectors, with none the result is empty. Rows with a null id take part and come last as
    seeds; repeated ids and rows count each. A scaled component of 2^27 or more raises, as a squared distance would not fit a
    long. `compared_round` is the last round in which the vector was compared with all centroids.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    whole = slim.schema["vec_id"]
    plain = T.StructType([T.StructField("vec_id", whole.dataType), T.StructField("vec", T.ArrayType(T.IntegerType()))])
    state, path = written(slim.mapInArrow(_integers(dims, float(scale)), plain), "vectors")
    now = _seeds(state, k, seed)
    history, sums, counts = [now], np.zeros(now.shape, object), np.zeros(len(now), object)
    schema = T.StructType([*plain.fields, *T.StructType.fromDDL(_STATE).fields])
    if len(now):
        for number in range(rounds + 1):
            last = path
            state, path = written(state.mapInArrow(_round(np.stack(history), number == rounds), schema), "round")
            dropped(spark, last)
            if number < rounds:
                for row in _moves(state, dims):
                    sums[row.c] += np.array([row[f"d{i}"] for i in range(dims)], object)
                    counts[row.c] += row.n
                moved = [[int(v // n) for v in s] if n else list(c) for s, n, c in zip(sums, counts, history[-1])]
                history.append(np.array(moved, np.int64))
    else:
        state = spark.createDataFrame([], schema)
    # At most k rows: the sums and names of the clusters.
    own = {r.cluster: r.total for r in state.groupBy("cluster").agg(F.sum(F.col("near").cast("decimal(38,0)")).cast("long").alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    report = spark.createDataFrame([(j, own.get(j, 0), sum(own.values()), name) for j, name in enumerate(names)],
                                   "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(report), "cluster").select(
        "vec_id", "cluster", F.col("near").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256",
        F.col("since").alias("compared_round"))
