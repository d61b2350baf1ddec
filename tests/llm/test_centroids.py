"""Centroid clustering against a plain k-means on integers."""

import hashlib
import math

import numpy as np
import pytest

from spendframe.llm import centroids
from spendframe.llm.common import read
from spendframe.llm.queries import QUERIES
from tests.conftest import SF

SMALL = SF.replace("0.001", "0.01")


def plain(rows, k=40, rounds=5, scale=256):
    """{id: [(cluster, distance, cluster inertia, inertia, centroid hash)]} with every distance computed."""
    kept = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), [math.floor(scale * x) for x in v], i) for i, v in rows))
    vectors = np.array([v for _, v, _ in kept], np.int64)
    now = vectors[:k].copy()
    for step in range(rounds + 1):
        distances = ((vectors[:, None, :] - now[None]) ** 2).sum(axis=2)
        own = distances.argmin(axis=1)
        if step < rounds:
            now = np.array([vectors[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else now[j] for j in range(len(now))])
    near = distances.min(axis=1)
    return {i: (int(c), int(d), int(near[own == c].sum()), int(near.sum()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest())
            for (_, _, i), c, d in zip(kept, own, near)}


def results(df):
    return {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, SMALL])
def test_the_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in read(spark, sf, "embeddings").collect()]
    usable = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    assert results(QUERIES["op11_centroids"](spark, sf)) == plain(usable)


def test_bounds_save_comparisons(spark):
    """Clear groups: after the first rounds nobody has to look at all centroids again."""
    rng = np.random.default_rng(3)
    heart = rng.normal(0, 4, (6, 8))
    rows = [(i, (heart[i % 6] + rng.normal(0, 0.05, 8)).tolist()) for i in range(600)]
    found = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=8, k=6, rounds=5)
    assert results(found) == plain(rows, 6)
    assert sum(r.compared_round < 5 for r in found.collect()) > 500


def test_a_centroid_that_returns_loosens_nothing():
    """Displacement is taken since the last comparison: there and back is no way at all."""
    start = np.array([[0, 0], [100, 0]], np.int64)
    away = start + np.array([[0, 0], [0, 60]])
    back = centroids.Bounds(np.stack([start, away, start]))
    assert back.moved[0].tolist() == [0, 0] and back.moved[1].tolist() == [0, 60]
    ones, zero = np.array([1]), np.array([0])
    assert back.stands(ones, np.array([99 * 99]), zero, zero).all()
    assert not centroids.Bounds(np.stack([start, away])).stands(np.array([45 * 45]), np.array([55 * 55]), zero, zero).any()


def test_rounds_match_full_comparison_on_random_walks():
    rng = np.random.default_rng(7)
    vectors = rng.integers(-300, 300, (400, 5))
    history = [rng.integers(-300, 300, (7, 5))]
    cluster, near, following = centroids._nearest(vectors, history[0])
    since = np.zeros(400, np.int32)
    for _ in range(12):
        history.append(history[-1] + rng.integers(-9, 10, (7, 5)))
        cluster, near, following, since = centroids.Bounds(np.stack(history)).assign(vectors, cluster, near, following, since)
        assert (cluster == centroids.squared(vectors, history[-1]).argmin(axis=1)).all()
    assert 0 < (since < 12).sum() < 400


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (None, [5.0, -5.0]), (9, [1.0, 2.0, 3.0]), (10, [-0.001, 0.003])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, vec int")
    found = centroids.clusters(docs, dims=2, k=3, rounds=2).collect()
    assert sorted((r.vec_id for r in found), key=str) == [1, 10, 2, 2, None]
    assert len({(r.cluster, r.distance) for r in found if r.vec_id in (1, 2)}) == 1  # equal vectors: the smaller number
    assert {r.inertia for r in found} == {sum(r.distance for r in found)}
    assert centroids.clusters(docs.limit(0), dims=2).collect() == []
    assert len(centroids.clusters(docs, dims=2, k=40).collect()) == 5  # fewer vectors than centroids


def test_large_components(spark):
    rows = [(i, [float(x), -float(x)]) for i, x in enumerate((2**25, 2**25 + 3, 5, 9, -(2**26)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert results(centroids.clusters(table, dims=2, k=2, scale=1)) == plain(rows, 2, 5, 1)
    with pytest.raises(Exception, match="do not fit a long"):
        centroids.clusters(table, dims=2, k=2).collect()
