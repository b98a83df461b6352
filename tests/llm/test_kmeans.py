"""Exponion k-means against plain Lloyd rounds in whole numbers."""

import hashlib
import random

import numpy as np
import pytest

from whyframe.llm import kmeans
from whyframe.llm.kmeans import centroid_clusters


def brute(rows, k, rounds, width, scale, salt):
    kept = []
    for i, v in rows:
        if i is None or v is None or len(v) != width or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(float(x) * scale)) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(col) // len(members) for col in zip(*members)]
    found = [(i, nearest(v)) for i, v in kept]
    total = sum(d for _, (d, _) in found)
    by = {}
    for _, (d, j) in found:
        by[j] = by.get(j, 0) + d
    return sorted((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, (d, j) in found)


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.selectExpr("*", "1 AS label", "2 AS cluster", "3 AS block", "4 AS id", "5 AS distance").repartition(3)


def result(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(r) for r in df.collect())


def clouds(rng, n, width, groups=6):
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(groups)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)]) for i in range(n)]


def test_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK", 64)
    rng = random.Random(3)
    rows = clouds(rng, 400, 8)
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # copies
    got = result(centroid_clusters(frame(spark, rows), k=12, rounds=5, width=8, scale=256, salt="2:"))
    assert got == brute(rows, 12, 5, 8, 256, "2:")


def test_ties_go_to_the_smaller_number(spark):
    """A coarse grid: most vectors are as near to several centroids, some centroids are equal, some clusters empty."""
    rng = random.Random(5)
    rows = [(i, [rng.randrange(3) / 2, rng.randrange(3) / 2, 0.0]) for i in range(300)]
    for k in (1, 2, 20):
        assert result(centroid_clusters(frame(spark, rows), k=k, rounds=4, width=3, scale=2, salt="t")) == brute(rows, k, 4, 3, 2, "t")


def test_odd_rows(spark):
    rng = random.Random(7)
    nan, inf = float("nan"), float("inf")
    rows = clouds(rng, 40, 4) + [(100, None), (101, []), (102, [1.0]), (103, [1.0] * 5), (104, [nan, 1.0, 1.0, 1.0]), (105, [inf, 0.0, 0.0, 0.0]), (106, [None, 0.0, 0.0, 0.0]), (None, [0.1] * 4), (3, [0.5] * 4), (3, [0.5] * 4), (-9, [0.0] * 4)]
    assert result(centroid_clusters(frame(spark, rows), k=7, rounds=3, width=4)) == brute(rows, 7, 3, 4, 256, "2:")
    few = rows[:3]
    assert result(centroid_clusters(frame(spark, few), k=40, rounds=2, width=4)) == brute(few, 40, 2, 4, 256, "2:")
    assert result(centroid_clusters(frame(spark, []), width=4)) == [] and result(centroid_clusters(frame(spark, [(1, None)]), width=4)) == []


def test_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-3e5, 3e5) for _ in range(4)]) for i in range(60)]
    assert result(centroid_clusters(frame(spark, rows, "double"), k=5, rounds=3, width=4)) == brute(rows, 5, 3, 4, 256, "2:")
    with pytest.raises(Exception, match="might not fit"):
        centroid_clusters(frame(spark, [(1, [1e30] * 4)], "double"), width=4).collect()


def test_balls_spare_distances():
    """Far clouds: the bounds settle nearly all vectors, and what is looked at lies in a ball."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (50, 16))
    x = centres[rng.integers(0, 50, 5000)] + rng.integers(-100, 100, (5000, 16))
    centroids = centres + rng.integers(-50, 50, (50, 16))
    cluster, upper, lower = kmeans.first_look(x, centroids)
    after = centroids + rng.integers(-500, 500, centroids.shape)
    kmeans.moved(cluster, upper, lower, np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(float)) * kmeans.UP)
    looked = kmeans.exponion(x, cluster, upper, lower, kmeans.Ball.of(after))
    assert (cluster == kmeans.squared(x, after).argmin(axis=1)).all() and looked < 0.2 * 5000 * 50


def test_bounds_stay_true():
    rng = np.random.default_rng(2)
    x, centroids = rng.integers(-40, 40, (2000, 3)), rng.integers(-40, 40, (25, 3))
    cluster, upper, lower = kmeans.first_look(x, centroids)
    for _ in range(6):
        after = centroids + rng.integers(-6, 7, centroids.shape)
        kmeans.moved(cluster, upper, lower, np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(float)) * kmeans.UP)
        centroids = after
        kmeans.exponion(x, cluster, upper, lower, kmeans.Ball.of(centroids))
        d = np.sqrt(kmeans.squared(x, centroids).astype(float))
        assert (cluster == d.argmin(axis=1)).all() and (upper >= d[np.arange(len(x)), cluster] * (1 - 1e-9)).all()
        d[np.arange(len(x)), cluster] = np.inf
        assert (lower <= d.min(axis=1) * (1 + 1e-9)).all()
