"""Centroid clustering: k-means over whole numbers with exponion search.

Components become integers (floor of ``scale`` times the component), so every
distance, sum and mean is exact and the result doesn't depend on how rows are
dealt out. A vector keeps an upper bound of the distance to its own centroid and
a lower bound of the distance to any other. Only where these don't settle that
its centroid is still the nearest, the centroids inside a ball around its own
one are looked at: radius twice the upper bound plus the distance from the
centroid to its nearest neighbour, taken from sorted lists of the distances
between centroids. The radius is inclusive and a bound settles nothing unless it
is strictly smaller, so ties always meet and go to the smaller number.

Vectors lie in packed blocks, bucketed by block and written once. A round joins
them with the blocks' state (cluster and bounds, 17 bytes a vector) without a
shuffle and writes the next state, together with sums and counts of each block.
Centroids, ``k`` rows of ``width`` numbers, are all that reaches the driver.

Defined results: vectors that are null, of another length than ``width`` or with
null or non-finite components are left out, as are rows with a null id. Of fewer
than ``k`` vectors each is a centroid at first. Rows that repeat an id each
count; among starts of one id the smaller vector comes first. An empty cluster
keeps its centroid. Without any vector the result is empty. Scaled components so
large that a squared distance might not fit a long (2**27 at 64 components) are
an error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, new_path, stage, stage_bucketed, unstage

#: Up to this, products and sums of 64 components are whole numbers that doubles hold exactly.
EXACT_IN_DOUBLES = 1 << 22
BLOCK = 4096
UP, DOWN = 1 + 1e-12, 1 - 1e-12


@dataclass
class Ball:
    """Centroids with their mutual distances: lists by distance from each, and half the way to the nearest other."""

    centroids: np.ndarray
    order: np.ndarray
    sorted: np.ndarray
    nearest: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Ball:
        distances = np.sqrt(squared(centroids, centroids).astype(np.float64))
        order = np.argsort(distances, axis=1, kind="stable")
        ranked = np.take_along_axis(distances, order, axis=1) * DOWN
        np.fill_diagonal(distances, np.inf)
        return cls(centroids, order, ranked, distances.min(axis=1))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y, as longs."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    kind = np.float64 if peak <= EXACT_IN_DOUBLES // max(1, int(np.sqrt(x.shape[1] / 16))) else np.int64
    x, y = x.astype(kind), y.astype(kind)
    if kind is np.float64:
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in y], axis=1) if len(y) else np.zeros((len(x), 0), np.int64)


def own_squared(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    gap = x - centroids[cluster]
    return (gap * gap).sum(axis=1)


def first_look(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bound) from the distances to all centroids."""
    d = squared(x, centroids)
    cluster = d.argmin(axis=1)  # the first of equal ones: the smaller number
    best = d[np.arange(len(x)), cluster]
    d[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(x), np.inf)
    return cluster, np.sqrt(best.astype(np.float64)) * UP, second * DOWN


def exponion(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, ball: Ball) -> int:
    """Bring cluster and bounds up to date in place; the number of distances looked at."""
    half = ball.nearest / 2 * DOWN
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
    upper[open_] = np.sqrt(own_squared(x[open_], ball.centroids, cluster[open_]).astype(np.float64)) * UP
    open_ = open_[upper[open_] >= np.maximum(lower[open_], half[cluster[open_]])]
    looked = 0
    for own in np.unique(cluster[open_]).tolist():
        rows = open_[cluster[open_] == own]
        radius = (2 * upper[rows] + ball.nearest[own]) * UP
        within = np.searchsorted(ball.sorted[own], radius, side="right")
        todo, room = np.argsort(within, kind="stable"), 1
        at, sizes = 0, np.sort(within)
        while at < len(todo):  # rings of doubling size, so that a vector meets at most twice the centroids of its ball
            room *= 2
            end = int(np.searchsorted(sizes, room, side="right"))
            part = rows[todo[at:end]]
            if len(part):
                near = np.sort(ball.order[own, :room])
                cluster[part], upper[part], lower[part] = _nearest(x[part], ball.centroids, near)
                looked += len(part) * len(near)
            at = end
    return looked


def _nearest(x, centroids, near):
    found, up, low = first_look(x, centroids[near])
    return near[found], up, low


def moved(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, way: np.ndarray) -> None:
    """Loosen the bounds after every centroid has gone its way."""
    upper += way[cluster] * UP
    upper *= UP
    order = np.argsort(-way)
    farthest = np.full(len(way), way[order[0]])
    farthest[order[0]] = way[order[1]] if len(way) > 1 else 0.0
    lower -= farthest[cluster] * UP
    lower -= np.abs(lower) * 1e-12


def whole_numbers(vec: str, scale: int) -> F.Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def kept_vectors(vectors: DataFrame, width: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, ints) of the vectors that take part."""
    df = vectors.select(as_id(id_col).alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    df = df.where(F.coalesce(F.col("id").isNotNull() & (F.size("vec") == width) & finite, F.lit(False)))
    most = math.isqrt((1 << 62) // (4 * width)) - 1
    large = F.exists("vec", lambda x: F.abs(x * F.lit(float(scale))) > F.lit(float(most)))
    refused = F.raise_error(F.lit(f"a component beyond {most} / {scale}: squared distances might not fit a long"))
    return df.select("id", F.when(large, refused.cast("array<long>")).otherwise(whole_numbers("vec", scale)).alias("ints"))


def starts(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``salt`` and id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return np.array([r.ints for r in kept.orderBy(key, "ints").limit(k).collect()], dtype=np.int64)  # k rows


def _blocks(width: int):
    """Rows to packed blocks of at most ``BLOCK``, named by the number of their first row."""

    def packed(row, ids, x):
        kind = "<i2" if int(np.abs(x).max(initial=0)) < 1 << 15 else "<i4"
        columns = [pa.array([row[0]], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "packed"])

    def run(batches):
        kept = None
        for batch in batches:
            part = (batch.column("row").to_numpy(), batch.column("id").to_numpy(), np.asarray(batch.column("ints").flatten(), dtype=np.int64).reshape(-1, width))
            kept = part if kept is None else tuple(np.concatenate(x) for x in zip(kept, part))
            while len(kept[0]) >= BLOCK:
                yield packed(*(x[:BLOCK] for x in kept))
                kept = tuple(x[BLOCK:] for x in kept)
        if kept is not None and len(kept[0]):
            yield packed(*kept)

    return run


def unpacked(ids: bytes, packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    kind = "<i2" if len(packed) == 2 * width * len(i) else "<i4"
    return i, np.frombuffer(packed, kind).astype(np.int64).reshape(-1, width)


def block_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sums and, in the last column, counts of each cluster."""
    out = np.zeros((k, x.shape[1] + 1), dtype=np.int64)
    order = np.argsort(cluster, kind="stable")
    found, first = np.unique(cluster[order], return_index=True)
    if len(found):
        out[found, :-1] = np.add.reduceat(x[order], first, axis=0)
        out[found, -1] = np.diff([*first, len(x)])
    return out


def _round(width: int, history: list[np.ndarray]):
    """Blocks with their last state to the next one: with one set of centroids the first look, else bounds and balls."""
    now, before = history[-1], history[-2] if len(history) > 1 else None
    ball, k = Ball.of(now), len(now)
    way = None if before is None else np.sqrt(((now - before) ** 2).sum(axis=1).astype(np.float64)) * UP

    def run(batches):
        for batch in batches:
            total, out = np.zeros((k, width + 1), dtype=np.int64), []
            for j in range(batch.num_rows):
                _, x = unpacked(batch.column("ids")[j].as_py(), batch.column("packed")[j].as_py(), width)
                if way is None:
                    cluster, upper, lower = first_look(x, now)
                else:
                    cluster = np.frombuffer(batch.column("cluster")[j].as_py(), "<i4").astype(np.int64)
                    upper, lower = (np.frombuffer(batch.column(c)[j].as_py(), "<f8").copy() for c in ("upper", "lower"))
                    moved(cluster, upper, lower, way)
                    exponion(x, cluster, upper, lower, ball)
                total += block_sums(x, cluster, k)
                out.append((batch.column("block")[j].as_py(), cluster.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes()))
            if out:
                sums = [total.tobytes(), *[None] * (len(out) - 1)]  # one for all blocks of the batch
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))] + [pa.array(sums, pa.binary())], ["block", "cluster", "upper", "lower", "sums"])

    return run


STATE = "block long, cluster binary, upper binary, lower binary, sums binary"


def _summed(state: DataFrame, k: int, width: int) -> np.ndarray:
    """Sums and counts over all blocks: each task adds up its own, then k rows of width + 1 exact sums meet."""

    def run(batches):
        total = np.zeros((k, width + 1), dtype=np.int64)
        for batch in batches:
            for x in batch.column("sums").drop_null():
                total += np.frombuffer(x.as_py(), np.int64).reshape(k, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = state.select("sums").mapInArrow(run, "cluster int, sums array<long>")
    sums = F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width + 1)])
    out = np.zeros((k, width + 1), dtype=object)
    for r in parts.groupBy("cluster").agg(sums.alias("sums")).collect():  # k rows
        out[r.cluster] = [int(x) for x in r.sums]
    return out


def _next(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Exact floors of the means; an empty cluster keeps its centroid."""
    return np.array([[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else own.tolist() for own, row in zip(centroids, sums)], dtype=np.int64)


def _write_state(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """The state bucketed as the blocks are; the join by block keeps its rows in their buckets, so nothing is shuffled."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "kmeans-state")
    name = path.rpartition("-")[2]
    df.write.bucketBy(blocks._buckets, "block").sortBy("block").option("path", path).format("parquet").saveAsTable(f"whyframe_{name}")
    out = spark.table(f"whyframe_{name}")
    out._staged_path, out._staged_table = path, f"whyframe_{name}"
    return out


def fit(kept: DataFrame, k: int, rounds: int, width: int, salt: str) -> tuple[DataFrame, DataFrame, np.ndarray] | None:
    """(blocks, their last state, centroids) after ``rounds`` moves and a last assignment; None without vectors."""
    kept = stage(kept, "kmeans-vectors")
    centroids = starts(kept, k, salt)
    if not len(centroids):
        unstage(kept)
        return None
    numbered = kept.withColumn("row", F.monotonically_increasing_id())
    blocks = stage(numbered.mapInArrow(_blocks(width), "block long, ids binary, packed binary"), "kmeans-packed")
    bucketed = stage_bucketed(blocks, "kmeans-blocks", "block", 64)
    unstage(kept, blocks)
    history, state = [centroids], None
    for turn in range(rounds + 1):
        source = bucketed if state is None else bucketed.hint("merge").join(state.drop("sums"), "block")
        last, state = state, _write_state(source.mapInArrow(_round(width, history), STATE), bucketed)
        if last is not None:
            unstage(last)
        if turn < rounds:
            history = [history[-1], _next(history[-1], _summed(state, len(centroids), width))]
    return bucketed, state, history[-1]


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    made = fit(kept_vectors(vectors, width, scale, id_col, vec_col), k, rounds, width, salt)
    if made is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks, state, centroids = made

    def members(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                ids, x = unpacked(batch.column("ids")[j].as_py(), batch.column("packed")[j].as_py(), width)
                cluster = np.frombuffer(batch.column("cluster")[j].as_py(), "<i4")
                distance = own_squared(x, centroids, cluster)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stage(blocks.hint("merge").join(state.select("block", "cluster"), "block").mapInArrow(members, "vec_id long, cluster int, distance long"), "kmeans-members")
    unstage(blocks, state)
    by_cluster = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, by_cluster[c], sum(by_cluster.values()), names[c]) for c in by_cluster]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
