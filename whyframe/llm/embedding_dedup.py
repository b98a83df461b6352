"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of a label are scaled to unit length, turned to the principal axes of
the whole table, ordered along the first axis and cut into tiles. Two unit
vectors with cosine c are 2 - 2 c apart in squared distance, so tiles whose
ranges on the first axis are further apart than that allows are never paired.
Within a pair of tiles the products of the leading axes are accumulated first;
the rest of a product is at most the product of the two suffix norms, and pairs
that cannot reach the threshold any more are given up block by block. Pairs
that stay are verified by the cosine of the original vectors in double
precision.

A pair of tiles counts links by vector and hands on a spanning forest of its
links, so a family of near copies never writes out all its pairs. Equal vectors
of a label are one vector with a count.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, and vectors with a null label link with nothing, not
even with equals; each is a component of its own and kept. Vectors of different
lengths link with nothing either; any number of lengths may stand in a table. Rows with a null id are left out. Of rows that
repeat an id, each counts as a vector; the id has one row with the sum of the
other rows' links. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_id, stage
from .graph import components

SLACK = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, width)


def usable(df: DataFrame) -> F.Column:
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, by falling variance; mean) of the unit vectors, from one sum per task: width squared numbers."""

    def run(batches):
        n, total, square = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("vec"), width)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], ["n", "total", "square"])

    parts = vectors.select("vec").mapInArrow(run, "n long, total array<double>, square array<double>")
    sums = lambda c, k: F.array(*[F.sum(F.col(c)[i]) for i in range(k)])
    row = parts.agg(F.sum("n").alias("n"), sums("total", width).alias("total")).first()
    flat = parts.select(F.posexplode("square").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # width squared numbers
    square = np.zeros(width * width)
    for r in flat:
        square[r.i] = r.v
    mean = np.array(row.total) / max(row.n, 1)
    values, axes = np.linalg.eigh(square.reshape(width, width) / max(row.n, 1) - np.outer(mean, mean))
    return axes[:, ::-1].copy(), mean


def _turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ axes


def tile_links(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, threshold: float, block: int = 8, chunk: int = 256):
    """(i, j) chunks of pairs with cosine >= threshold; x, y: turned unit vectors."""
    width = x.shape[1]
    cuts = [*range(0, width, block), width]
    tails_x = [np.sqrt(np.maximum((x[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    tails_y = [np.sqrt(np.maximum((y[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    norm_x, norm_y = np.sqrt((raw_x**2).sum(axis=1)), np.sqrt((raw_y**2).sum(axis=1))
    for a in range(0, len(x), chunk):
        part = x[a : a + chunk]
        sums = part[:, : cuts[1]] @ y[:, : cuts[1]].T
        i, j = np.nonzero(sums + tails_x[1][a : a + chunk, None] * tails_y[1][None, :] >= threshold - SLACK)
        left = sums[i, j]
        for k in range(1, len(cuts) - 1):
            if not len(i):
                break
            left = left + np.einsum("nd,nd->n", part[i, cuts[k] : cuts[k + 1]], y[j, cuts[k] : cuts[k + 1]])
            ok = left + tails_x[k + 1][a + i] * tails_y[k + 1][j] >= threshold - SLACK
            i, j, left = i[ok], j[ok], left[ok]
        for s in range(0, len(i), 65536):
            p, q = a + i[s : s + 65536], j[s : s + 65536]
            cosine = np.einsum("nd,nd->n", raw_x[p], raw_y[q]) / (norm_x[p] * norm_y[q])
            ok = cosine >= threshold
            if ok.any():
                yield p[ok], q[ok]


class Forest:
    """Union-find over the vectors of two tiles, keeping the links that joined something."""

    def __init__(self, n: int):
        self.parent, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            rp, rq = self.parent[p], self.parent[q]
            while True:
                up, uq = self.parent[rp], self.parent[rq]
                if (up == rp).all() and (uq == rq).all():
                    break
                rp, rq = up, uq
            open_ = rp != rq
            p, q, rp, rq = p[open_], q[open_], rp[open_], rq[open_]
            if not len(p):
                break
            low, high = np.minimum(rp, rq), np.maximum(rp, rq)
            tops, first = np.unique(high, return_index=True)  # one union for each root at a time
            self.parent[tops] = low[first]
            self.links += list(zip(p[first].tolist(), q[first].tolist()))


def _tile_pair(threshold: float, width: int):
    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        raw, turned = _matrix(group.column("vec"), width), _matrix(group.column("turned"), width)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        counts, forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))
        for p, q in tile_links(turned[left], turned[right], raw[left], raw[right], threshold):
            if same:
                ok = p < q
                p, q = p[ok], q[ok]
            p, q = left[p], right[q]
            np.add.at(counts, p, copies[q])
            np.add.at(counts, q, copies[p])
            forest.add(p, q)
        hit = np.flatnonzero(counts)
        a, b = ([ids[i] for i, _ in forest.links], [ids[j] for _, j in forest.links])
        return pa.table({"a": pa.array([*ids[hit].tolist(), *a], pa.int64()), "b": pa.array([None] * len(hit) + b, pa.int64()), "links": pa.array([*counts[hit].tolist(), *[0] * len(a)], pa.int64())})

    return run


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): for each vector the others linked directly, and its component."""
    plain = vectors.select(as_id(id_col).alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).where("id IS NOT NULL")
    plain = stage(plain.withColumn("ok", usable(plain)).withColumn("width", F.size("vec")), "vectors")
    room = F.ceil(F.log2(F.col("width").cast("double"))).cast("int")
    rooms = [r.room for r in plain.where("ok").select(room.alias("room")).distinct().collect()]  # 31 at most
    links = classes = None
    for width in sorted(1 << r for r in rooms):
        # vectors of other lengths have other labels; zeros up to the next power of two change no product
        own = plain.where(F.col("ok") & (F.col("width") <= width) & (F.col("width") > width // 2))
        filled = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(width) - F.col("width")))
        own = own.select("id", F.struct("label", "width").alias("label"), F.when(F.col("width") == width, F.col("vec")).otherwise(filled).alias("vec"))
        reps = stage(own.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
        axes, _ = principal_axes(reps, width)

        def turn(batches, axes=axes, width=width):
            for batch in batches:
                x = _turned(_matrix(batch.column("vec"), width), axes)
                turned = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, turned, pa.array(x[:, 0].copy())], [*batch.schema.names, "turned", "lead"])

        label_type = dict(reps.dtypes)["label"]
        turned = stage(reps.mapInArrow(turn, f"label {label_type}, vec array<double>, rep long, copies long, turned array<double>, lead double"), "turned")
        tiled = _tiles(turned, tile)
        reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
        spans = stage(tiled.groupBy("label", "tile").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi")), "tile-spans")
        other = spans.select(F.col("label").alias("l2"), F.col("tile").alias("t2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        pairs = spans.join(other, (F.col("label") == F.col("l2")) & (F.col("tile") <= F.col("t2")) & (F.col("lo2") <= F.col("hi") + reach) & (F.col("lo") <= F.col("hi2") + reach))
        pairs = stage(pairs.select("label", "tile", "t2"), "tile-pairs")
        first = pairs.select("label", "tile", "t2", F.col("tile").alias("own"), F.lit(0).alias("side"))
        second = pairs.where("tile <> t2").select("label", "tile", "t2", F.col("t2").alias("own"), F.lit(1).alias("side"))
        members = tiled.select("label", F.col("tile").alias("own"), "rep", "copies", "vec", "turned")
        work = first.unionByName(second).join(members, ["label", "own"])
        found = work.select("label", "tile", "t2", "side", "rep", "copies", "vec", "turned").groupBy("label", "tile", "t2").applyInArrow(_tile_pair(threshold, width), "a long, b long, links long")
        found = stage(found, "tile-links")
        links = found if links is None else links.unionByName(found)
        named = own.select("id", "label", "vec").join(reps, ["label", "vec"]).select("id", "rep", "copies")
        classes = named if classes is None else classes.unionByName(named)
    alone = plain.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if links is None:
        out = alone
    else:
        counts = links.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        comp = components(links.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "rep")
        out = classes.join(counts, "rep", "left").join(comp, "rep", "left")
        out = out.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")).unionByName(alone)
    out = out.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component_id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _tiles(turned: DataFrame, tile: int, grain: int = 256) -> DataFrame:
    """Adds ``tile``: about ``tile`` consecutive vectors of a label along the first axis.

    Ranks come from counts of fine ranges of the axis and from ranks within a
    range and a salt, so no label has to be sorted in one task.
    """
    fine = F.floor((F.col("lead") + 1) * grain * 8).cast("int")
    salted = turned.withColumn("range", fine).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(16)))
    counts = salted.groupBy("label", "range", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy("range", "salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("label", "range", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("label", "range", "salt").orderBy("lead", "rep")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(base, ["label", "range", "salt"])
    return stage(ranked.withColumn("tile", F.floor((F.col("base") + F.col("own") - 1) / tile).cast("int")).drop("range", "salt", "own", "base"), "tiled")
