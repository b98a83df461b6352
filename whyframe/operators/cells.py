"""An exact vector index that needn't be read whole: vectors by cell, a cell's vectors by their distance from its centre.

Centres come from k-means over a bounded sample; every vector goes to its nearest
centre's cell, which is a folder of its own, sorted by the distance to the
centre. By the triangle inequality a vector nearer than t to a query lies in a
cell whose centre is at most t and the cell's radius away, and its own distance
to the centre differs from the query's by at most t. So the nearest cells give
k vectors and with the last of them t; then cells out of reach are never opened,
and of the others only row groups within reach. Ties at the border are in reach.

Vectors that are null, of another length or not finite have a cell of their own
(-1), which is always read, so that results are those of the full scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import TOP_K, vector_top_k

#: Vectors that centres are fitted on, at most.
SAMPLE = 8192
OUTSIDE = -1


def fit_centres(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centres by Lloyd's rounds over a sample; empty cells go."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = _distances(x, centres).argmin(axis=1)
        centres = np.stack([x[own == i].mean(axis=0) for i in range(len(centres)) if (own == i).any()])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all rows, a block of rows at a time."""
    out = np.empty((len(x), len(centres)))
    for a in range(0, len(x), 512):
        gap = x[a : a + 512, None, :] - centres[None]
        out[a : a + 512] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _usable(width: int) -> Column:
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size("vec") == width) & finite, F.lit(False))


def build_cells(vectors: DataFrame, path: str, cells: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> None:
    """Write the index of (id, vector) rows under ``path``; every row is in it."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(vec_col).alias("own"))
    some = rows.where(F.size("vec") > 0).select("vec").first()
    width = len(some.vec) if some is not None else 0
    picked = rows.where(_usable(width)).orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()  # a bounded sample
    centres = fit_centres(np.array([r.vec for r in picked]), cells) if picked else np.zeros((0, width))

    def place(batches):
        for batch in batches:
            ok = np.asarray(batch.column("ok"))
            cell, far = np.full(len(ok), OUTSIDE, dtype=np.int32), np.zeros(len(ok))
            if ok.any():
                x = np.asarray(batch.column("vec").filter(batch.column("ok")).flatten(), dtype=np.float64).reshape(-1, width)
                d = _distances(x, centres)
                cell[ok], far[ok] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(far), pa.array(cell)], ["id", "own", "to_centre", "cell"])

    kinds = dict(rows.dtypes)
    placed = rows.withColumn("ok", _usable(width)).mapInArrow(place, f"id {kinds['id']}, own {kinds['own']}, to_centre double, cell int")
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16)))  # a large cell is written by several tasks
    dealt.sortWithinPartitions("cell", "to_centre").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    found = spark.read.schema(f"id {kinds['id']}, own {kinds['own']}, to_centre double, cell int").parquet(f"{path}/vectors")
    sizes = found.groupBy("cell").agg(F.max("to_centre").alias("radius"), F.count(F.lit(1)).alias("n"))
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes.join(F.broadcast(told), "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # a row for each cell


class Cells:
    """A saved index."""

    def __init__(self, spark: SparkSession, path: str):
        self.vectors = spark.read.parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/cells").collect()  # a row for each cell
        own = sorted((r for r in rows if r.cell != OUTSIDE), key=lambda r: r.cell)
        self.numbers = [r.cell for r in own]
        self.centres = np.array([r.centre for r in own])
        self.radius, self.n = np.array([r.radius for r in own]), np.array([r.n for r in own])
        self.outside = any(r.cell == OUTSIDE for r in rows)

    def within(self, query: np.ndarray, reach: float) -> DataFrame:
        """The index's rows that may be at most ``reach`` away from a query, by cell and by distance from its centre."""
        keep = F.col("cell") == OUTSIDE if self.outside else F.lit(False)
        for i, d in enumerate(self._away(query)):
            slack = 1e-9 * (1 + d + min(reach, 1e300))
            if d - self.radius[i] <= reach + slack:
                inside = F.col("cell") == self.numbers[i]
                if math.isfinite(reach):
                    inside = inside & F.col("to_centre").between(float(d - reach - slack), float(d + reach + slack))
                keep = keep | inside
        return self.vectors.where(keep)

    def _away(self, query: np.ndarray) -> np.ndarray:
        return _distances(query[None], self.centres)[0] if len(self.numbers) else np.zeros(0)

    def reach(self, query: np.ndarray, k: int) -> float:
        """How far the k-th nearest vector is at most, told by the nearest cells that hold k vectors."""
        order = np.argsort(self._away(query), kind="stable")
        first = int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1
        if first > len(order):
            return math.inf
        some = self.vectors.where(F.col("cell").isin([self.numbers[i] for i in order[:first]]))
        last = vector_top_k(some, F.lit(query.tolist()), k, "id", "own").agg(F.max("distance").alias("d"), F.count("distance").alias("n")).first()
        return math.sqrt(last.d) if last.n == k else math.inf

    def top_k(self, query: list[float], k: int = TOP_K, id_col: str = "vec_id") -> DataFrame:
        """(id, squared distance) of the k nearest vectors, ties by id, as the full scan gives them."""
        q = np.array(query, dtype=np.float64)
        near = self.within(q, self.reach(q, k))
        return vector_top_k(near, F.lit(q.tolist()), k, "id", "own").withColumnRenamed("id", id_col)
