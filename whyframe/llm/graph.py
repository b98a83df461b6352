"""Connected components and hub-wise linking, distributed throughout.

No list of links, members or components reaches the driver: only counts and
checksums do. Every round is written to the shared folder, which cuts the
lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage


def smallest_labels(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest vertex of the component of each of n vertices under links (p, q), for links within one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        after = label.copy()
        np.minimum.at(after, label[p], low)
        np.minimum.at(after, label[q], low)
        while not np.array_equal(jump := after[after], after):
            after = jump
        if np.array_equal(after, label):
            return label
        label = after


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex with a link; component: the smallest id reachable.

    Alternating large-star and small-star steps: each hangs the neighbours of
    a vertex under the smallest of them, so hubs never meet in one task as a
    group; only a minimum per vertex is aggregated, with map-side partials.
    Null ends and loops are ignored, repeated links count once; without links
    the result is empty.
    """
    e = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    state = _checksum(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        unstage(e)
        e, before, state = after, state, _checksum(after)
        if state == before:
            break
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def merge_components(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after adding links (a, b) to known components: only their labels are joined anew."""
    if known is None:
        return stage(components(links), "components")
    label = lambda s: known.select(F.col("id").alias(s), F.col("component").alias(f"c{s}"))
    lifted = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    up = stage(components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "labels")
    moved = known.join(up.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("id", F.coalesce("to", "component").alias("component"))
    out = stage(moved.unionByName(up.join(known, "id", "left_anti")), "components")
    unstage(up)
    return out


def link_by_pivots(rows: DataFrame, links_of: Callable[[DataFrame], DataFrame], allowed: F.Column | None = None, growth: int = 8) -> DataFrame:
    """(id, component) of the items linked inside the buckets, over all true links.

    rows: (bucket, id) and further columns of the item, one row for each bucket
    an item is in; two items may be linked only if they share a bucket.
    ``links_of`` takes candidate pairs (a, b) with a < b and keeps the true
    links. ``allowed`` is a condition that every link meets, on the further
    columns of an item and, with ``p_`` before the name, of the pivot.

    Instead of all pairs of a bucket, each round compares a few pivots of a
    bucket with its other members, skips members already in the pivot's
    component, and leaves a bucket when a single component remains in it. A
    pivot has then met every member, so it is withdrawn. The number of pivots
    grows from round to round, and the rounds end when no bucket holds two
    components, so no link between two components is ever missed. A family of
    near copies ends after one round, with one pair for each member. The first
    pivots are the items with the largest ``weight``, if there is such a column.
    Later pivots come from outside the component with the smallest label first:
    in a bucket with one large family and a few others, the others are pivots.
    """
    own = [c for c in rows.columns if c not in ("bucket", "id")]
    rows, pivots, comp = stage(rows, "bucket-rows"), 1, None
    while True:
        if comp is None:
            state = rows.withColumn("component", F.col("id"))
        else:
            state = rows.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = state.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket", "lo")
        live = stage(state.join(mixed, "bucket"), "bucket-live")
        if live.isEmpty():
            unstage(live, rows)
            break
        first = [] if comp is None else [F.col("component") == F.col("lo")]
        order = Window.partitionBy("bucket").orderBy(*first, *([F.desc("weight")] if "weight" in own else []), "id")
        top = live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots).select("bucket", *[F.col(c).alias(f"p_{c}") for c in ("id", "component", *own)])
        top = stage(top, "pivots")
        open_ = (F.col("component") != F.col("p_component")) & (allowed if allowed is not None else F.lit(True))
        met = live.join(top, "bucket").where(open_)
        pairs = met.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()
        found = stage(links_of(pairs).select("a", "b"), "links")
        rest = live.select("bucket", "id", *own).join(top.select("bucket", F.col("p_id").alias("id")), ["bucket", "id"], "left_anti")
        rest = stage(rest, "bucket-rows")
        after = merge_components(comp, found)
        unstage(live, rows, top, found, *([comp] if comp is not None else []))
        rows, comp, pivots = rest, after, pivots * growth
    return rows.sparkSession.createDataFrame([], "id long, component long") if comp is None else comp
