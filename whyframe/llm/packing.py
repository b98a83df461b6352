"""Best-fit packing by length patterns fitted with non-negative least squares.

Documents become pieces of at most ``capacity`` tokens; only the number of
pieces of each length matters to the plan, so planning costs the same for any
corpus. Patterns of one to three lengths that fill a sequence exactly are
enumerated; their repeat counts are fitted to the histogram of lengths by
non-negative least squares, rounded down within what is there, and the rest is
packed best-fit, longest first. Pieces then take the places of their length by
rank, without meeting in one task.

Defined results: a null text is an empty text, whose only token is the end id.
Rows with a null id are left out. Rows that repeat an id are packed each on
their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_id, partitions, stage
from .tokenizing import encoder, packed_documents

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; a document longer than ``capacity`` is cut so that all but its first piece are full."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, data in packed_documents(batch, tokenizer, end_id):
                ids = np.frombuffer(data, encoder(tokenizer).dtype).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                at = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _ARROW)], schema=_ARROW)

    plain = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL")
    return plain.mapInArrow(run, PIECES)


def enumerate_patterns(histogram: np.ndarray) -> np.ndarray:
    """Rows (i, j, k), i >= j >= k, of lengths present that fill the capacity exactly; 0: no document."""
    capacity = len(histogram) - 1
    there = histogram > 0
    there[0] = True
    lengths = np.flatnonzero(there).astype(np.int32)
    i, j = np.meshgrid(lengths, lengths, indexing="ij")
    i, j = i.ravel(), j.ravel()
    k = capacity - i - j
    ok = (i < capacity) & (i >= j) & (j >= k) & (k >= 0) & (j > 0)
    i, j, k = i[ok], j[ok], k[ok]
    ok = there[k]
    return np.stack([i[ok], j[ok], k[ok]], axis=1)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares fit of the patterns' repeat counts to the histogram.

    Accelerated projected gradient. The residual of a length weighs with the
    length over the root of its count, as long pieces are the hard ones to
    place later and rare lengths must not drown.
    """
    n, target = len(histogram), histogram.astype(float)
    target[0] = 0
    weight = np.arange(n) / (n - 1) / np.sqrt(np.maximum(target, 1.0)) + 1e-3
    weight[0] = 0
    square = weight**2
    flat = patterns.ravel()
    scale = 1.0 / np.maximum(np.bincount(flat, minlength=n) * square * 3, 1e-9)
    step = scale[patterns].min(axis=1, where=patterns > 0, initial=np.inf)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        made = np.bincount(flat, weights=np.repeat(y, 3), minlength=n)
        slope = (square * (made - target))[patterns].sum(axis=1)
        after = np.maximum(0.0, y - step * slope)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence, repeats)."""
    capacity = len(histogram) - 1
    bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], count: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append([content, count])

    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                deep = capacity // length
                full, over = divmod(left, deep)
                if full:
                    put(capacity - deep * length, (length,) * deep, full)
                if over:
                    put(capacity - over * length, (length,) * over, 1)
                break
            room = rooms[at]
            content, count = bins[room][-1]
            deep = min(room // length, max(1, left // count))
            take = min(count, left // deep)
            if take == count:
                bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                bins[room][-1][1] -= take
            put(room - deep * length, content + (length,) * deep, take)
            left -= take * deep
    return [(tuple(c), n) for group in bins.values() for c, n in group]


def plan_packing(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use every piece of the histogram once."""
    left = histogram.astype(np.int64).copy()
    capacity, plan = len(left) - 1, []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = enumerate_patterns(left)
    if len(patterns):
        repeats = fit_repeats(patterns, left)
        for p in np.argsort(-repeats, kind="stable"):
            want = int(np.floor(repeats[p] + 1e-6))
            if not want:
                break
            lengths = tuple(int(v) for v in patterns[p] if v)
            have = min(int(left[v]) // lengths.count(v) for v in lengths)
            if take := min(want, have):
                plan.append((lengths, take))
                for v in lengths:
                    left[v] -= take
    return plan + best_fit(left)


def _places(plan: list[tuple[tuple[int, ...], int]], capacity: int):
    """For each length the intervals of ranks (first rank, sequence of it, offset), as flat arrays."""
    by: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    widths: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = 0
    for lengths, repeats in plan:
        offset = 0
        for v in lengths:
            by[v].append((sequence, offset))
            widths[v].append(repeats)
            offset += v
        sequence += repeats
    at = np.zeros(capacity + 2, dtype=np.int64)
    np.cumsum([len(x) for x in by], out=at[1:])
    flat = np.array([x for group in by for x in group], dtype=np.int64).reshape(-1, 2)
    first = np.concatenate([np.concatenate([[0], np.cumsum(w)[:-1]]) if w else np.zeros(0, np.int64) for w in widths]).astype(np.int64)
    return at, first, flat[:, 0].copy(), flat[:, 1].copy()


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) with sequence_id and offset; what is sent to the executors is bounded by the capacity."""
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[length] = n
    at, first, sequence, offset = _places(plan_packing(histogram), capacity)

    def run(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            place = np.empty(len(length), dtype=np.int64)
            for v in np.unique(length):
                own = length == v
                place[own] = at[v] + np.searchsorted(first[at[v] : at[v + 1]], rank[own], side="right") - 1
            found = [pa.array(sequence[place] + rank - first[place]), pa.array(offset[place])]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, "sequence_id", "offset"])

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(8, partitions(spark)))))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(base, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents: one row for each piece, with its place."""
    return pack_pieces(stage(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)


def sequence_tokens(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the sequences themselves, by the places in ``packed``. Ids must be unique among the documents."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, data in packed_documents(batch, tokenizer, end_id):
                ids = np.frombuffer(data, encoder(tokenizer).dtype).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                at = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, ids[a:b].tolist()) for k, (a, b) in enumerate(zip(at, at[1:]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["doc_id", "piece", "ids"])

    plain = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL")
    ids = plain.mapInArrow(run, "doc_id long, piece int, ids array<long>")
    joined = packed.join(ids, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
