"""N-gram Jaccard join by prefix filtering under several global token orders.

Tokens are the distinct n-word shingles of a text. Under any global order of
the tokens, two sets whose Jaccard similarity reaches t share a token among
the first ``n - ceil(t n) + 1`` tokens of each; this holds for every order at
once. The orders used here put rare shingles first and break ties between
shingles of like frequency by a different hash each. Candidates meet in the
prefix under the first order and must also share prefix tokens under all the
others before their sets are compared exactly.

Only shingles that stand in two documents or more can be shared. They are
found by an exact count over the whole corpus, with packed arrays: a slice of
documents sends one row to each bucket of shingles, and gets one back with
the shingles that repeat. A document whose repeated shingles are fewer than
``ceil(t n)`` has no partner and goes no further.

Before a pair is made at all, parities of hashed shingles bound the sets'
difference from below: each shingle that only one set has changes one of 256
bits at most. Pairs that differ in more bits than the threshold allows are not
candidates. The first document that a bucket is compared with is the one with
the most frequent shingles, as a rule the text that the others are copies of.

Documents with equal sets form one class and are joined through their
smallest id, so thousands of copies cost as much as one text.

Defined results: a null or empty text, or one of separators only, has an empty
set and links with nothing (component: itself). Rows with a null id are left
out, since they cannot be named in a result. Of rows that repeat an id, each is
a text of that id: they share the row ``(id, largest n_shingles, component)``.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_id, partitions, stage
from .graph import link_by_pivots, merge_components
from .text_kernels import U64, mix, shingle_sets, slices, text_buffers, word_hashes

LOW = U64((1 << 40) - 1)
ORDERS = 3
SKETCH = 4
_SALTS = [0x51ED270B, 0x2545F491, 0x9E6D62D0, 0x7F4A7C15, 0x1B873593]


def needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent/100 * size): shared tokens that a partner must offer at least."""
    return (sizes * percent + 99) // 100


def _sets_of(batch: pa.RecordBatch, n: int):
    raw, offsets = text_buffers(batch.column("text"))
    for a, b in slices(offsets):
        part = raw[offsets[a] : offsets[b]]
        hashes, first = word_hashes(part, offsets[a : b + 1] - offsets[a])
        sets, at = shingle_sets(hashes, first, n)
        yield batch.column("id").slice(a, b - a), sets, at


def _segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def document_classes(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, c1, c2): the set's size and a 128-bit digest of it."""

    def run(batches):
        for batch in batches:
            for ids, sets, at in _sets_of(batch, n):
                size = np.diff(at)
                c1, c2 = _segment_sums(mix(sets), at), _segment_sums(mix(sets ^ U64(0xA0761D6478BD642F)), at)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64))], ["id", "n_shingles", "c1", "c2"])

    return docs.mapInArrow(run, "id long, n_shingles long, c1 long, c2 long")


def _grouped(batches, n: int, least: int):
    """(ids, sets, set borders) of consecutive documents with at least ``least`` shingles together, but for the last."""
    ids, sets, sizes, held = [], [], [], 0
    for batch in batches:
        for i, s, at in _sets_of(batch, n):
            ids.append(np.asarray(i, dtype=np.int64))
            sets.append(s)
            sizes.append(np.diff(at))
            held += len(s)
            if held >= least:
                yield np.concatenate(ids), np.concatenate(sets), np.concatenate(sizes)
                ids, sets, sizes, held = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(sets), np.concatenate(sizes)


def _by_bucket(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Packed shingles: (bucket, slice_id, counts, tokens, header), a row for each slice and bucket.

    A slice has about a thousand shingles for each bucket, so rows stay packed
    however many buckets there are.
    """

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, (ids, sets, sizes) in enumerate(_grouped(batches, n, 1024 * buckets)):
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            bucket = ((sets >> U64(40)) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            low, owner = (sets & LOW)[order], owner[order]
            own = k % buckets
            rows = {name: [] for name in _SCHEMA.names}
            for b in range(buckets):
                x, y = cut[b], cut[b + 1]
                if x == y and b != own:
                    continue
                counts = np.bincount(owner[x:y], minlength=len(sizes)).astype(np.uint32)
                rows["bucket"].append(b)
                rows["slice_id"].append((task << 32) + k)
                rows["counts"].append(counts.astype(np.uint16).tobytes() if counts.max(initial=0) < 65535 else b"W" + counts.tobytes())
                rows["tokens"].append(_pack(low[x:y]))
                rows["header"].append(np.concatenate([ids, sizes]).tobytes() if b == own else None)
            yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)

    return docs.mapInArrow(run, "bucket int, slice_id long, counts binary, tokens binary, header binary")


_SCHEMA = pa.schema([("bucket", pa.int32()), ("slice_id", pa.int64()), ("counts", pa.binary()), ("tokens", pa.binary()), ("header", pa.binary())])


def _pack(x: np.ndarray) -> bytes:
    """40-bit integers in five bytes each: the low words first, then the high bytes."""
    return (x & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (x >> U64(32)).astype(np.uint8).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, np.uint32, n).astype(U64) | (np.frombuffer(data, np.uint8, n, 4 * n).astype(U64) << U64(32))


def _counts(data: bytes) -> np.ndarray:
    wide = len(data) % 2
    return np.frombuffer(data, np.uint32, offset=1).astype(np.int64) if wide else np.frombuffer(data, np.uint16).astype(np.int64)


def _repeated_in_bucket(group: pa.Table) -> pa.Table:
    """Of a bucket: for each slice the tokens that another document also has, with a frequency class."""
    rows = group.to_pylist()
    tokens = [_unpack(r["tokens"]) for r in rows]
    every = np.concatenate(tokens) if tokens else np.zeros(0, U64)
    order = np.argsort(every)
    ranked = every[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    run = np.cumsum(new) - 1
    count = np.bincount(run) if len(ranked) else np.zeros(0, np.int64)
    df = np.empty(len(every), dtype=np.int64)
    df[order] = count[run]
    level = np.minimum(255, np.floor(8 * np.log2(np.maximum(df, 1)))).astype(np.uint8)
    out = {"bucket": [], "slice_id": [], "counts": [], "tokens": [], "levels": [], "header": []}
    at = 0
    for r, t in zip(rows, tokens):
        keep = df[at : at + len(t)] > 1
        counts = _counts(r["counts"])
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        if len(owner) or r["header"] is not None:
            c = np.bincount(owner, minlength=len(counts)).astype(np.uint32)
            out["bucket"].append(r["bucket"])
            out["slice_id"].append(r["slice_id"])
            out["counts"].append(c.astype(np.uint16).tobytes() if c.max(initial=0) < 65535 else b"W" + c.tobytes())
            out["tokens"].append(_pack(t[keep]))
            out["levels"].append(level[at : at + len(t)][keep].tobytes())
            out["header"].append(r["header"])
        at += len(t)
    return pa.table(out, schema=_REPEATED)


_REPEATED = pa.schema([("bucket", pa.int32()), ("slice_id", pa.int64()), ("counts", pa.binary()), ("tokens", pa.binary()), ("levels", pa.binary()), ("header", pa.binary())])
_PROFILE = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("single", pa.int64()), ("weight", pa.int64()), *[(f"sketch{i}", pa.int64()) for i in range(SKETCH)], ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64())), *[(f"order{i}", pa.list_(pa.int32())) for i in range(1, ORDERS)]])


def _profiles(percent: int):
    """Of a slice: the documents that can have a partner, with their prefixes under every order."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = np.frombuffer(next(r["header"] for r in rows if r["header"] is not None), np.int64)
        ids, sizes = head[: len(head) // 2], head[len(head) // 2 :]
        owners, tokens, levels = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.uint8)]
        for r in rows:
            counts = _counts(r["counts"])
            owners.append(np.repeat(np.arange(len(counts)), counts))
            tokens.append(_unpack(r["tokens"]) | (U64(r["bucket"]) << U64(40)))
            levels.append(np.frombuffer(r["levels"], np.uint8))
        owners, tokens, levels = map(np.concatenate, (owners, tokens, levels))
        order = np.argsort(owners, kind="stable")
        owners, tokens, levels = owners[order], tokens[order], levels[order]
        cut = np.searchsorted(owners, np.arange(len(ids) + 1))
        need = needed(sizes, percent)
        out: dict[str, list] = {name: [] for name in _PROFILE.names}
        for k in np.flatnonzero((np.diff(cut) >= need) & (sizes > 0)):
            t, level = tokens[cut[k] : cut[k + 1]], levels[cut[k] : cut[k + 1]]
            # tokens of a single document come first under every order and can't be shared
            keep = len(t) - int(need[k]) + 1
            out["id"].append(int(ids[k]))
            out["size"].append(int(sizes[k]))
            out["single"].append(int(sizes[k]) - len(t))
            out["weight"].append(int(level.sum(dtype=np.int64)) * 100 // int(sizes[k]))
            parity = np.bincount((mix(t + U64(_SALTS[-1])) & U64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
            for i, word in enumerate(np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)):
                out[f"sketch{i}"].append(int(word))
            out["tokens"].append(np.sort(t).tobytes())
            for i in range(ORDERS):
                h = mix(t + U64(_SALTS[i]))
                chosen = t[np.lexsort((h, level))[:keep]]
                if i:
                    out[f"order{i}"].append(mix(chosen).view(np.int64).astype(np.int32))
                else:
                    out["prefix"].append(chosen.view(np.int64))
        return pa.table(out, schema=_PROFILE)

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()
            sa, sb = np.asarray(batch.column("size_a")), np.asarray(batch.column("size_b"))
            shared = np.empty(len(a), dtype=np.int64)
            for i, (x, y) in enumerate(zip(a, b)):
                both = np.concatenate([np.frombuffer(x, U64), np.frombuffer(y, U64)])
                both.sort()
                shared[i] = np.count_nonzero(both[1:] == both[:-1])
            ok = 100 * shared >= percent * (sa + sb - shared)
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the components of documents linked at Jaccard >= percent/100.

    Every link between different sets takes part; see the module for the
    method and for nulls, repeated ids and empty texts.
    """
    spark = docs.sparkSession
    plain = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL")
    members = stage(document_classes(plain, n), "members")
    classes = members.where("n_shingles > 0").groupBy("c1", "c2", "n_shingles").agg(F.min("id").alias("rep"))
    classes = stage(classes, "classes")

    buckets = max(16, partitions(spark))
    packed = _by_bucket(plain, n, buckets)
    repeated = packed.groupBy("bucket").applyInArrow(_repeated_in_bucket, "bucket int, slice_id long, counts binary, tokens binary, levels binary, header binary")
    sketch = [f"sketch{i}" for i in range(SKETCH)]
    schema = "id long, size long, single long, weight long, " + "".join(f"{c} long, " for c in sketch) + "tokens binary, prefix array<long>, " + ", ".join(f"order{i} array<int>" for i in range(1, ORDERS))
    profiles = repeated.groupBy("slice_id").applyInArrow(_profiles(percent), schema)
    profiles = stage(profiles.join(classes.select(F.col("rep").alias("id"), F.col("n_shingles").alias("size")).distinct(), ["id", "size"], "left_semi"), "profiles")

    def links_of(pairs: DataFrame) -> DataFrame:
        light = profiles.select("id", *[f"order{i}" for i in range(1, ORDERS)])
        side = lambda s: light.select(F.col("id").alias(s), *[F.col(f"order{i}").alias(f"{s}{i}") for i in range(1, ORDERS)])
        shared = F.lit(True)
        for i in range(1, ORDERS):
            shared = shared & F.arrays_overlap(f"a{i}", f"b{i}")
        candidates = pairs.join(side("a"), "a").join(side("b"), "b").where(shared).select("a", "b")
        full = lambda s: profiles.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), F.col("tokens").alias(f"tokens_{s}"))
        return candidates.join(full("b"), "b").join(full("a"), "a").mapInArrow(_verified(percent), "a long, b long")

    rows = profiles.select(F.explode("prefix").alias("bucket"), "id", "size", "single", "weight", *sketch)
    allowed = 100 * F.least("size", "p_size") >= percent * F.greatest("size", "p_size")
    differ = F.col("single") + F.col("p_single")
    for c in sketch:
        differ = differ + F.bit_count(F.col(c).bitwiseXOR(F.col(f"p_{c}")))
    allowed = allowed & (differ * (100 + percent) <= (F.col("size") + F.col("p_size")) * (100 - percent))
    found = merge_components(link_by_pivots(rows, links_of, allowed), _repeated_ids(members, classes))
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("c1", "c2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = members.join(named, ["c1", "c2", "n_shingles"], "left")
    return out.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("component", "id")).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, without those that belong to a group and aren't its smallest id.

    Documents with a null id, which no group can name, stay.
    """
    groups = ngram_jaccard_join(docs, n, percent, id_col, text_col)
    gone = stage(groups.where("id <> component_id").select(F.col("id").alias("__whyframe_id")), "group-members")
    return docs.join(gone, as_id(id_col) == F.col("__whyframe_id"), "left_anti")


def _repeated_ids(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that stands in several rows with different texts."""
    several = members.where("n_shingles > 0").groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("k > 1 AND lo <> hi").select("id")
    named = members.join(several, "id").join(classes, ["c1", "c2", "n_shingles"])
    return named.withColumn("b", F.min("rep").over(Window.partitionBy("id"))).select(F.col("rep").alias("a"), "b")
