"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A store is a folder of shards in ascending key order:

- ``shard-00000.ids``: the documents' ids, one after the other, as unsigned
  little-endian 16-bit integers (32-bit where the vocabulary needs it).
- ``shard-00000.idx``: the magic ``WFIDX2``, a JSON header with lengths, then
  the bit arrays of the perfect hash with the bits counted before each of their
  blocks, and by its index the fingerprint (32 bits), the first id and the
  number of ids of every document; last the keys in order with their occurrence
  numbers, for scans.
- ``manifest.json``: of each shard its number, documents, ids, smallest and
  largest key and how often these stand in it.

A key is looked up in constant time: the manifest names its shard, the perfect
hash takes a block of bits and a count for each level (under two on average),
and a fingerprint, a place and the ids are read, not the index as a whole. Keys
are ids with an occurrence number, so that a repeated id keeps all its documents
(0 for the first), also where they lie in several shards.

Defined results: a null text is an empty text, which has the end id alone. Rows
with a null id are left out. Repeated rows are documents of their own, in the
order of a hash of their text. Long texts are encoded whole. An empty table
gives a store without shards. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_id, new_path, partitions
from .files import reading, writing
from .perfect_hash import BLOCK, PerfectHash, place_of
from .text_kernels import U64, mix
from .tokenizing import encoder, packed_documents

MAGIC = b"WFIDX2\0\0"
SHARD_BYTES = 128 << 20
MANIFEST = pa.schema([("shard", pa.int32()), *[(n, pa.int64()) for n in ("documents", "tokens", "low", "high", "lows", "highs")]])


def key_hashes(ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(U64) + mix(occurrence.astype(U64)) * U64(0xC2B2AE3D27D4EB4F))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype("<u4")


def write_index(uri: str, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, dtype: str) -> None:
    """ids: ascending; equal ones stand together."""
    new = np.ones(len(ids), dtype=bool)
    new[1:] = ids[1:] != ids[:-1]
    run = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    occurrence = (np.arange(len(ids)) - run).astype("<u4")
    keys = key_hashes(ids, occurrence)
    table = PerfectHash.build(keys)
    slot = table.index(keys)
    prints, first, count = np.empty(len(ids), "<u4"), np.empty(len(ids), "<u8"), np.empty(len(ids), "<u8")
    prints[slot], first[slot], count[slot] = _fingerprints(keys), starts, lengths
    head = json.dumps({"n": len(ids), "dtype": dtype, "levels": [len(x) for x in table.levels]}).encode()
    with writing(uri) as f:
        f.write(MAGIC + struct.pack("<I", len(head)) + head)
        for part in (*table.levels, *(r.astype("<i8") for r in table.ranks), prints, first, count, ids.astype("<i8"), occurrence):
            f.write(part.tobytes())


class Shard:
    """Keyed access to the documents of one shard; occurrence numbers count within it."""

    def __init__(self, base: str, shard: int):
        self.uri = f"{base}/shard-{shard:05d}"
        with reading(f"{self.uri}.idx") as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"{self.uri}.idx is no index")
            (size,) = struct.unpack("<I", f.read(4))
            head = json.loads(f.read(size))
        self.dtype, n = np.dtype(head["dtype"]), head["n"]
        self.parts, at = {}, 12 + size
        sizes = [(f"level{i}", "u1", k) for i, k in enumerate(head["levels"])] + [(f"ranks{i}", "<i8", k * 8 // BLOCK) for i, k in enumerate(head["levels"])]
        for name, kind, k in sizes + [("prints", "<u4", n), ("first", "<u8", n), ("count", "<u8", n), ("ids", "<i8", n), ("occurrence", "<u4", n)]:
            self.parts[name] = (at, np.dtype(kind), k)
            at += k * np.dtype(kind).itemsize
        self.levels = len(head["levels"])

    def _read(self, f, name: str, at: int, n: int) -> np.ndarray:
        start, kind, _ = self.parts[name]
        f.seek(start + at * kind.itemsize)
        return np.frombuffer(f.read(n * kind.itemsize), kind)

    def _column(self, name: str) -> np.ndarray:
        with reading(f"{self.uri}.idx") as f:
            return self._read(f, name, 0, self.parts[name][2])

    def find(self, ids: np.ndarray, occurrence: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of each of many keys; (-1, -1) where the shard hasn't got it. Reads the index once."""
        if not hasattr(self, "table"):
            self.table = PerfectHash([self._column(f"level{i}") for i in range(self.levels)])
            self.prints, self.first, self.count = self._column("prints"), self._column("first").astype(np.int64), self._column("count").astype(np.int64)
        keys = key_hashes(np.asarray(ids), np.zeros(len(ids), np.int64) if occurrence is None else occurrence)
        slot = self.table.index(keys)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == _fingerprints(keys[there])
        pick = lambda x: np.where(there, x[np.where(there, slot, 0)] if len(x) else -1, -1)
        return pick(self.first), pick(self.count)

    def read(self, key: int, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one key, or None, by a few short reads."""
        keys = key_hashes(np.array([key]), np.array([occurrence]))
        with reading(f"{self.uri}.idx") as f:
            for i in range(self.levels):
                block, inside = divmod(int(place_of(keys, i, self.parts[f"level{i}"][2] * 8)[0]), BLOCK)
                bits = np.unpackbits(self._read(f, f"level{i}", block * BLOCK // 8, BLOCK // 8), bitorder="little")
                if bits[inside]:
                    slot = int(self._read(f, f"ranks{i}", block, 1)[0]) + int(bits[:inside].sum())
                    break
            else:
                return None
            if self._read(f, "prints", slot, 1)[0] != _fingerprints(keys)[0]:
                return None
            first, count = (int(self._read(f, name, slot, 1)[0]) for name in ("first", "count"))
        with reading(f"{self.uri}.ids") as f:
            f.seek(first * self.dtype.itemsize)
            return np.frombuffer(f.read(count * self.dtype.itemsize), self.dtype)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(id, first id in the shard, ids) of every key in order, each found through the index."""
        own, occurrence = self._column("ids"), self._column("occurrence")
        with reading(f"{self.uri}.ids") as f:
            for at in range(0, len(own), 4096):
                ids = own[at : at + 4096]
                first, count = self.find(ids, occurrence[at : at + 4096])
                for key, a, n in zip(ids.tolist(), first.tolist(), count.tolist()):
                    if a < 0:
                        raise ValueError(f"{self.uri}: the index has lost key {key}")
                    f.seek(a * self.dtype.itemsize)
                    yield key, a, np.frombuffer(f.read(n * self.dtype.itemsize), self.dtype)


class TokenStore:
    """Keyed access to a whole store: the manifest leads to the one shard that holds a key."""

    def __init__(self, base: str):
        self.base = base
        with reading(f"{base}/manifest.json") as f:
            self.shards = json.loads(f.read())
        self.highs = [s["high"] for s in self.shards]

    def get(self, key: int, occurrence: int = 0) -> np.ndarray | None:
        """The ids of the document with this key, the ``occurrence``-th of a repeated one; None if there is none."""
        for s in self.shards[bisect_left(self.highs, key) :]:
            if key < s["low"]:
                return None
            if key < s["high"] or occurrence < s["highs"]:
                return Shard(self.base, s["shard"]).read(key, occurrence)
            occurrence -= s["highs"]
        return None


def write_store(docs: DataFrame, base: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[tuple[int, int, int]]:
    """Write the documents' ids to ``base`` in ascending id order; (shard, documents, tokens) of each shard.

    Shards are ranges of ids; repeated ids are told apart by their text, so a
    hot id spreads over shards as well. There are as many as shuffle partitions,
    and more where a shard would hold over SHARD_BYTES of text. A shard is
    written as a stream, and only its index stays in memory.
    """
    spark = docs.sparkSession

    def run(batches):
        shard, dtype = TaskContext.get().partitionId(), None
        ids, lengths = array("q"), array("q")
        with writing(f"{base}/shard-{shard:05d}.ids") as f:
            for batch in batches:
                dtype = encoder(tokenizer).dtype
                for doc, data in packed_documents(batch, tokenizer, end_id):
                    f.write(data)
                    ids.append(doc)
                    lengths.append(len(data) // dtype.itemsize)
        ids, lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
        write_index(f"{base}/shard-{shard:05d}.idx", ids, np.cumsum(lengths) - lengths, lengths, (dtype or np.dtype("<u2")).str)
        low, high = (int(ids[0]), int(ids[-1])) if len(ids) else (0, 0)
        row = [shard, len(ids), int(lengths.sum()), low, high, int((ids == low).sum()), int((ids == high).sum())]
        yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, row))], schema=MANIFEST)

    plain = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL")
    if shards is None:
        size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(partitions(spark), -(-size // SHARD_BYTES))
    ordered = plain.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    schema = "shard int, documents long, tokens long, low long, high long, lows long, highs long"
    # one row for each shard; sorted here, as a sort in Spark would sample the shards first and so write them twice
    done = sorted(ordered.mapInArrow(run, schema).where("documents > 0").collect(), key=lambda r: r.shard)
    with writing(f"{base}/manifest.json") as f:
        f.write(json.dumps([r.asDict() for r in done]).encode())
    return [(r.shard, r.documents, r.tokens) for r in done]


def read_store(spark: SparkSession, base: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    rows, before = [], 0
    for shard, _, tokens in manifest:
        rows.append((shard, before))
        before += tokens

    def run(batches):
        for batch in batches:
            for shard, base_id in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist()):
                found = ((key, base_id + a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for key, a, x in Shard(base, shard).documents())
                while out := list(islice(found, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(rows, "shard int, before long").repartition(max(1, len(rows)))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_documents(docs: DataFrame, tokenizer: str, end_id: int, base: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store, in a new shared folder if none is given, and read it back."""
    spark = docs.sparkSession
    base = base or new_path(spark, "tokens")
    return read_store(spark, base, write_store(docs, base, tokenizer, end_id, id_col, text_col))
