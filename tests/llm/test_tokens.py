import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from whyframe.llm import packing, token_store  # noqa: E402
from whyframe.llm.perfect_hash import PerfectHash  # noqa: E402
from whyframe.llm.tokenizing import Encoder  # noqa: E402

from .helpers import prose  # noqa: E402

ODD = ["", "a", "\n", " a b", "a  b", "a\tb c", "a\n\nb", "x y z", "don't we'll STOP... now!!", "<|endoftext|> a <|endoftext|>b", "Straße über İstanbul ΣΑΣ.", "é é. q", "12 345 a1b2 x_y", "日本 語。", "a\n.b c\n\tz", "wait,. ok;: 's 't", "À.\nß, ÿ", "a b", "a\x1cb", "tail ", "Ⅷ ½ ﬁ", "a\r\nb"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(name):
    enc = Encoder(P.path(name), room=60)  # a tiny table, so that generations change
    plain = tokenizers.Tokenizer.from_file(P.path(name))
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["Word", "and", "x,", "y.", "(z)", "é", "\n"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    for text, data in zip(texts, enc.packed(texts)):
        assert np.frombuffer(data, enc.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    table = PerfectHash.build(keys)
    assert sorted(table.index(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], dtype=np.uint64))


def documents(spark):
    rng = random.Random(4)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, " ".join(prose(rng, rng.randrange(1, 1500)))) for k in range(60)] + [(500, None), (None, "lost"), (501, "twin"), (501, "twin"), (501, "other"), (-7, "first")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS tie", "3 AS shard").repartition(5)


def test_store_round_trip(spark, tmp_path):
    rows, df = documents(spark)
    plain = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    base = f"file://{tmp_path}/store"
    manifest = token_store.write_store(df, base, P.path("word_bpe_49k.json"), 2, shards=4)
    got = token_store.read_store(spark, base, manifest).collect()
    assert len(got) == len(rows) - 1 and sum(n for _, n, _ in manifest) == len(got)
    starts = {}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        starts.setdefault(r.doc_id, []).append(r)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _ in rows if i is not None)
    for i, text in rows:
        if i is None:
            continue
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert any(r.n_tokens == len(ids) and r.ids_crc32 == crc for r in starts[i])
    shard = token_store.Shard(base, manifest[0][0])
    assert shard.read(-7).tolist() == plain.encode("first", add_special_tokens=False).ids + [2]
    assert shard.read(10**9) is None and shard.find(np.array([10**9, -7]))[0][0] == -1


def test_one_id_over_several_shards(spark, tmp_path):
    rng = random.Random(6)
    rows = [(5, " ".join(prose(rng, 8))) for _ in range(400)] + [(k, f"text {k}") for k in (-2, 1, 4, 6, 9)] + [(9, "again")]
    base, path = f"file://{tmp_path}/s", P.path("word_bpe_49k.json")
    manifest = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), base, path, 2, shards=4)
    store, plain = token_store.TokenStore(base), tokenizers.Tokenizer.from_file(path)
    assert len(manifest) > 1 and sum(s["low"] <= 5 <= s["high"] for s in store.shards) > 1
    ids = lambda t: (*plain.encode(t, add_special_tokens=False).ids, 2)
    assert sorted(tuple(store.get(5, k).tolist()) for k in range(400)) == sorted(ids(t) for i, t in rows if i == 5)
    assert [store.get(5, 400), store.get(7), store.get(-3), store.get(10), store.get(4, 1)] == [None] * 5
    assert tuple(store.get(-2).tolist()) == ids("text -2") and {tuple(store.get(9, k).tolist()) for k in (0, 1)} == {ids("text 9"), ids("again")}


def test_very_long_text(spark, tmp_path):
    rng = random.Random(7)
    text, path = " ".join(prose(rng, 150_000)), P.path("word_bpe_49k.json")
    base = f"file://{tmp_path}/long"
    token_store.write_store(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), base, path, 2, shards=2)
    assert token_store.TokenStore(base).get(1).tolist() == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [2]


def test_a_shard_is_written_once(spark, tmp_path, monkeypatch):
    done, plain = spark.sparkContext.accumulator(0), token_store.packed_documents
    data = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string").repartition(3)

    def counted(batch, *rest):
        done.add(batch.num_rows)
        return plain(batch, *rest)

    monkeypatch.setattr(token_store, "packed_documents", counted)
    token_store.write_store(data, f"file://{tmp_path}/once", P.path("word_bpe_49k.json"), 2, shards=4)
    assert done.value == 50


def test_empty_store(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.store_documents(empty, P.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/e").count() == 0


def test_packing(spark):
    rows, df = documents(spark)
    path, capacity = P.path("byte_bpe_50k.json"), 256
    plain = tokenizers.Tokenizer.from_file(path)
    packed = packing.pack_documents(df, path, 0, capacity).collect()
    want = {}
    for i, text in rows:
        if i is not None:
            want.setdefault(i, []).append(plain.encode(text or "", add_special_tokens=False).ids + [0])
    by_doc, by_seq = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in want[r.doc_id])
    for i, texts in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, texts))
        assert all(r.length == capacity for r in by_doc[i] if r.piece > 0)
        if len(texts) == 1:
            assert len(by_doc[i]) == -(-len(texts[0]) // capacity)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in packed)
    assert len(by_seq) <= 1.02 * -(-total // capacity) + 1
    unique = df.where("doc_id < 500 AND doc_id >= 0")
    sequences = packing.sequence_tokens(unique, packing.pack_documents(unique, path, 0, capacity), path, 0, capacity).collect()
    assert sum(len(r.ids) for r in sequences) == sum(len(t) for i, ts in want.items() if 0 <= i < 500 for t in ts)
    assert packing.pack_documents(df.where("false"), path).count() == 0


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(3)
    for capacity in (8, 64, 512):
        h = np.zeros(capacity + 1, dtype=np.int64)
        h[1:] = rng.integers(0, 40, capacity) * (rng.random(capacity) < 0.6)
        used = np.zeros_like(h)
        for lengths, repeats in packing.plan_packing(h):
            assert sum(lengths) <= capacity and repeats > 0
            for v in lengths:
                used[v] += repeats
        assert (used == h).all()
        ours, plain = (sum(n for _, n in p) for p in (packing.plan_packing(h), packing.best_fit(h)))
        assert ours <= 1.01 * plain + 1
    assert packing.plan_packing(np.zeros(9, dtype=np.int64)) == []
