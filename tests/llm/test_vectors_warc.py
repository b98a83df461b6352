import gzip
import random

import numpy as np

from whyframe.llm import warc
from whyframe.llm.embedding_dedup import Forest, embedding_near_duplicates, tile_links

from .helpers import closure


def brute(rows, threshold):
    ok = {}
    for i, v, label in rows:
        good = i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok[i] = (np.array(v, dtype=float), label) if good else None
    links = []
    ids = sorted(k for k in ok if k is not None)
    for a in ids:
        for b in ids:
            if a < b and ok[a] and ok[b] and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]):
                x, y = ok[a][0], ok[b][0]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((a, b))
    comp = closure(ids, links)
    return {i: (sum(i in e for e in links), comp[i], comp[i] == i) for i in ids}


def vectors(seed=1, n=260, width=12):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base * rng.uniform(0.5, 2) + rng.normal(size=width) * rng.choice([0, 0.02, 0.1, 0.2]) * np.linalg.norm(base) / np.sqrt(width)
        else:
            v = rng.normal(size=width)
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3)) if rng.random() < 0.95 else None))
    rows += [(900 + k, rows[0][1], rows[0][2] or 0) for k in range(30)]
    return rows


def test_equals_brute_force(spark):
    rows = vectors()
    rows += [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [float("nan")] * 12, 1), (2003, [float("inf")] + [1.0] * 11, 1), (2004, [None] + [1.0] * 11, 1), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [1e200] * 12, 2), (2009, [1.0] * 12, 2), (None, [1.0] * 12, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    for tile in (16, 1024):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(df.selectExpr("*", "1 AS tile", "2 AS rep", "3 AS id"), 0.98, tile).collect()}
        assert got == brute(rows, 0.98)
    assert embedding_near_duplicates(df.where("false")).count() == 0


def test_pruned_products_lose_nothing():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 20)) * np.linspace(3, 0.1, 20)
    y = np.concatenate([x[:100] + rng.normal(size=(100, 20)) * 0.05, rng.normal(size=(150, 20)) * np.linspace(3, 0.1, 20)])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(i, j) for p, q in tile_links(unit(x), unit(y), x, y, 0.98) for i, j in zip(p.tolist(), q.tolist())}
    i, j = np.nonzero(unit(x) @ unit(y).T >= 0.98)
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) > 50


def test_forest_spans():
    rng = random.Random(3)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(90)]
    links = [(a, b) for a, b in links if a != b]
    forest = Forest(80)
    for at in range(0, len(links), 20):
        a, b = zip(*links[at : at + 20])
        forest.add(np.array(a), np.array(b))
    assert closure(range(80), forest.links) == closure(range(80), links)
    assert len(forest.links) == 80 - len(set(closure(range(80), links).values()))


def pages():
    rng = random.Random(5)
    rows = [(k, f"http://x/{k}", "".join(rng.choice("abc<>é\n") for _ in range(rng.randrange(0, 3000)))) for k in range(60)]
    rows += [(100 + k, "http://y/\r\nWARC-Type: fake", rows[k][2]) for k in range(10)] + [(200, None, None), (201, "u", ""), (202, "u", None), (None, "u", "lost")]
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "\x1f\x8b\x08" * 20
    return rows + [(300, "t", tricky), (301, "t", tricky), (302, "z", "long " * 200_000)]


def test_round_trip_at_any_split(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS payload", "3 AS sha").repartition(3)
    archives = warc.write_archives(df, f"file://{tmp_path}/w")
    first = {}
    for i, _, html in sorted(r for r in rows if r[0] is not None):
        first.setdefault(html or "", i)
    want = {i: (len((html or "").encode()), warc.digest((html or "").encode()), "response" if first[html or ""] == i else "revisit", None if first[html or ""] == i else first[html or ""]) for i, _, html in rows if i is not None}
    for split in (700, 5_000, 1 << 20):
        got = warc.read_archives(spark, archives, split).collect()
        assert len(got) == len(want)
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
        texts = {i: html or "" for i, _, html in rows}
        assert all(r.payload.decode() == texts[r.page_id] for r in got if r.record_type == "response")
    for path, _ in archives:  # ordinary tools read them
        data = gzip.open(path.removeprefix("file://")).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    assert warc.archive_pages(df.where("false"), f"file://{tmp_path}/e").count() == 0
    small = warc.archive_pages(df, f"file://{tmp_path}/s", least_bytes=10**9).select("record_type").distinct().collect()
    assert [r[0] for r in small] == ["response"]


def test_magic_inside_data_is_no_member(tmp_path):
    record = warc.record_bytes(1, "u", b"x", None, "2024-01-01T00:00:00Z")
    junk = b"\x1f\x8b\x08" + b"no gzip here" + gzip.compress(b"not an archive") + b"\x1f\x8b"
    data = junk + warc.member(record) + junk + warc.member(record)
    path = tmp_path / "f"
    path.write_bytes(data)
    with open(path, "rb") as f:
        assert [m == record for m in warc.members(f, 0, len(data))] == [True, True]


def test_any_number_of_lengths(spark):
    """Copies of every length, and vectors that only zeros at the end tell apart."""
    rng = np.random.default_rng(8)
    rows = []
    for width in range(1, 71):
        v = rng.normal(size=width).tolist()
        rows += [(len(rows), v, 1), (len(rows) + 1, [2 * x for x in v], 1), (len(rows) + 2, [-x for x in v], 1)]
    rows += [(900, [1.0, 2.0], 2), (901, [1.0, 2.0, 0.0], 2), (902, [1.0, 2.0, 0.0, 0.0], 2), (903, [1.0, 2.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(df, 0.98).collect()}
    assert got == brute(rows, 0.98)
