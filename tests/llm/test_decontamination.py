import random

import numpy as np

from whyframe.llm.decontamination import Items, benchmark_hits, decontaminate, normalised, passages

from .helpers import prose


def distance(a, b):
    """Edits that turn the whole of a into some substring of b (plain dynamic programme)."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def norm(text):
    return normalised(np.frombuffer(text.encode(), np.uint8))[0].tobytes().strip() if text else b""


def mangled(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        rng.choice([lambda: chars.pop(k), lambda: chars.insert(k, "q"), lambda: chars.__setitem__(k, "z")])()
    return "".join(chars)


def test_equals_plain_alignment(spark):
    rng = random.Random(1)
    items = [(k, " ".join(prose(rng, rng.randrange(12, 40)))) for k in range(8)]
    docs = []
    for k in range(80):
        text = items[rng.randrange(8)][1]
        inner = mangled(rng, text, rng.choice([0, 1, 3, int(0.08 * len(text)), int(0.2 * len(text))]))
        docs.append((k, " ".join(prose(rng, 30)) + " " + rng.choice([inner, inner.upper(), inner[: len(inner) // 2], ""]) + ". " + " ".join(prose(rng, 30))))
    got = {(r.doc_id, r.item_id) for r in benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    known = Items(items, 10, 0.08)
    want = {(d, i) for d, text in docs for i, item in items if distance(norm(item), norm(text)) <= known.edits[i]}
    assert got == want and len(want) > 20


def test_spans_and_blocks(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog tonight"), (2, "pack my box with five dozen liquor jugs, they said"), (3, "short"), (4, None), (None, "a nameless item of some length that stands in a text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = "Étude: The  quick, BROWN fox jumps over the lazy dog tonight! And é a nameless item of some length that stands in a text"
    docs = spark.createDataFrame([(7, text), (7, text), (8, None), (9, ""), (None, text), (10, "short and clean")], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS item_id", "3 AS start")
    for block in (8_000_000, 10):
        hits = benchmark_hits(docs, bench, block_chars=block).collect()
        assert [(r.doc_id, r.item_id, r.edits) for r in hits] == [(7, 1, 0)] * 2
        assert text[hits[0].start : hits[0].end] == "The  quick, BROWN fox jumps over the lazy dog tonight"
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["10", "8", "9"]
    assert decontaminate(docs, bench.where("false")).count() == 6
    assert benchmark_hits(docs, bench.where("false")).count() == 0 and benchmark_hits(docs.where("false"), bench).count() == 0


def test_passage_in_a_very_long_text():
    rng = random.Random(2)
    item = " ".join(prose(rng, 30))
    long = " ".join(prose(rng, 300_000)) + " " + item + " " + " ".join(prose(rng, 1000))
    text = normalised(np.frombuffer(long.encode(), np.uint8))[0]
    found = passages(text, Items([(5, item)], 10, 0.08))
    assert len(found) == 1 and found[0][3] == 0


def test_items_without_an_id_count_for_documents(spark):
    item = "a nameless item of some length that stands in a text"
    docs = spark.createDataFrame([(1, f"before it {item} and after it"), (2, "nothing of the sort")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (5, None)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate(docs, benchmark).collect()] == [2]
    assert benchmark_hits(docs, benchmark).count() == 0


def test_short_items_have_their_whole_budget(spark):
    """Items of 10 to 60 characters with floor(0.08 L) edits and with one more."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxy"
    items, docs = [], []
    for length in range(10, 61):
        text = "".join(rng.choice(letters) for _ in range(length))
        items.append((length, text))
        for extra in (0, 1):
            at = sorted(rng.sample(range(1, length - 1), int(0.08 * length) + extra))
            docs.append((2 * length + extra, "and so " + "".join("z" if i in at else c for i, c in enumerate(text)) + " then"))
    docs.append((1000, "and so copy thiz line ok then"))
    items.append((1000, "copy this line ok"))
    got = {(r.doc_id, r.item_id, r.edits) for r in benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i, distance(norm(item), norm(text))) for d, text in docs for i, item in items if distance(norm(item), norm(text)) <= int(0.08 * len(norm(item)))}
    assert got == want and {d for d, *_ in got} == {*range(20, 122, 2), 1000}


def every_find(item, text, e):
    """Edits of every end at which the item ends within e edits, by the plain dynamic programme."""
    best = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(best[j - 1] + (x != y), best[j] + 1, new[-1] + 1))
        best = new
    return {j: d for j, d in enumerate(best) if d <= e}


def test_repetitive_texts(spark):
    """Items and texts that repeat themselves: as many finds as fit, by the plain programme, whether bands or whole windows decide."""
    rng = random.Random(4)
    cases = [("a" * 60, "a" * 1000), ("ab" * 40, "ab" * 300 + "c" + "ab" * 200), ("the cat and " * 6, "the cat and " * 40 + "the dog or " * 20), ("x" * 30 + "y" * 30, "x" * 200 + "y" * 200), ("a" * 60, "".join(rng.choice("ab") for _ in range(400)) + "a" * 57 + "b" + "a" * 70)]
    for item, text in cases:
        items = Items([(1, item)], 10, 0.08)
        t, x = items.texts[0].tobytes(), norm(text)
        e, ends = int(items.edits[0]), every_find(items.texts[0].tobytes(), norm(text), int(items.edits[0]))
        got = sorted(passages(np.frombuffer(x, np.uint8), items), key=lambda f: f[2])
        assert all(ends[end] == edits == distance(t, x[start:end]) for _, start, end, edits in got), item
        assert all(p[2] <= q[1] for p, q in zip(got, got[1:]))
        # no end is left that could stand beside the finds
        assert all(any(a < j and j - len(t) - d < b for _, a, b, _ in got) for j, d in ends.items()), item
        if ends and min(ends.values()) == 0:
            assert any(edits == 0 for *_, edits in got) and e >= 0
    whole = passages(np.frombuffer(b"a" * 12_000, np.uint8), Items([(1, "a" * 600)], 10, 0.08))
    assert sorted((a, b, d) for _, a, b, d in whole) == [(600 * k, 600 * k + 600, 0) for k in range(20)]


def test_long_repetitive_text_is_bounded():
    import tracemalloc

    items = Items([(k, c * 600) for k, c in enumerate("abc")], 10, 0.08)
    tracemalloc.start()
    found = passages(np.frombuffer(b"a" * 100_000, np.uint8), items)
    assert tracemalloc.get_traced_memory()[1] < 500_000_000
    tracemalloc.stop()
    assert len(found) == 100_000 // 600
