import random
import re

import numpy as np
import pytest

from whyframe.llm.graph import components, merge_components
from whyframe.llm.ngram_join import _pack, _unpack, keep_one_of_each_group, needed, ngram_jaccard_join

from .helpers import closure, edited, prose

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, n, percent):
    sets = {}
    for i, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in closure(ids, links).items()}


def corpus(seed=1):
    rng, docs = random.Random(seed), []
    common = prose(rng, 60)
    for family in range(8):
        base = prose(rng, rng.randrange(5, 300))
        for _ in range(rng.choice([1, 2, 5, 12])):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0.004, 0.01, 0.03, 0.05]))))
    docs += [" ".join(common + prose(rng, 200)) for _ in range(15)]
    docs += ["", None, " \t\n", "one", "ONE", "one two", "One  Two\n", "a b c d", "a b c d e", "É é", "é É"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_equals_brute_force(spark, n, percent):
    docs = corpus(n)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, n, percent).collect()}
    assert got == brute(docs, n, percent)


def test_hot_family_and_hot_passage(spark):
    rng = random.Random(7)
    base, passage = prose(rng, 150), prose(rng, 40)
    docs = [" ".join(edited(rng, base, 0.005)) for _ in range(120)] + [" ".join(passage + prose(rng, 100)) for _ in range(120)] + ["same text over and over again"] * 100
    docs = list(enumerate(docs))
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(docs, 4, 85)


def test_a_chain_of_links_is_one_component(spark):
    words = [f"c{i}" for i in range(400)]
    docs = [(k, " ".join(words[k * 8 : k * 8 + 200])) for k in range(20)]
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(docs, 4, 85) and len({c for _, c in got.values()}) == 1


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f"), (3, None)], "doc_id long, text string").selectExpr("*", "text AS id", "1 AS bucket", "2 AS component", "3 AS n_shingles")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(odd).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3)}
    kept = keep_one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None"]


def test_long_text(spark):
    rng = random.Random(3)
    long = " ".join(prose(rng, 120_000, 10**6))
    got = {r.id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame([(1, long), (2, long + " tail"), (3, "x y z")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(50)]
    want = closure({x for e in links if e[0] != e[1] for x in e}, links)
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    assert {r.id: r.component for r in components(df).collect()} == want
    first, second = spark.createDataFrame(links[:120], "a long, b long"), spark.createDataFrame(links[120:], "a long, b long")
    assert {r.id: r.component for r in merge_components(merge_components(None, first), second).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_and_bounds():
    x = np.random.default_rng(1).integers(0, 2**40, 99, dtype=np.uint64)
    assert (_unpack(_pack(x)) == x).all() and len(_pack(x)) == 5 * 99
    assert needed(np.array([1, 20, 100, 101]), 85).tolist() == [1, 17, 85, 86]
