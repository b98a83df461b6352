import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from whyframe.llm import licences, toxicity
from whyframe.llm.licence_texts import NAMES, templates

from .helpers import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    insults = ["blorgface", "snarkwit", "grumblethud"]
    docs, labels = [], []
    for k in range(400):
        words = prose(rng, rng.randrange(5, 120), 300)
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "!", "s", "ing"]))
        docs.append((k, " ".join(words)))
        if k < 300:
            labels.append((k, int(rng.random() < 0.8), int(toxic)))
    truth = {k: any(i in t for i in insults) for k, t in docs}
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_unlabelled_accuracy(labelled):
    docs, labels, truth = labelled
    chain = toxicity.fit_chain(docs, labels, toxicity.label_categories(), "toxic")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, chain).collect()}
    fresh = range(300, 400)
    assert np.mean([got[i].toxic == truth[i] for i in fresh]) >= 0.97
    assert all(0 <= got[i][c] <= 1 for i in got for c in ("p_poor", "p_toxic", "p_toxic_and_poor"))
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].toxic}
    # one by one, without the batch code
    texts = {r.doc_id: r.text for r in docs.collect()}
    import pyarrow as pa

    for i in list(fresh)[:10]:
        ((_, slots),) = toxicity.features_of(pa.array([texts[i]]))
        p = []
        for m in chain.models:
            z = m.bias + sum(w * e for w, e in zip(m.chain, p)) + sum(w for s, w in zip(m.slots, m.weights) if s in set(slots.tolist()))
            p.append(1 / (1 + np.exp(-z)))
        assert abs(p[1] - got[i].p_toxic) < 1e-9


def test_sample_is_bounded(labelled):
    docs, labels, _ = labelled
    chain = toxicity.fit_chain(docs, labels, toxicity.label_categories(), "toxic", per_class=20)
    assert len(chain.models) == 3


def test_odd_rows(spark, labelled):
    docs, labels, _ = labelled
    chain = toxicity.fit_chain(docs.unionByName(docs.limit(3)), labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)), toxicity.label_categories(), "toxic")
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "w1 blorgface"), (3, "w1"), (3, "w1"), (4, "w2 " * 200_000 + "snarkwit")], "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS id", "3 AS slots")
    got = toxicity.score_toxicity(odd, chain).collect()
    assert len(got) == 6 and {str(r.doc_id) for r in got if r.toxic} == {"None", "4"}
    none = toxicity.fit_chain(docs, labels.where("toxic = 0"), toxicity.label_categories(), "toxic")
    assert {r.toxic for r in toxicity.score_toxicity(docs, none).collect()} == {False}
    assert toxicity.score_toxicity(odd.where("false"), chain).count() == 0
    unmet = toxicity.fit_chain(docs.where("false"), labels, toxicity.label_categories(), "toxic")
    assert {r.toxic for r in toxicity.score_toxicity(docs, unmet).collect()} == {False}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    return licences.fit_licences([" ".join(prose(rng, 40)) for _ in range(400)])


LINES = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary", "Our page is available under the CC BY-SA 4.0 license": "cc-by-sa"}


def test_families(spark, model):
    rng = random.Random(3)
    rows = [(k, "\n".join([" ".join(prose(rng, 20)) + ".", line, " ".join(prose(rng, 20))])) for k, line in enumerate(LINES)]
    rows += [(50, "He renewed his driving license at the hall."), (51, " ".join(prose(rng, 300)))]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {k: got[k].family for k in range(len(LINES))} == dict(enumerate(LINES.values()))
    assert all(got[k].confirmed and got[k].paragraph == 1 for k in range(len(LINES)))
    assert 50 not in got and 51 not in got


def test_dataframe_path_equals_plain_scoring(spark, model):
    """Every paragraph, those without cue words included, against the plain formula."""
    rng = random.Random(4)
    pool = [n for names in NAMES.values() for n in names] + ["license", "terms of the", "public", "free", "w1 w2", "Version 2"]
    texts = [" ".join(rng.choice(pool + ["w5", "w6 the"]) for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    got = {(r.doc_id, r.paragraph): r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        p = model.probabilities(text)
        best = max(sorted(p), key=p.get)
        assert ((k, 0) in got) == (best != licences.PLAIN), text
        if best != licences.PLAIN:
            assert abs(got[(k, 0)].probability - p[best]) < 1e-6
            words = re.findall("[a-z0-9]+", text.lower())
            own = {*words, *map(" ".join, zip(words, words[1:]))}
            shares = [0.0]
            for template in templates().get(best, []):
                t = re.findall("[a-z0-9]+", template.lower())
                pairs = {*map(" ".join, zip(t, t[1:]))} or {*t}
                shares.append(len(pairs & own) / len(pairs))
            assert abs(got[(k, 0)].template_similarity - max(shares)) < 1e-9
            assert got[(k, 0)].family == (best if max(shares) >= 0.8 or p[best] >= model.surety and max(shares) >= 0.5 else licences.UNKNOWN)
            assert got[(k, 0)].confirmed == (best != licences.UNKNOWN and max(shares) >= 0.8)


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
STRANGERS = [
    "Licensed under the Eclipse Public License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "Do What The Fuck You Want To Public License, Version 2",
    "Released under the Artistic License 2.0.",
]


def test_wrapped_texts_and_unseen_families(spark, model):
    texts = [MIT_TEXT, BSD_TEXT, "Title\n" + MIT_TEXT + "\n\nThe end", *STRANGERS]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [(got[k].family, got[k].confirmed, got[k].paragraph) for k in range(3)] == [("mit", True, 0), ("bsd", True, 0), ("mit", True, 1)]
    assert [got[k].family for k in range(3, len(texts))] == [licences.UNKNOWN] * len(STRANGERS)


def test_paragraphs(spark):
    text = "Short line\n" + "a long line that goes on and on until it wraps\nhere. \nNext\n\nLast one is long enough to be wrapped, or so\n \nx"
    got = spark.createDataFrame([(text,)], "t string").select(F.split("t", licences.PARAGRAPHS, -1)).first()[0]
    assert [p for p in got if p] == ["Short line", "a long line that goes on and on until it wraps\nhere.", "Next", "Last one is long enough to be wrapped, or so", "x"]


def test_no_python_on_the_way(spark, model):
    df = licences.scan_licences(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))


def test_odd_documents(spark, model):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (None, "All rights reserved."), (4, "All rights reserved."), (4, "All rights reserved."), (5, "w " * 300_000 + ".\nReleased under the MIT License.")], "doc_id long, text string").selectExpr("*", "1 AS p", "2 AS words", "3 AS best", "4 AS total")
    got = sorted((str(r.doc_id), r.family) for r in licences.scan_licences(odd, model).collect())
    assert got == [("4", "proprietary"), ("4", "proprietary"), ("5", "mit"), ("None", "proprietary")]
    assert licences.scan_licences(odd.where("false"), model).count() == 0
    assert licences.plain_paragraphs(odd, 10) == sorted({"w " * 300_000 + "."})


def test_the_chain_is_fitted_outside_the_driver(spark, monkeypatch):
    """The sample stays with the executors; only weights come back."""
    docs = spark.createDataFrame([(i, "vile word here" if i % 2 else "kind word there") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 // 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(type(docs), "toArrow", lambda self: pytest.fail("the sample came to the driver"))
    chain = toxicity.fit_chain(docs, labels, toxicity.label_categories(), "toxic")
    assert len(chain.models) == 3
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(docs, chain).collect()}
    assert got == {i: i % 2 == 1 for i in range(40)}


def test_the_fit_holds_its_sample_once():
    """Rows in any order and over several batches, some repeated; Arrow copies none of their slots."""
    rng = np.random.default_rng(3)
    n = 240
    slots = [np.unique(rng.integers(0, 1 << toxicity.BITS, 4000)).astype(np.int32).tobytes() for _ in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids), pa.array([slots[i] for i in ids], pa.binary()), pa.array([i % 2 for i in ids], pa.int32())], ["id", "slots", "toxic"]) for ids in (list(range(n - 1, 90, -1)), list(range(120)))]
    table, before = pa.Table.from_batches(batches), pa.default_memory_pool()
    pool = pa.proxy_memory_pool(before)
    pa.set_memory_pool(pool)
    try:
        models, _ = toxicity._fit(table, ["toxic"], "toxic", {0: n // 2, 1: n // 2})
    finally:
        pa.set_memory_pool(before)
    assert len(models) == 1 and pool.max_memory() < table.nbytes / 10
