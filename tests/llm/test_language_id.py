import random

import numpy as np

from whyframe.llm.language_id import MAX_LANGUAGES, document_slots, identify, identify_held_out, train
import pyarrow as pa
import pytest

SYLLABLES = {"aa": "ba ke lo mi ru".split(), "bb": "sch ung ver ein tz".split(), "cc": "ción que los ar ñe".split()}


def corpus(n=240, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((k, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in identify_held_out(df).collect()}
    lang = {i: x for i, _, x in rows}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 20 and np.mean([got[i].lang_pred == lang[i] for i in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_equals_plain_bayes(spark):
    """The vectorised scores equal sums over the same slots, one by one."""
    rows = corpus(60, 3)
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), orders=(2, 3), bits=10)
    texts = [t for _, t, _ in rows[:20]] + ["x"]
    names, scores = model.predict(pa.array(texts))
    for k, text in enumerate(texts):
        ((_, _, slots, _),) = document_slots(pa.array([text]), (2, 3), 10)
        z = model.prior + sum((model.matrix[s].sum(axis=0) for s in slots), np.zeros(len(model.languages)))
        p = np.exp(z - z.max())
        assert names[k] == model.languages[int(np.argmax(z))] and abs(scores[k] - 1 / p.sum()) < 1e-9


def test_equals_a_count_of_characters(spark):
    """Counts and scores from scratch, by n-grams as texts; 22 bits keep these few apart."""
    from collections import Counter
    from math import exp, log

    rows = corpus(60, 4) + [(900, "日本語 の ruñe", "dd"), (901, "BA ba", "dd"), (902, "", "aa")]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    grams = lambda t: Counter(t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1))
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), bits=22)
    names = sorted({x for _, _, x in rows})
    counts = {x: sum((grams(low(t)) for _, t, y in rows if y == x), Counter()) for x in names}
    total, documents = {x: sum(c.values()) for x, c in counts.items()}, Counter(x for *_, x in rows)
    texts = [t for _, t, _ in rows[::7]] + ["語", "ruñe que", "xyz" * 100_000]
    got, scores = model.predict(pa.array(texts))
    for text, name, score in zip(texts, got, scores):
        z = {x: log(documents[x] / len(rows)) + sum(k * (log(counts[x][g] + 0.5) - log(total[x] + 0.5 * 2**22)) for g, k in grams(low(text)).items()) for x in names}
        best = max(names, key=z.get)
        assert name == best and abs(score - 1 / sum(exp(v - z[best]) for v in z.values())) < 1e-6


def test_ties_go_to_the_first_language(spark):
    model = train(spark.createDataFrame([(1, "abc", "yy"), (2, "abc", "xx")], "doc_id long, text string, lang string"))
    names, scores = model.predict(pa.array(["abc", "q"]))
    assert names == ["xx", "xx"] and np.allclose(scores, 0.5)


def test_odd_rows(spark):
    rows = [(1, "", "aa"), (2, None, "aa"), (3, "12 .,!", "bb"), (None, "bake lomi", "aa"), (5, "bake lomi", None), (6, "schung ver", "bb"), (7, "ré", "aa"), (7, "ré", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS chunk", "2 AS score", "'x' AS lang_pred")
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in identify_held_out(df).collect())
    assert len(got) == 8 and {g[0]: g[1] for g in got if g[1] == "und"}.keys() >= {"1", "2", "3"}
    assert all(s == 0 for _, p, s in got if p == "und")
    empty = identify_held_out(df.where("false"))
    assert empty.count() == 0
    unlearned = identify(df, train(df.where("false")))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_too_many_languages(spark):
    df = spark.createDataFrame([(k, "a", f"l{k}") for k in range(MAX_LANGUAGES + 1)], "doc_id long, text string, lang string").coalesce(1)
    with pytest.raises(ValueError):
        train(df, orders=(1,), bits=4)
