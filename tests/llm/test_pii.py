"""Personal data: base patterns against the patterns as they are written, the field against enumeration and held-out lines."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from whyframe.llm import pii
from whyframe.llm.pii import KINDS, Batch, Chain, Field
from whyframe.llm.pii_table import labelled_lines

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def checked(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(x) <= 255 for x in s.split("."))
    if kind == 2:
        doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if checked(k, m[0]))


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("0123459.. --+()@@aZ_%é٣\n"), max_size=60))
@example("a@b.c.d@e.f")
@example("1.2.3.4.5.6.7.8 .1.2.3.4. 001.002.003.256")
@example("+1 (884) 555-3918 63.51.224.77 4111 1111 1111 1111")
@example("4111111111111111" * 2)
@example("@a@b.c@.d x@y.z..w a@b")
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_written_kinds():
    for line, _ in labelled_lines(400, seed=9):
        assert pii.base_spans(line) == brute(line)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "a@" * 100_000, "1 " * 100_000, "+1" * 100_000, "+1" + " " * 200_000, "1.2.3.4 " * 20_000, "a@b.c " * 20_000, "x 1-" * 30_000])
def test_long_runs_take_linear_time(text):
    start = time.time()
    pii.base_spans(text)
    list(pii.chains(text))
    assert time.time() - start < 20


def small_chains(rng, n):
    return [Chain([(2 * i, 2 * i + 1) for i in range(k)], rng.integers(1, pii.SHAPES, k).tolist(), (rng.random(k) < 0.2).tolist()) for k in rng.integers(1, 5, n)]


def test_viterbi_and_sums_as_by_enumeration():
    rng = np.random.default_rng(4)
    own = small_chains(rng, 6)
    b = Batch.of(own)
    field = Field(rng.normal(size=(pii.SLOTS, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)))
    move, first = pii.allowed()
    e, got = field.scores(b), field.decode(b)
    labels, total = np.zeros(b.there.shape, dtype=np.int64), 0.0
    for i, c in enumerate(own):
        k = len(c.shapes)
        scores = {}
        for y in itertools.product(range(pii.LABELS), repeat=k):
            s = first[y[0]] + sum(e[i, t, y[t]] for t in range(k)) + sum(move[y[t - 1], y[t]] + field.moves[y[t - 1], y[t]] for t in range(1, k))
            if s > -1e8:
                scores[y] = s
        best = max(scores, key=scores.get)
        assert tuple(got[i, :k]) == best and not got[i, k:].any()
        labels[i, :k] = best
        total += scores[best] - np.log(sum(np.exp(s) for s in scores.values()))
    assert abs(pii.likelihood(field, b, labels)[0] - total) < 1e-6


def test_gradient():
    rng = np.random.default_rng(5)
    own = small_chains(rng, 4)
    b = Batch.of(own)
    labels = np.where(b.there & ~b.fixed, 1, 0)
    field = Field(rng.normal(size=(pii.SLOTS, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)))
    base, by_weight, by_move = pii.likelihood(field, b, labels)
    slot = int(b.slots[0, 0, 3])
    for matrix, gradient, at in ((field.weights, by_weight, (slot, 1)), (field.weights, by_weight, (slot, 0)), (field.moves, by_move, (1, 1)), (field.moves, by_move, (0, 1))):
        matrix[at] += 1e-5
        assert abs((pii.likelihood(field, b, labels)[0] - base) / 1e-5 - gradient[at]) < 1e-3
        matrix[at] -= 1e-5


@pytest.fixture(scope="module")
def field():
    return pii.fit(labelled_lines())


def test_held_out_lines(field):
    lines = labelled_lines(1200, seed=77)
    found, hits, there = [0] * 4, [0] * 4, [0] * 4
    for (_, spans), got in zip(lines, pii.found_spans([x for x, _ in lines], field)):
        want = {(a, KINDS.index(k), b) for k, a, b in spans}
        for k in range(4):
            found[k] += sum(s[1] == k for s in got)
            hits[k] += sum(s[1] == k for s in want & set(got))
            there[k] += sum(s[1] == k for s in want)
    assert all(h >= 0.98 * f for h, f in zip(hits, found)), (hits, found)
    assert all(h >= 0.9 * t for h, t in zip(hits, there)), (hits, there)


def test_added_spans(field):
    def told(text):
        return next(iter(pii.all_spans([text], field)))

    text = "los +1 (836) 555-9331 4913187196670932 53.121.55.90 que"
    base, spans = told(text)
    assert pii.written(base) == "ip:39:51" and [text[a:b] for a, _, b in spans] == ["+1 (836) 555-9331", "4913187196670932", "53.121.55.90"]
    assert pii.written(told("ruf jürgen@müller.de, an")[1]) == "email:4:20"
    for clean in ("on 2024-01-15 at 10:30 for $1,234.56", "pages 12-15 of 978-3-16-148410-0", "version 1.2.3 since 1999", "token = \"94188945874088f67dc02ebee7da32856e8cab6c30f\"", "no data here", "", "1 2 3 4 5 6 7 8 9 10 11 12"):
        assert told(clean) == ([], []), clean


def test_query(spark, field):
    rows = [(1, "a x@y.zz b +1 (836) 555-9331 4913187196670932 c"), (2, None), (3, ""), (4, "nothing\n1 and 2"), (5, "9" * 5000 + " é@ " + "word " * 5000 + "1.2.3.4"), (6, "x@y.zz"), (6, "x@y.zz"), (None, "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS spans", "'x' AS n_email").repartition(3)
    got = pii.personal_data(df, field, room=40)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    want = []
    for i, text in rows:
        base = brute(text or "")
        want.append((i, *[sum(s[1] == k for s in base) for k in range(4)], hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted(want, key=str)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].spans == "email:2:8,phone:11:28,card:29:45" and by_id[1].n_added == 2 and by_id[2].spans == "" and by_id[5].n_added == 0
    assert pii.personal_data(df.limit(0), field).collect() == []
