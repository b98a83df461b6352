"""Licence scans with a trained paragraph classifier, in DataFrame functions alone.

A sparse multinomial logistic regression over word 1- and 2-grams tells licence
families, an unknown licence and plain text apart. Every n-gram of the model
holds a cue word, one that plain paragraphs hardly have; a paragraph without
cue words therefore has no features and is plain, which a set lookup settles.
The unknown class is trained on the bundled wording without what tells its
family: names without the words that few families have, notices without their
word order. Probabilities are calibrated with a temperature on held-out folds,
cut by text. A predicted family is confirmed if a template of it stands in the
paragraph by ``confirm`` of its word pairs. Without that it is kept only if it
is surer than families that a model has never seen come out and by ``refute``
of the pairs at least; other licences are ``unknown``.

Paragraphs end at blank lines and at short lines (under 40 characters) or lines
that end a sentence; longer lines are taken as wrapped and joined with the next.

Scanning is one pass over whole texts without a shuffle. Fitting happens in the
driver on bundled wording and on the paragraphs of at most ``plain_documents``
documents, those with the smallest hash of their id.

Defined results: null and empty texts and blank paragraphs have no row. Rows
with a null id have rows with a null id; repeated documents each have their
own. Ties between families go to the first in alphabetical order. Extra columns
are ignored.
"""

from __future__ import annotations

import json
import re
from itertools import pairwise
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, bounded_sample
from .licence_texts import PROSE, examples, templates, unknown_examples

PLAIN = "plain"
UNKNOWN = "unknown"
SPLIT = "[^a-z0-9]+"
#: Line breaks that end a paragraph: after a sentence or a short line, and blank lines.
PARAGRAPHS = r"(?<=[.!?:;])[ \t\r]*\n|\n[ \t\r]*\n|\n(?<=(?:^|\n)[^\n]{0,39}\n)"


def _words(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.lower()) if w]


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in pairwise(words))}


class LicenceModel:
    def __init__(self, classes: list[str], cues: list[str], weights: dict[str, list[float]], bias: list[float], temperature: float, surety: float):
        self.classes, self.cues, self.weights, self.bias, self.temperature, self.surety = classes, cues, weights, bias, temperature, surety

    def probabilities(self, text: str) -> dict[str, float]:
        """The same as the DataFrame path, for one paragraph."""
        words = _words(text)
        score = np.array(self.bias)
        for g in _grams(words) & self.weights.keys():
            score = score + np.array(self.weights[g])
        score = np.round(score, 9)  # sums in any order tie alike
        p = np.exp((score - score.max()) / self.temperature)
        return dict(zip(self.classes, p / p.sum()))


def _fit(rows: list[set[str]], y: np.ndarray, names: list[str], k: int, l1: float = 2e-4, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by proximal gradient with momentum: (weights, bias)."""
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), dtype=np.float32)
    for i, row in enumerate(rows):
        x[i, [at[g] for g in row if g in at]] = 1
    target = np.eye(k, dtype=np.float32)[y]
    share = 1.0 / np.maximum(target.sum(axis=0), 1)
    importance = (target @ share)[:, None] / k
    w, bias, vw, vb = np.zeros((len(names), k), np.float32), np.zeros(k, np.float32), np.zeros((len(names), k), np.float32), np.zeros(k, np.float32)
    rate = 4.0
    for _ in range(steps):
        z = x @ w + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        slope = (p / p.sum(axis=1, keepdims=True) - target) * importance
        vw, vb = 0.9 * vw - rate * (x.T @ slope), 0.9 * vb - rate * slope.sum(axis=0)
        w = w + 0.1 * vw
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * rate * l1, 0)
        bias = bias + 0.1 * vb
    return w, bias


def plain_paragraphs(docs: DataFrame, documents: int, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Paragraphs of a bounded sample of documents that mention no licence."""
    text = F.col(f"`{text_col}`").cast("string")
    few = bounded_sample(docs.select(as_id(id_col).alias("id"), text.alias("text")), F.col("id"), documents)
    lines = few.select(F.explode(F.split("text", PARAGRAPHS, -1)).alias("p")).where("trim(p) <> ''")
    return sorted({r.p for r in lines.where(~F.lower("p").rlike("licen[sc]|copyright|rights reserved|public domain|creative commons|gnu ")).collect()})


def fit_licences(plain: list[str], vocabulary: int = 1500) -> LicenceModel:
    known = examples() + unknown_examples()
    prose = PROSE * max(3, len(plain) // len(PROSE))  # prose that names licences weighs as much as all other
    texts = [t for _, t in known] + prose + plain
    rows = [_grams(_words(t)) for t in texts]
    labels = [f for f, _ in known] + [PLAIN] * (len(texts) - len(known))
    classes = sorted(set(labels))
    y = np.array([classes.index(c) for c in labels])
    background = rows[len(known) + len(prose) :]
    seen: dict[str, int] = {}
    for row in background:
        for g in row:
            seen[g] = seen.get(g, 0) + 1
    rare = max(1, len(background) // 200)
    lead: dict[str, int] = {}
    for row in rows[: len(examples())]:
        for g in row:
            lead[g] = lead.get(g, 0) + 1
    cues = {g for g in lead if " " not in g and len(g) > 1 and not g.isdigit() and seen.get(g, 0) <= rare}
    fit_names = sorted((g for g in lead if any(w in cues for w in g.split(" "))), key=lambda g: (-lead[g], g))[:vocabulary]
    fold = np.array([crc32(t.lower().encode()) % 5 for t in texts])  # repeats of a text share a fold
    held, truth = [], []
    for f in range(2):  # two of five folds calibrate the temperature
        w, b = _fit([rows[i] for i in np.flatnonzero(fold != f)], y[fold != f], fit_names, len(classes))
        held += [_scores(rows[i], fit_names, w, b) for i in np.flatnonzero(fold == f)]
        truth += y[fold == f].tolist()
    held, truth = np.array(held), np.array(truth)
    temperature = float(min(np.geomspace(0.2, 5, 33), key=lambda t: _loss(held / t, truth)))
    families = [c for c in classes if c not in (PLAIN, UNKNOWN)]
    unseen = []
    for group in range(3):  # families that a model has never seen
        out = {classes.index(c) for c in families[group::3]}
        inside = np.array([c not in out for c in y])
        w, b = _fit([rows[i] for i in np.flatnonzero(inside)], y[inside], fit_names, len(classes))
        b = b.copy()
        b[list(out)] = -50
        unseen += [_scores(rows[i], fit_names, w, b) for i in np.flatnonzero(~inside)]
    named = [classes.index(c) for c in families]
    sure = lambda s: _softmax(np.array(s) / temperature)[:, named].max(axis=1)
    right = sure(held[(held.argmax(axis=1) == truth) & np.isin(truth, named)])
    strange = sure(unseen)
    surety = float(max(np.linspace(0.3, 0.99, 70), key=lambda u: 2 * (right >= u).mean() + (strange < u).mean()))
    w, b = _fit(rows, y, fit_names, len(classes))
    weights = {g: [round(float(v), 5) for v in w[i]] for i, g in enumerate(fit_names) if np.abs(w[i]).max() > 1e-3}
    used = {word for g in weights for word in g.split(" ") if word in cues}
    return LicenceModel(classes, sorted(used), weights, [float(v) for v in b], temperature, surety)


def _scores(row: set[str], names: list[str], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    own = [i for i, g in enumerate(names) if g in row]
    return w[own].sum(axis=0) + b


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _loss(z: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(z)), truth] + 1e-12).mean())


def _once(df: DataFrame, *named) -> DataFrame:
    """Add columns that later expressions read without evaluating them again, inside lambdas as well."""
    names, values = named[::2], named[1::2]
    row = F.array(F.struct(*[v.alias(n) for n, v in zip(names, values)]))
    return df.select(*[c for c in df.columns if c not in names], F.inline(row))


def scan_licences(docs: DataFrame, model: LicenceModel, confirm: float = 0.8, refute: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, template_similarity, confirmed) of every licence paragraph; paragraphs count from 0."""
    lit = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    weights = lit(model.weights, "map<string,array<double>>")  # at most `vocabulary` entries
    bias = F.array(*[F.lit(float(b)) for b in model.bias])
    classes = F.array(*[F.lit(c) for c in model.classes])
    paragraphs = docs.select(as_id(id_col).alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), PARAGRAPHS, -1)).alias("paragraph", "p"))
    worded = paragraphs.select("doc_id", "paragraph", F.split(F.lower("p"), SPLIT, -1).alias("words"))
    cued = worded.where(F.exists("words", lambda w: w.isin(model.cues)))
    words = F.filter("words", lambda w: w != "")
    cued = cued.select("doc_id", "paragraph", words.alias("words"))
    pairs = F.transform(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat(F.get("words", i), F.lit(" "), w))
    grams = _once(cued, "words", F.col("words"), "pairs", F.array_distinct(pairs))
    in_model = F.filter(F.array_distinct(F.concat("words", "pairs")), lambda g: g.isin(sorted(model.weights)))
    grams = _once(grams, "grams", in_model)
    scores = F.aggregate("grams", bias, lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
    scored = _once(grams, "scores", F.transform(scores, lambda s: F.round(s, 9)))
    scored = _once(scored, "top", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.exp((s - F.col("top")) / model.temperature))
    scored = _once(scored, "total", total, "best", F.element_at(classes, F.array_position("scores", F.col("top")).cast("int"))).where(F.col("best") != PLAIN)
    scored = scored.withColumn("probability", 1.0 / F.col("total"))
    known = {f: [sorted({f"{a} {b}" for a, b in pairwise(_words(t))} or {*_words(t)}) for t in ts] for f, ts in templates().items()}
    own = F.element_at(lit(known, "map<string,array<array<string>>>"), F.col("best"))
    share = F.aggregate(own, F.lit(0.0), lambda best, t: F.greatest(best, F.size(F.array_intersect(t, F.concat("pairs", "words"))) / F.size(t)))
    told = _once(scored, "template_similarity", F.coalesce(share, F.lit(0.0)))
    kept = (F.col("template_similarity") >= confirm) | ((F.col("probability") >= model.surety) & (F.col("template_similarity") >= refute))
    family = F.when(kept, F.col("best")).otherwise(F.lit(UNKNOWN))
    out = told.select("doc_id", "paragraph", family.alias("family"), "probability", "template_similarity")
    return out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("template_similarity") >= confirm))
