"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other. Each is a logistic regression
over hashed words and word beginnings, with the probabilities of the earlier
categories as further inputs. In training these inputs are out-of-fold
predictions, so a later model sees them as good as they will be on new texts.

Fitting uses a bounded sample: at most ``per_class`` labelled documents with
and without the decisive category each, those with the smallest hash of their
id. Scoring covers every whole text, in one pass without a shuffle.

Defined results: a null or empty text has no features, so its probabilities are
those of the intercepts. Without labelled documents of both kinds nothing can
be learned: all probabilities are 0 and nothing is toxic. Labels that are null
count as 0; of repeated labels of a document the largest holds. Documents with
a null id can be scored but are not learned from. Extra columns are ignored, or
kept as they are by ``drop_toxic``.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, bounded_sample
from .text_kernels import _FOLD, prefix_sums, slices, span_hashes, text_buffers, words

BITS = 22
BEGINNINGS = (3, 4, 5, 6)
FOLDS = 5
_MARKS = np.arange(256, dtype=np.uint8)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def features_of(column):
    """(row, sorted distinct feature slots) of every text: its words and their beginnings, A-Z folded, marks cut off."""
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets):
        part, at = _MARKS[_FOLD[raw[offsets[a] : offsets[b]]]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, at)
        sums = prefix_sums(part)
        slots = [span_hashes(sums, starts, ends)]
        for k in BEGINNINGS:
            longer = ends - starts > k
            slots.append(np.where(longer, span_hashes(sums, starts, np.minimum(starts + k, ends)) ^ np.uint64(k), slots[0]))
        slots = (np.stack(slots, axis=1) >> np.uint64(64 - BITS)).astype(np.int32)
        bounds = first.tolist()
        for row, (x, y) in enumerate(zip(bounds, bounds[1:])):
            own = np.sort(slots[x:y], axis=None)
            keep = np.ones(len(own), dtype=bool)
            keep[1:] = own[1:] != own[:-1]
            yield a + row, own[keep]


class Linear:
    """A sparse logistic model over slots, plus dense weights for the chain's inputs."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, chain: np.ndarray, bias: float):
        order = np.argsort(slots)
        self.slots, self.weights, self.chain, self.bias = slots[order], weights[order], chain, bias

    def score(self, slots: np.ndarray, earlier: list[float]) -> float:
        total = self.bias + float(np.dot(self.chain, earlier)) if len(earlier) else self.bias
        if len(self.slots) and len(slots):
            at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
            total += float(self.weights[at[self.slots[at] == slots]].sum())
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _chunks(rows: list[np.ndarray], size: int = 256):
    """(first row, the rows' slots one after the other, the row of each), a few rows at a time."""
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield at, np.concatenate(part), np.repeat(np.arange(at, at + len(part)), [len(r) for r in part])


def fit_linear(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, keep: int = 4000, l1: float = 2e-4, steps: int = 150) -> Linear:
    """L1-regularised logistic regression by accelerated proximal gradient, on the slots that tell the classes apart best."""
    n = len(rows)
    # tables over all slots, filled by a few rows at a time: the memory is fixed by BITS
    with_, hits = np.zeros(1 << BITS, dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
    for _, slots, row in _chunks(rows):
        np.add.at(with_, slots, 1)
        np.add.at(hits, slots[y[row] > 0.5], 1)
    rate = y.mean() if n else 0.0
    names = np.flatnonzero(with_ >= 3)
    seen, toxic = with_[names].astype(float), hits[names].astype(float)
    z = np.abs(toxic - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
    chosen = np.sort(np.argsort(-z, kind="stable")[:keep])
    chosen = chosen[z[chosen] > 2]
    column, m = np.full(1 << BITS, -1, dtype=np.int32), len(chosen)
    column[names[chosen]] = np.arange(m)
    where, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, slots, row in _chunks(rows):
        own = column[slots]
        where.append(own[own >= 0])
        owner.append(row[own >= 0])
    where, owner = np.concatenate(where), np.concatenate(owner)
    w, v = np.zeros(m + earlier.shape[1]), np.zeros(m + earlier.shape[1])
    bias = look = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    fullest = np.bincount(owner, minlength=1).max(initial=1) + earlier.shape[1] + 1
    scale, t = 4.0 / fullest, 1.0
    for _ in range(steps):
        margin = look + np.bincount(owner, weights=v[:m][where], minlength=n) + earlier @ v[m:]
        slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) / n
        grad = np.concatenate([np.bincount(where, weights=slope[owner], minlength=m), earlier.T @ slope])
        step = scale * n / 8
        after = v - step * grad
        after[:m] = np.sign(after[:m]) * np.maximum(np.abs(after[:m]) - step * l1, 0)
        bias_after = look - step * slope.sum()
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if np.dot(v - after, after - w) > 0:
            t_after = 1.0  # the momentum went too far
        v, look = after + (t - 1) / t_after * (after - w), bias_after + (t - 1) / t_after * (bias_after - bias)
        w, bias, t = after, bias_after, t_after
    used = w[:m] != 0
    return Linear(names[chosen][used], w[:m][used], w[m:], bias)


class Chain:
    def __init__(self, categories: list[str], models: list[Linear], decisive: str, threshold: float):
        self.categories, self.models, self.decisive, self.threshold = categories, models, decisive, threshold

    def probabilities(self, column) -> np.ndarray:
        out = np.zeros((len(column), len(self.categories)))
        if self.models:
            for row, slots in features_of(column):
                for k, model in enumerate(self.models):
                    out[row, k] = model.score(slots, out[row, :k])
        return out


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the largest F1 on out-of-fold probabilities; between two of them."""
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    true, every = np.cumsum(y * weight), np.cumsum(weight)
    f1 = 2 * true / (every + (y * weight).sum())
    last = np.append(p[1:] != p[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], decisive: str, per_class: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on a bounded sample. categories: name -> condition on a row of labels, in the chain's order.

    The sample, 2 * per_class documents, each by its distinct slots, meets in one
    task, which fits the models; the driver gets their weights alone.
    """
    names = list(categories)
    known = labels.select(as_id(id_col).alias("id"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in categories.items()]).where("id IS NOT NULL")
    known = known.groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    totals = {r[decisive]: r["count"] for r in known.groupBy(decisive).count().collect()}
    if len(totals) < 2:
        return Chain(names, [], decisive, 2.0)
    with_, without = (bounded_sample(known.where(F.col(decisive) == v), F.col("id"), per_class, totals[v]) for v in (1, 0))
    sample = with_.unionByName(without)

    def run(batches):
        for batch in batches:
            slots = [None] * batch.num_rows
            for row, own in features_of(batch.column("text")):
                slots[row] = own.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(slots, pa.binary()), *[batch.column(n) for n in names]], ["id", "slots", *names])

    plain = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = plain.join(F.broadcast(sample), "id")  # at most 2 * per_class ids
    sampled = joined.mapInArrow(run, "id long, slots binary, " + ", ".join(f"`{n}` int" for n in names))

    def fit(batches):
        batches = list(batches)
        if batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fit(pa.Table.from_batches(batches), names, decisive, totals))], pa.binary())], ["chain"])

    fitted = sampled.repartition(1).mapInArrow(fit, "chain binary").collect()
    models, threshold = pickle.loads(fitted[0].chain) if fitted else ([], 2.0)
    return Chain(names, models, decisive, threshold)


def _fit(found: pa.Table, names: list[str], decisive: str, totals: dict[int, int]) -> tuple[list[Linear], float]:
    """The chain's models and threshold, from the sample's slots and labels."""
    order = pc.sort_indices(found, sort_keys=[("id", "ascending"), ("slots", "ascending")]).to_numpy()
    ids = found.column("id").to_numpy()[order]
    if not len(ids):
        return [], 2.0
    once = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # of a repeated document one
    ids, order = ids[once], order[once]
    views = [np.frombuffer(x.as_buffer(), np.int32) for x in found.column("slots")]  # the sample is held once, as it came
    slots = [views[i] for i in order.tolist()]
    y = np.stack([found.column(n).to_numpy()[order] for n in names], axis=1).astype(float)
    fold = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    oof, models = np.zeros(y.shape), []
    for k in range(len(names)):
        for f in range(FOLDS):
            own, other = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own) and len(other):
                model = fit_linear([slots[i] for i in other], oof[other, :k], y[other, k])
                oof[own, k] = [model.score(slots[i], oof[i, :k]) for i in own]
        models.append(fit_linear(slots, oof[:, :k], y[:, k]))
    d = names.index(decisive)
    share = np.bincount(y[:, d].astype(int), minlength=2)
    weight = np.array([totals.get(c, 0) / max(1, share[c]) for c in (0, 1)])[y[:, d].astype(int)]
    return models, best_threshold(oof[:, d], y[:, d], weight)


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a probability p_<category> each, toxic) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most 4,000 weights a category
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for batch in batches:
            chain = sent.value
            p = chain.probabilities(batch.column("text"))
            toxic = p[:, chain.categories.index(chain.decisive)] >= chain.threshold
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in p.T], pa.array(toxic)], ["doc_id", *names, "toxic"])

    plain = docs.select(as_id(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, " + ", ".join(f"`{n}` double" for n in names) + ", toxic boolean")


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            chain = sent.value
            p = chain.probabilities(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(p[:, chain.categories.index(chain.decisive)] < chain.threshold))

    return docs.mapInArrow(run, docs.schema)


def label_categories() -> dict[str, F.Column]:
    """The chain over a table of labels ``quality`` and ``toxic``: poor, toxic, and both."""
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"poor": poor, "toxic": toxic, "toxic_and_poor": poor & toxic}
