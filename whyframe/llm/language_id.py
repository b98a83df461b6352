"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams of one to four characters (A-Z in lower case) by
language are gathered from every training document, the smoothed log-probability matrix (slots by languages, its size
fixed by parameters) is sent to the executors, and batches of whole texts are
scored with numpy: a document's score is the sum of the matrix rows of its
n-grams.

Defined results: a text that is null or has no letter is ``und`` with score
0.0. Documents with a null language or null text aren't learned from. With no
training document at all every text is ``und`` with score 0.0. Ties go to the
language that comes first in alphabetical order. Rows with a null id keep their row,
with a null id; repeated rows each have their own. Long texts count whole, in
slices of their own. Extra columns are ignored. The matrix is sent to every
executor, so more than ``MAX_LANGUAGES`` languages are an error, not cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, stage
from .text_kernels import _FOLD, U64, prefix_sums, slices, span_hashes, text_buffers

UNKNOWN = "und"
MAX_LANGUAGES = 512


def document_slots(column, orders: tuple[int, ...], bits: int):
    """(first row, last row, slots, document of each slot) for slices of a text column; an n-gram is n characters of one document."""
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets):
        part, at = _FOLD[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        sums = prefix_sums(part)
        begins = np.flatnonzero((part & 0xC0) != 0x80)  # bytes that start a character
        document = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(at))[begins]
        begins = np.append(begins, len(part))
        slots, owners = [], []
        for n in orders:
            inside = document[: len(document) - n + 1] == document[n - 1 :]
            first = begins[: len(inside)][inside]
            slots.append((span_hashes(sums, first, begins[n : len(inside) + n][inside]) >> U64(64 - bits)).astype(np.int64))
            owners.append(document[: len(inside)][inside])
        yield a, b, slots, owners


def training_counts(docs: DataFrame, orders: tuple[int, ...], bits: int, chunk: int = 4096) -> DataFrame:
    """(lang, chunk, counts, documents) summed over all documents with columns text and lang."""
    size = 1 << bits

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            for name in names:
                totals.setdefault(name, np.zeros(size, dtype=np.int64))
                documents[name] = documents.get(name, 0) + langs.count(name)
            for a, b, slots, owners in document_slots(batch.column("text"), orders, bits):
                own = code[a:b]
                for s, o in zip(slots, owners):
                    both = np.bincount(own[o] * size + s, minlength=len(names) * size).reshape(len(names), size)
                    for name, row in zip(names, both):
                        totals[name] += row
        rows = [(name, k, total[k * chunk : (k + 1) * chunk].tobytes(), documents[name] if k == 0 else 0) for name, total in totals.items() for k in range(-(-size // chunk)) if k == 0 or total[k * chunk : (k + 1) * chunk].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int32(), pa.binary(), pa.int64()])], ["lang", "chunk", "counts", "documents"])

    def total(group: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"lang": group.column("lang")[:1], "chunk": group.column("chunk")[:1], "counts": pa.array([counts.tobytes()], pa.binary()), "documents": pa.array([pc.sum(group.column("documents")).as_py()], pa.int64())})

    schema = "lang string, chunk int, counts binary, documents long"
    return docs.mapInArrow(run, schema).groupBy("lang", "chunk").applyInArrow(total, schema)


class Model:
    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray, orders: tuple[int, ...], bits: int):
        self.languages, self.matrix, self.prior, self.orders, self.bits = languages, matrix, prior, orders, bits

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        n = len(column)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        scores = np.tile(self.prior, (n, 1))
        for a, b, slots, owners in document_slots(column, self.orders, self.bits):
            for s, o in zip(slots, owners):
                if not len(s):
                    continue
                first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                scores[a + o[first]] += np.add.reduceat(self.matrix[s], first, axis=0)
        best = scores.argmax(axis=1)
        top = scores[np.arange(n), best]
        posterior = 1.0 / np.exp(scores - top[:, None]).sum(axis=1)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters)], np.where(letters, posterior, 0.0)


def train(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3, 4), bits: int = 16, smoothing: float = 0.5, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Fit on every row with a text and a language; what comes to the driver is languages x slots."""
    plain = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = stage(training_counts(plain, orders, bits), "language-counts")
    known = [r.lang for r in sums.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    index, size = {x: k for k, x in enumerate(sorted(known))}, 1 << bits
    counts, documents, width = np.zeros((len(known), size)), np.zeros(len(known)), 4096
    for r in sums.toLocalIterator():
        part = np.frombuffer(r.counts, np.int64)
        counts[index[r.lang], r.chunk * width : r.chunk * width + len(part)] = part
        documents[index[r.lang]] += r.documents
    matrix = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * size)
    prior = np.log(np.maximum(documents, 1)) - np.log(max(1.0, documents.sum()))
    return Model(sorted(known), np.ascontiguousarray(matrix.T), prior, orders, bits)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # languages x slots doubles, bounded by parameters

    def run(batches):
        for batch in batches:
            names, score = sent.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    plain = docs.select(as_id(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == 0


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", folds: int = 5, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the documents outside the held-out fold, predict all."""
    model = train(docs.where(~F.coalesce(held_out(id_col, folds), F.lit(True))), **options)
    out = identify(docs, model, id_col)
    return out.select("doc_id", F.coalesce(held_out("doc_id", folds), F.lit(False)).alias("held_out"), "lang_pred", "score")
