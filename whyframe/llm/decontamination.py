"""Benchmark decontamination: q-gram lemma filter in diagonal bands, banded alignment.

A passage of a document is a copy of a benchmark item if the whole item aligns
with it within ``e = floor(error_rate * length)`` edits, on normalised text.
By the q-gram lemma such a passage shares at least ``L - q + 1 - q e`` of the
item's q-grams, and all of them lie on diagonals (place in the document minus
place in the item) at most 2 e apart. Bands of 4 e + 1 diagonals that overlap
by half hold any such window whole, so counting distinct item q-grams in each
band loses no copy. Bands that reach the bound are verified by an alignment
confined to their diagonals. Bands are only made within windows of the text that
have the q-grams at all, and a window that repeats itself is one band, so work
doesn't grow with the square of what a text and an item repeat.

An item so short that ``e`` edits may leave none of its q-grams is looked for
by shorter ones, with the same ``e``.

Documents are never shuffled. The items go to the executors in blocks of at most
``block_chars`` characters; each block is one pass over the documents. The
driver holds the blocks, so the benchmark, not the corpus, must fit there.

Normalised: A-Z in lower case; runs of white space, ASCII punctuation and
control characters are one blank. Defined results: null and empty texts hold no
passage; an item whose normalised text is null or shorter than q characters is
too short to tell a copy and matches nothing. Repeated documents and items each
have their own rows. Rows with a null document id or item id are left out of
the hits; ``decontaminate`` judges documents and items by their text alone. Of
overlapping finds of an item the one with the fewest edits, then the first,
counts, and then what doesn't overlap it, in the same order. Very long texts are read whole, in slices of their own. Extra columns
are ignored, or kept as they are by ``decontaminate``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id
from .text_kernels import U64, _BASE, _INVERSE, _TABLE, _power, mix, slices, text_buffers

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32
#: Places of an item for one of the text, on average over a window, from which all the window is aligned.
MANY = 16
HITS = "doc_id long, item_id long, start long, end long, edits long, item_length long"


def normalised(raw: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and the place of each in ``raw``; documents are parted by blanks at their offsets."""
    folded = _CLASS[raw]
    blank = folded == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if offsets is not None and len(raw):
        keep[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(keep)
    return folded[at], at


def qgrams(text: np.ndarray, q: int) -> np.ndarray:
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = np.zeros(len(text) + 1, dtype=U64)
    np.cumsum(_TABLE[text] * _power(_BASE, len(text)), out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * _power(_INVERSE, n))


class Items:
    """A block of benchmark items with the table of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]], q: int, error_rate: float):
        self.q, self.ids, self.texts, self.edits, self.least = q, [], [], [], []
        grams, owners, places, brief, shorter = [], [], [], [], q
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            t = normalised(raw)[0]
            t = np.frombuffer(t.tobytes().strip(), np.uint8)
            if len(t) < q:
                continue
            e = int(error_rate * len(t))
            if len(t) < q * (e + 1):  # so many edits may leave none of its q-grams: shorter ones are counted
                brief.append((item, text))
                shorter = min(shorter, max(1, len(t) // (e + 1)))
                continue
            g = qgrams(t, q)
            grams.append(g)
            owners.append(np.full(len(g), len(self.ids)))
            places.append(np.arange(len(g)))
            self.ids.append(item)
            self.texts.append(t)
            self.edits.append(e)
            self.least.append(self._distinct_bound(g, e))
        self.edits, self.least = np.array(self.edits, np.int64), np.array(self.least, np.int64)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, U64)
        owner, place = (np.concatenate(x) if grams else np.zeros(0, np.int64) for x in (owners, places))
        order = np.lexsort((place, owner, flat))
        flat, owner, self.places = flat[order], owner[order], place[order]
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        # an entry for each gram of an item, whatever the number of its places there
        self.first = np.flatnonzero(new)
        self.times = np.diff(np.append(self.first, len(flat)))
        self.grams, self.owner = flat[self.first], owner[self.first]
        self.same = np.searchsorted(self.grams, self.grams, side="right") - np.arange(len(self.grams))
        self.brief = Items(brief, shorter, error_rate) if brief else None
        bits = 20
        self.shift = U64(64 - bits)
        self.sieve = np.zeros(1 << bits, dtype=bool)
        self.sieve[(self.grams >> self.shift).astype(np.int64)] = True

    def _distinct_bound(self, grams: np.ndarray, e: int) -> int:
        """Places of the item whose q-grams must be found: each edit destroys q of them at most."""
        return len(grams) - self.q * e

    def shared(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the text whose q-gram an item has; the first and the number of its entries in the table."""
        grams = qgrams(text, self.q)
        at = np.flatnonzero(self.sieve[(grams >> self.shift).view(np.int64)])
        grams = grams[at]
        lo = np.searchsorted(self.grams, grams, side="left")
        there = self.grams[np.minimum(lo, len(self.grams) - 1)] == grams if len(self.grams) else np.zeros(len(at), dtype=bool)
        at, lo = at[there], lo[there]
        return at, lo, self.same[lo]

    def windows(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places of the text, entries): what the item shares with each window of the text that could hold a copy.

        Windows of twice a copy's greatest length overlap by half. A gram counts
        once a window with all its places in the item, so that no count grows
        with the square of what a text and an item repeat.
        """
        if not len(at):
            return
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, where = self.owner[entry], np.repeat(at, n)
        window = where // (self.lengths + self.edits)[item]
        item, where, entry, window = np.tile(item, 2), np.tile(where, 2), np.tile(entry, 2), np.concatenate([window, window - 1])
        order = np.lexsort((where, entry, window, item))
        item, where, entry, window = item[order], where[order], entry[order], window[order]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (window[1:] != window[:-1])
        fresh = new.copy()
        fresh[1:] |= entry[1:] != entry[:-1]
        first = np.flatnonzero(new)
        count = np.add.reduceat(np.where(fresh, self.times[entry], 0), first)
        end = np.append(first[1:], len(item))
        for k in np.flatnonzero(count >= self.least[item[first]]):
            yield int(item[first[k]]), where[first[k] : end[k]], entry[first[k] : end[k]]

    def candidates(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of each band that meets the item's bound, each once."""
        return sorted({(item, *band) for item, where, entry in self.windows(at, lo, n) for band in self.bands(item, where, entry)})

    def bands(self, item: int, where: np.ndarray, entry: np.ndarray) -> Iterator[tuple[int, int]]:
        """Bands of diagonals of a window with as many distinct places of the item as a copy has.

        A window that would pair each of its places with ``MANY`` of the item's
        repeats itself; all its diagonals then are one band, which the alignment decides.
        """
        times, e = self.times[entry], int(self.edits[item])
        if times.sum() > MANY * len(where):
            yield int(where.min() - self.lengths[item] + self.q), int(where.max())
            return
        index = np.repeat(self.first[entry] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        place = self.places[index]
        diagonal = np.repeat(where, times) - place
        band = diagonal // (2 * e + 1)
        place, diagonal, band = np.tile(place, 2), np.tile(diagonal, 2), np.concatenate([band, band - 1])
        order = np.lexsort((place, band))
        place, diagonal, band = place[order], diagonal[order], band[order]
        new = np.ones(len(band), dtype=bool)
        new[1:] = band[1:] != band[:-1]
        fresh = new.copy()
        fresh[1:] |= place[1:] != place[:-1]
        first = np.flatnonzero(new)
        count = np.add.reduceat(fresh, first, dtype=np.int64)
        low, high = np.minimum.reduceat(diagonal, first), np.maximum.reduceat(diagonal, first)
        for k in np.flatnonzero(count >= self.least[item]):
            yield int(low[k]), int(high[k])


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end in the text) of the best alignments of the whole item with a passage that ends there, on diagonals low..high."""
    far = len(item) + len(text) + 1
    k = np.arange(low, high + 1)
    row = np.where((k >= 0) & (k <= len(text)), 0, far)
    step = np.arange(len(k))
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    for i, c in enumerate(item):
        j = i + k  # the text's character that a step along the diagonal takes
        inside = (j >= 0) & (j < len(text))
        same = padded[np.where(inside, j, len(text))] == c
        now = np.where(inside, row + ~same, far)
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        now[(j + 1 < 0) | (j + 1 > len(text))] = far
        row = np.minimum(np.minimum.accumulate(now - step) + step, far)
    return row, len(item) + k


def passages(text: np.ndarray, items: Items, shared: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of each copy in one normalised text; of overlapping finds of an item the best."""
    ends: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for item, low, high in items.candidates(*(items.shared(text) if shared is None else shared)):
        t, e = items.texts[item], int(items.edits[item])
        if low == high and low >= 0 and np.array_equal(text[low : low + len(t)], t):
            ends.setdefault(item, []).append((np.zeros(1, np.int64), np.array([low + len(t)])))
            continue
        edits, end = banded_alignment(t, text, low - e, high + e)
        if len(near := np.flatnonzero(edits <= e)):
            ends.setdefault(item, []).append((edits[near], end[near]))
    out = []
    for item, found in ends.items():
        out += [(item, *span) for span in apart(items.texts[item], text, *(np.concatenate(x) for x in zip(*found)))]
    return out


def apart(item: np.ndarray, text: np.ndarray, edits: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, edits) of finds that don't overlap: the one with the fewest edits, then the first, before others."""
    order = np.lexsort((edits, end))
    edits, end = edits[order], end[order]
    new = np.ones(len(end), dtype=bool)
    new[1:] = end[1:] != end[:-1]
    edits, end = edits[new], end[new]
    gone = np.zeros(len(end), dtype=bool)
    starts, stops, out = [], [], []
    for k in np.lexsort((end, edits)):
        if gone[k]:
            continue
        e, b = int(edits[k]), int(end[k])
        # backwards from the end: where the passage starts
        a = b - (banded_alignment_prefix(item[::-1], text[max(0, b - len(item) - e) : b][::-1], e) if e else len(item))
        at = bisect_left(starts, b)
        if at and stops[at - 1] > a:
            continue
        starts.insert(at, a)
        stops.insert(at, b)
        out.append((a, b, e))
        # what ends within the find, or so soon behind it that it must start there
        near = slice(np.searchsorted(end, a, side="right"), np.searchsorted(end, b + len(item) + int(edits.max()), side="left"))
        gone[near] |= (end[near] <= b) | (end[near] - len(item) + edits[near] < b)
    return out


def banded_alignment_prefix(item: np.ndarray, text: np.ndarray, e: int) -> int:
    """Length of the prefix of the text that aligns best with the whole item within e edits."""
    far = len(item) + len(text) + 1
    k = np.arange(-e, e + 1)
    step = np.arange(len(k))
    row = np.where((k >= 0) & (k <= len(text)), k, far)
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    for i, c in enumerate(item):
        j = i + k
        inside = (j >= 0) & (j < len(text))
        same = padded[np.where(inside, j, len(text))] == c
        now = np.where(inside, row + ~same, far)
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        now[(j + 1 < 0) | (j + 1 > len(text))] = far
        row = np.minimum(np.minimum.accumulate(now - step) + step, far)
    return max(0, len(item) - e + int(np.argmin(row)))


def hits_of_batch(column, items: Items) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item's id, start, end, edits, item's length) over a text column; start and end count characters of the original text."""
    if items.brief is not None:
        yield from hits_of_batch(column, items.brief)
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        text, origin = normalised(part, at)
        edges = np.searchsorted(origin, at)
        hit, lo, n = items.shared(text)
        cut = np.searchsorted(hit, edges)
        least = items.least.min(initial=1 << 60)
        for k in np.flatnonzero(np.diff(cut) >= least):
            x, y = cut[k], cut[k + 1]
            own = hit[x:y] - edges[k]
            whole = own <= edges[k + 1] - edges[k] - items.q  # not across the document's end
            spans = passages(text[edges[k] : edges[k + 1]], items, (own[whole], lo[x:y][whole], n[x:y][whole]))
            if spans:
                place = origin[edges[k] : edges[k + 1]] - at[k]
                whole = part[at[k] : at[k + 1]]
                chars = np.concatenate([[0], np.cumsum((whole & 0xC0) != 0x80)])
                for item, start, end, edits in spans:
                    yield a + int(k), items.ids[item], int(chars[place[start]]), int(chars[place[end - 1] + 1]), edits, int(items.lengths[item])


def item_blocks(benchmark: DataFrame, q: int, error_rate: float, block_chars: int, id_col: str, text_col: str) -> Iterator[Items]:
    plain = benchmark.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    block, room = [], block_chars
    for row in plain.where("text IS NOT NULL").toLocalIterator():
        block.append((row.id, row.text))
        room -= len(row.text)
        if room <= 0:
            yield Items(block, q, error_rate)
            block, room = [], block_chars
    if block:
        yield Items(block, q, error_rate)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, q: int = 10, block_chars: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits, item_length), one row for each copy of an item in a document."""
    plain = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL")
    out = None
    for items in item_blocks(benchmark.where(as_id(item_id_col).isNotNull()), q, error_rate, block_chars, item_id_col, item_text_col):

        def run(batches, items=items):
            for batch in batches:
                ids = batch.column("id")
                rows = [(ids[k].as_py(), *hit) for k, *hit in hits_of_batch(batch.column("text"), items)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "start", "end", "edits", "item_length"])

        part = plain.mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, q: int = 10, block_chars: int = 8_000_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no copy of a benchmark item, with all their columns."""
    for items in item_blocks(benchmark, q, error_rate, block_chars, item_id_col, item_text_col):

        def run(batches, items=items):
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text_col))
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[k for k, *_ in hits_of_batch(column, items)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
