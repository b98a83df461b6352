"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Base spans are matches of one pattern a kind, leftmost and without overlap, of
which those that fail the kind's check are dropped. A linear-chain conditional
random field adds spans that these patterns miss: numbers run together with
others, other separators, numbers without a country's plus, letters beyond
ASCII. It tags tokens (runs of digits, runs of letters, single other signs) from
their shapes and their neighbours' shapes, is trained on a small labelled table
and decoded by Viterbi over batches of token chains.

A word that has letters but neither digit nor ``@`` is outside by definition, as
is a line break. A chain splits where a label is fixed, so the chains decoded are
the runs of other words that hold a digit or ``@``, with the fixed words beside
them as context; all kinds need a digit or ``@``, so runs without can't add
anything. A span that the field finds is added if it passes its kind's check (of
mail and IP addresses run together, each of them that does) and meets no base span.

Defined results: a null text is an empty one, without spans. Offsets are code
points, end exclusive. Rows with a null id keep their row, repeated rows each
have their own. Long texts are read whole; patterns are matched in time linear in
the text, also on long runs of digits or letters. Of spans that begin at one
place the kind listed first comes first. Equal scores go to the label listed
first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, number of the kind, end

# base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def only_digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def luhn_digit(before: str) -> str:
    """The digit that makes the digits of ``before`` and itself pass the check."""
    digits = only_digits(before)
    return next(c for c in "0123456789" if luhn(digits + c))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)] + [(a, 1, b) for a, b in _addresses(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(out)


# checks of added spans

_MAIL = re.compile(r"[^\s@<>()\[\]\",;:]+@[^\s@<>()\[\]\",;:_/]+\.[^\W\d_]{2,}")
_CARD = re.compile(r"[0-9]+(?:[ ./-][0-9]+)*")
_CORE = re.compile(r"[^\s.,;!?()\[\]<>\"'](?:\S*[^\s.,;:!?()\[\]<>\"'])?")
_CALL = re.compile(r"(?:\+|00)?[(0-9][0-9() ./-]*[0-9]")


def plausible(kind: int, s: str) -> bool:
    """The check that a span of the field has to pass."""
    digits = only_digits(s)
    if kind == 0:
        return bool(_MAIL.fullmatch(s))
    if kind == 1:
        try:
            ipaddress.ip_address(s)
        except ValueError:
            return False
        return True
    if kind == 2:
        return 13 <= len(digits) <= 19 and bool(_CARD.fullmatch(s)) and luhn(digits) and digits.strip("0") != ""
    return 10 <= len(digits) <= 15 and bool(_CALL.fullmatch(s)) and (s[0] in "+(" or s[:2] == "00" or len(re.findall("[0-9]+", s)) >= 3)


# tokens and shapes

_WORD = re.compile(r"\S+")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_LETTER = re.compile(r"[^\W\d_]")
# Words that tell what a number beside them is.
_CUES = {"phone": 1, "call": 1, "tel": 1, "fax": 1, "mobile": 1, "card": 2, "visa": 2, "paid": 2, "host": 3, "server": 3, "ip": 3, "mail": 4, "email": 4, "write": 4, "contact": 4, "isbn": 5, "order": 5, "version": 5, "page": 5, "since": 5}
_SIGNS = {c: i for i, c in enumerate("+()-./:@,;#$%=_*'\"[]{}<>|&?!§€")}
#: Shapes: 0 nothing (beyond the ends), digits by length, letters by case and length, cue words, signs, any other sign.
_DIGIT_SHAPES, _LETTER_SHAPES = 1, 40
_CUE_SHAPES = _LETTER_SHAPES + 16
_SIGN_SHAPES = _CUE_SHAPES + 6
SHAPES = _SIGN_SHAPES + len(_SIGNS) + 1


def shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        n = min(len(token), 21)
        if n == 3:
            return _DIGIT_SHAPES + (3 if int(token) <= 255 else 22)
        if n >= 13:
            return _DIGIT_SHAPES + (n if c in "3456" else 23 + (n > 19))
        return _DIGIT_SHAPES + n
    if _LETTER.match(c):
        cue = _CUES.get(token.lower())
        if cue:
            return _CUE_SHAPES + cue
        case = 0 if token.islower() else 1 if token.isupper() else 2 if token[0].isupper() else 3
        return _LETTER_SHAPES + 4 * case + min(3, len(token) // 2 - (len(token) > 3))
    return _SIGN_SHAPES + _SIGNS.get(c, len(_SIGNS))


@dataclass
class Chain:
    """Tokens of one run: places in the text, shapes, and which of them are fixed words beside the run."""

    spans: list[tuple[int, int]]
    shapes: list[int]
    fixed: list[bool]


def chains(text: str) -> Iterator[Chain]:
    """The runs of a text that can hold personal data."""
    if not _ANY.search(text):
        return
    for line in _LINE.finditer(text):
        if _ANY.search(text, line.start(), line.end()):
            yield from _of_line(text, line.start(), line.end())


def _of_line(text: str, start: int, end: int) -> Iterator[Chain]:
    run, before = [], None
    for m in _WORD.finditer(text, start, end):
        word = m[0]
        if _ANY.search(word) or not _LETTER.search(word):
            run.append(m)
            continue
        if run:
            if (chain := _chain(run, before, m)) is not None:
                yield chain
            run = []
        before = m
    if run and (chain := _chain(run, before, None)) is not None:
        yield chain


def _chain(run: list, before, after) -> Chain | None:
    if not any(_ANY.search(m[0]) for m in run):
        return None
    out = Chain([], [], [])
    for m, fixed in [(before, True)] * (before is not None) + [(m, False) for m in run] + [(after, True)] * (after is not None):
        if fixed:
            word = m[0].strip("+()-./:@,;\"'") or m[0]
            out.spans.append((m.start(), m.end()))
            out.shapes.append(shape(word))
            out.fixed.append(True)
            continue
        for t in _TOKEN.finditer(m[0]):
            out.spans.append((m.start() + t.start(), m.start() + t.end()))
            out.shapes.append(shape(t[0]))
            out.fixed.append(False)
    return out


# the field

LABELS = 1 + 2 * len(KINDS)  # outside, then first and further token of each kind
SLOTS = 1 << 14
FEATURES = 12
_NEVER = -1e9


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """(transitions, first labels) as scores: a further token follows a first or further one of its kind."""
    move, first = np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    for k in range(len(KINDS)):
        further = 2 * k + 2
        move[:, further], first[further] = _NEVER, _NEVER
        move[[further - 1, further], further] = 0
    return move, first


@dataclass
class Batch:
    """Chains of like length side by side; slots of every token's features, and what is a token at all."""

    slots: np.ndarray  # chains x tokens x features
    there: np.ndarray
    fixed: np.ndarray

    @classmethod
    def of(cls, own: list[Chain]) -> Batch:
        n, width = len(own), max(len(c.shapes) for c in own)
        s = np.zeros((n, width + 4), dtype=np.int64)
        glued, there, fixed = np.zeros((n, width + 1), dtype=np.int64), np.zeros((n, width), bool), np.zeros((n, width), bool)
        digits = np.zeros((n, 1), dtype=np.int64)
        for i, c in enumerate(own):
            k = len(c.shapes)
            s[i, 2 : k + 2], there[i, :k], fixed[i, :k] = c.shapes, True, c.fixed
            at = np.array(c.spans)
            glued[i, 1:k] = at[1:, 0] == at[:-1, 1]
            shapes = np.array(c.shapes)
            is_number = (shapes >= _DIGIT_SHAPES) & (shapes < _LETTER_SHAPES)
            digits[i] = min(24, int((at[:, 1] - at[:, 0])[is_number].sum()))
        p2, p1, s0, n1, n2 = (s[:, j : j + width] for j in range(5))
        left, right = glued[:, :width], glued[:, 1 : width + 1]
        parts = [(s0,), (p1,), (n1,), (p2,), (n2,), (p1, left, s0), (s0, right, n1), (p2, p1, left, s0), (s0, right, n1, n2), (s0, left, right), (p1, left, s0, right, n1), (s0, np.broadcast_to(digits, s0.shape))]
        slots = np.empty((n, width, FEATURES), dtype=np.int64)
        for j, values in enumerate(parts):
            h = np.full(s0.shape, j + 1, dtype=np.uint64)
            for v in values:
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (v.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
                h ^= h >> np.uint64(29)
            slots[:, :, j] = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)
        return cls(slots, there, fixed)


@dataclass
class Field:
    weights: np.ndarray  # slots x labels
    moves: np.ndarray  # labels x labels

    def scores(self, b: Batch) -> np.ndarray:
        e = np.zeros((*b.there.shape, LABELS))
        for j in range(FEATURES):
            e += self.weights[b.slots[:, :, j]]
        e[b.fixed, 1:] = _NEVER
        return e

    def decode(self, b: Batch) -> np.ndarray:
        """Labels of the best chains (Viterbi), one step for all chains of the batch at a time."""
        move, first = allowed()
        move, e = move + self.moves, self.scores(b)
        n, width = b.there.shape
        best, back = e[:, 0] + first, np.zeros((n, width, LABELS), dtype=np.int8)
        back[:, 0] = np.arange(LABELS)
        for t in range(1, width):
            through = best[:, :, None] + move[None]
            came = through.argmax(axis=1)
            step = np.take_along_axis(through, came[:, None, :], axis=1)[:, 0] + e[:, t]
            go = b.there[:, t, None]
            best = np.where(go, step, best)
            back[:, t] = np.where(go, came, np.arange(LABELS))
        labels = np.zeros((n, width), dtype=np.int8)
        own = best.argmax(axis=1)
        for t in range(width - 1, -1, -1):
            labels[:, t] = own
            own = back[np.arange(n), t, own]
        return np.where(b.there, labels, 0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def likelihood(field: Field, b: Batch, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood of the labels, its gradient by weights and by moves), by forward and backward sums."""
    move, first = allowed()
    move, e = move + field.moves, field.scores(b)
    n, width = b.there.shape
    rows = np.arange(n)
    forward, backward = np.zeros((n, width, LABELS)), np.zeros((n, width, LABELS))
    forward[:, 0] = e[:, 0] + first
    for t in range(1, width):
        step = _log_sum(forward[:, t - 1, :, None] + move[None], 1) + e[:, t]
        forward[:, t] = np.where(b.there[:, t, None], step, forward[:, t - 1])
    for t in range(width - 2, -1, -1):
        step = _log_sum(move[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(b.there[:, t + 1, None], step, backward[:, t + 1])
    total = _log_sum(forward[:, -1], 1)
    told = e[rows, 0, labels[:, 0]] + first[labels[:, 0]]
    expected = np.where(b.there[:, :, None], np.exp(forward + backward - total[:, None, None]), 0)
    by_move = np.zeros((LABELS, LABELS))
    for t in range(1, width):
        go = b.there[:, t]
        told = told + np.where(go, e[rows, t, labels[:, t]] + move[labels[:, t - 1], labels[:, t]], 0)
        pair = forward[go, t - 1, :, None] + move[None] + (e[go, t] + backward[go, t])[:, None, :] - total[go, None, None]
        by_move -= np.exp(pair).sum(axis=0)
        np.add.at(by_move, (labels[go, t - 1], labels[go, t]), 1)
    seen = np.where(b.there[:, :, None], np.eye(LABELS)[labels], 0)
    gap = (seen - expected)[b.there]
    slots = b.slots[b.there]
    by_weight = np.stack([np.bincount(slots.ravel(), np.repeat(gap[:, y], FEATURES), SLOTS) for y in range(LABELS)], axis=1)
    return float((told - total).sum()), by_weight, by_move


def labels_of(chain: Chain, spans: list[tuple[str, int, int]]) -> list[int]:
    out = []
    for (a, b), fixed in zip(chain.spans, chain.fixed):
        own = next(((k, s) for k, s, e in spans if s <= a and b <= e), None)
        out.append(0 if own is None or fixed else 1 + 2 * KINDS.index(own[0]) + (a > own[1]))
    return out


def fit(lines: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, decay: float = 0.05) -> Field:
    """Train on labelled lines by gradient steps of adaptive size; the table is small, so the driver does it."""
    found = [(c, labels_of(c, spans)) for line, spans in lines for c in chains(line)]
    found.sort(key=lambda x: len(x[0].shapes))
    groups = []
    for at in range(0, len(found), 256):
        part = found[at : at + 256]
        b = Batch.of([c for c, _ in part])
        labels = np.zeros(b.there.shape, dtype=np.int64)
        for i, (_, y) in enumerate(part):
            labels[i, : len(y)] = y
        groups.append((b, labels))
    field = Field(np.zeros((SLOTS, LABELS)), np.zeros((LABELS, LABELS)))
    size = [np.full_like(x, 0.1) for x in (field.weights, field.moves)]
    before = [np.zeros_like(x) for x in size]
    for _ in range(rounds):
        sums = [-decay * field.weights, -decay * field.moves]
        for b, labels in groups:
            _, by_weight, by_move = likelihood(field, b, labels)
            sums[0] += by_weight
            sums[1] += by_move
        for x, g, last, step in zip((field.weights, field.moves), sums, before, size):
            same = np.sign(g) * np.sign(last)
            step *= np.where(same > 0, 1.2, np.where(same < 0, 0.5, 1.0))
            np.clip(step, 1e-4, 1.0, out=step)
            x += np.sign(g) * step
            last[:] = g
    return field


def _passing(kind: int, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A found span if it passes; else those of its words that do without the marks around them, for kinds without white space."""
    if plausible(kind, text[a:b]):
        yield a, b
    elif kind < 2:
        for m in _CORE.finditer(text, a, b):
            if plausible(kind, m[0]):
                yield m.start(), m.end()


def found_spans(texts: list[str], field: Field, tokens: int = 1 << 16) -> list[list[Span]]:
    """What the field finds and the checks let pass, for each text."""
    own = [(i, c) for i, text in enumerate(texts) for c in chains(text)]
    own.sort(key=lambda x: len(x[1].shapes))
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(own):
        end = at + 1
        while end < len(own) and (end + 1 - at) * len(own[end][1].shapes) <= tokens:
            end += 1
        labels = field.decode(Batch.of([c for _, c in own[at:end]]))
        for (i, c), row in zip(own[at:end], labels):
            marked = np.flatnonzero(row)
            starts = marked[row[marked] % 2 == 1]
            for s in starts.tolist():
                e = s + 1
                while e < len(c.spans) and row[e] == row[s] + 1:
                    e += 1
                kind, a, b = (int(row[s]) - 1) // 2, c.spans[s][0], c.spans[e - 1][1]
                out[i] += [(x, kind, y) for x, y in _passing(kind, texts[i], a, b)]
        at = end
    return out


def all_spans(texts: list[str], field: Field) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    for text, added in zip(texts, found_spans(texts, field)):
        base = base_spans(text)
        taken = np.zeros(0, dtype=np.int64)
        if added and base:
            ends, top = [], 0
            for _, _, b in base:
                top = max(top, b)
                ends.append(top)
            starts, taken = np.array([a for a, _, _ in base]), np.array(ends)
        free = []
        for a, k, b in added:
            if len(taken):
                before = int(np.searchsorted(starts, b))  # base spans that begin before this one ends
                if before and taken[before - 1] > a:
                    continue
            free.append((a, k, b))
        yield base, sorted(base + free)


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", room: int = 1 << 22) -> DataFrame:
    """Counts and digest of the base spans of each document, all its spans, and how many of them the field added."""

    def run(batches):
        for batch in batches:
            ids, texts, at = batch.column("id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()], 0
            while at < len(ids):
                end, left = at, room
                while end < len(ids) and (left > 0 or end == at):
                    left -= len(texts[end])
                    end += 1
                rows = []
                for doc, (base, spans) in zip(ids[at:end], all_spans(texts[at:end], field)):
                    counts = [sum(k == j for _, k, _ in base) for j in range(len(KINDS))]
                    rows.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in RESULT.split(", ")])
                at = end

    return docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, RESULT)
