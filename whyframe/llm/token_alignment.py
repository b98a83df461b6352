"""Cross-tokenizer alignment by elementary intervals of bytes.

Tokenizer A (a ``tokenizers`` file of byte-level BPE) reads a space and the
text, tokenizer B (a ``sentencepiece`` model, which puts the space before by
itself) reads the text; both give the bytes of their tokens. The union of both
arrays of end offsets cuts the bytes into elementary intervals, and a search for
each interval's end in either array tells the A and the B token that own it: each
interval is one overlap. Ends that both arrays have close a group. ``links``
names the pairs of token occurrences that are counted: ``ends`` (both end at the
same byte), ``overlap`` (they share an interval) or ``group`` (they share a
group: products of a group's A and B tokens).

Texts are cut before a blank or line break that follows no white space where
neither tokenizer can join what stands on both sides: A's own cutting rule
starts a new pre-token there, and of B it is read off the vocabulary (no piece
has a blank after another character, none a line break). Such places are shared
ends, so a piece of text is encoded and aligned once in a worker and kept in a
bounded table. Other tokenizers, and texts with a piece that isn't given back
byte by byte, are encoded whole.

Documents go in blocks of about ``BLOCK`` characters. A block numbers its
distinct id pairs and keeps for each document the numbers of its links, so that
corpus-wide counts are asked for once a pair and block, not once a link: counts
are summed by pair, joined to the blocks' pairs and brought back to the block.

Defined results: null and empty texts, and texts whose A or B bytes differ from
space and text, have no tokens: zeros and an empty digest, and count nowhere.
Special tokens' strings in a text are plain text. Rows with a null id keep their
row; repeated rows each have their own and each count. Long texts are aligned
whole, in slices; one longer than a block makes its own. Ties for a B id's
highest count are all best. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, stage
from .tokenizing import _kind, _visible_bytes

BLOCK = 8 << 20
SLICE = 1 << 18
ROOM = 600_000
LINKS = ("ends", "overlap", "group")
_PIECES = re.compile(r"[ \n][^ \n]*")
#: White space, old and new, before a blank or a line break: no cut there.
_NO_CUT = re.compile(r"[\s\x1c-\x1f\u180e][ \n]")
_SPACE = re.compile(r"[\s\x1c-\x1f\u180e]\Z")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_workers: dict[tuple, Aligner] = {}


def pieces_of(text: str) -> Iterable[str]:
    """A text that begins with a space, cut where neither tokenizer joins."""
    if _NO_CUT.search(text):
        return _joined_pieces(text)
    return _PIECES.findall(text) if len(text) <= SLICE else (m[0] for m in _PIECES.finditer(text))


def _joined_pieces(text: str) -> Iterator[str]:
    held = ""
    for m in _PIECES.finditer(text):
        if held and not _SPACE.search(held):
            yield held
            held = ""
        held += m[0]
    yield held


def byte_tokens(path: str) -> tuple[object, list[bytes], bool]:
    """(tokenizer A, bytes of each id, whether texts may be cut)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        kind = _kind(json.load(f))
    back = {chr(b): bytes([b]) for b in range(256)} | {chr(v): bytes([b]) for b, v in _visible_bytes().items()}
    table = [b""] * (1 + max(tokenizer.get_vocab().values(), default=0))
    for token, i in tokenizer.get_vocab().items():
        table[i] = b"".join(back.get(c, c.encode()) for c in token)
    return tokenizer, table, kind == "leading"


def piece_tokens(path: str) -> tuple[object, list[bytes], bool]:
    """(tokenizer B, bytes of each id, whether texts may be cut)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table, cut = [], True
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            table.append(bytes([int(_BYTE.fullmatch(piece)[1], 16)]))
            continue
        table.append(piece.replace("▁", " ").encode())
        cut = cut and not re.search("[^▁]▁|\n", piece)
    return model, table, cut


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A owner, B owner, whether a group closes there) of every elementary interval; both arrays rise strictly to one end."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


def group_products(a: np.ndarray, b: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token of a group, group by group."""
    last_a, last_b = a[closes], b[closes]
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    per_a = np.repeat(n_b, n_a)  # each A token meets the B tokens of its group
    left = np.repeat(np.arange(len(per_a)), per_a)
    within = np.arange(len(left)) - np.repeat(np.cumsum(per_a) - per_a, per_a)
    first_b = np.repeat(last_b - n_b + 1, n_a)
    return left, first_b[left] + within


class Aligner:
    """Aligns pieces and whole texts; keeps what it has seen in a table of two bounded generations."""

    def __init__(self, path_a: str, path_b: str, links: str):
        self.a, self.bytes_a, cut_a = byte_tokens(path_a)
        self.b, self.bytes_b, cut_b = piece_tokens(path_b)
        self.cut, self.links = cut_a and cut_b, links
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        #: How a token is written: within its group, and as its group's last one.
        self.spelt = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers for a text that begins with a space, or a line break in the middle of a text; None: bytes differ."""
        ids_a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text[1:] if text[0] == " " else text)
        ids_b = ids_b[1:] if text[0] != " " and ids_b[:1] == [self.blank] else ids_b
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return None
        return np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)

    def align(self, parts: list[str]) -> list[tuple | None]:
        """(groups as text, codes of the linked id pairs, (n_a, n_b, n_groups) in one number) of each part; None: bytes differ.

        Several parts must end where neither tokenizer joins; they are encoded side by side as one text.
        """
        found = self._ids("".join(parts))
        if found is None:
            return [None] if len(parts) == 1 else [x for p in parts for x in self.align([p])]
        ids_a, ids_b = found
        stops = np.cumsum([len(p.encode()) for p in parts])
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        a, b, closes = elementary(ends_a, ends_b)
        last_a, last_b = a[closes], b[closes]
        left, right = (last_a, last_b) if self.links == "ends" else (a, b) if self.links == "overlap" else group_products(a, b, closes)
        codes = (ids_a[left] << 32) | ids_b[right]
        # a group's A tokens, then its B tokens, each with the mark that follows it
        group_a, group_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
        final_a, final_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        final_a[last_a], final_b[last_b] = 1, 1
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        spelt = list(map(self.spelt.__getitem__, np.concatenate([2 * ids_a + final_a, 2 * (len(self.bytes_a) + ids_b) + final_b])[order].tolist()))
        # parts are ranges of tokens, groups and links, since their ends are shared
        stop_a, stop_b = np.searchsorted(ends_a, stops) + 1, np.searchsorted(ends_b, stops) + 1
        stop_groups, stop_links = np.searchsorted(last_a, stop_a), np.searchsorted(left, stop_a)
        sums = [x | y << 31 | z << 62 for x, y, z in zip(*(np.diff(x, prepend=0).tolist() for x in (stop_a, stop_b, stop_groups)))]
        out, t, k, raw = [], 0, 0, codes.tobytes()
        for tokens, links, total in zip((stop_a + stop_b).tolist(), (8 * stop_links).tolist(), sums):
            out.append(("".join(spelt[t:tokens]), raw[k:links], total))
            t, k = tokens, links
        return out

    def learn(self, new: set[str]) -> None:
        todo = []
        for p in new:
            if p in self.older:
                self.known[p] = self.older[p]
            elif _SPACE.search(p):  # the end of a text: it would run into what follows
                self.known[p] = self.align([p])[0]
            else:
                todo.append(p)
        for at in range(0, len(todo), 2048):
            part = todo[at : at + 2048]
            self.known.update(zip(part, self.align(part)))

    def _looked_up(self, parts: list[str]) -> list[tuple | None]:
        wanted = set(parts)
        new = wanted.difference(self.known)
        if new and len(self.known) + len(new) > ROOM // 2:
            self.older, self.known, new = self.known, {}, wanted
        if new:
            self.learn(new)
        return list(map(self.known.__getitem__, parts))

    def documents(self, texts: list[str | None]) -> Iterator[tuple[str, bytes, int, int, int]]:
        """(digest of the groups, codes of the linked id pairs, n_a, n_b, n_groups) of whole texts."""
        at = 0
        while at < len(texts):
            end, room = at, SLICE
            while end < len(texts) and (room > 0 or end == at):
                room -= len(texts[end] or "")
                end += 1
            if end - at > 1 and self.cut:
                self._looked_up([p for t in texts[at:end] if t and len(t) <= SLICE for p in pieces_of(" " + t)])
            yield from map(self.document, texts[at:end])
            at = end

    def document(self, text: str | None) -> tuple[str, bytes, int, int, int]:
        nothing = ("", b"", 0, 0, 0)
        if not text:
            return nothing
        full, digest, codes, total, held = " " + text, hashlib.sha256(), [], 0, ""
        parts = iter(pieces_of(full)) if self.cut else iter(())
        while batch := list(islice(parts, 1 << 14)):
            found = self._looked_up(batch)
            if None in found:
                codes = []
                break
            told, raw, sums = zip(*found)
            told = "".join(told)
            digest.update((held + told[:-1]).encode())
            held = told[-1]
            codes.append(b"".join(raw))
            total += sum(sums)
        if not codes:  # not cut, or a piece differs
            whole = self.align([full])[0]
            if whole is None:
                return nothing
            digest, codes, total = hashlib.sha256(whole[0][:-1].encode()), [whole[1]], whole[2]
        low = (1 << 31) - 1
        return digest.hexdigest(), b"".join(codes), total & low, total >> 31 & low, total >> 62


def aligner(path_a: str, path_b: str, links: str) -> Aligner:
    key = (path_a, path_b, links)
    if key not in _workers:
        _workers[key] = Aligner(*key)
    return _workers[key]


_ALIGNED = pa.schema([("block", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("links", pa.binary()), ("groups_sha256", pa.string())])
ALIGNED = "block long, pairs binary, times binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, links binary, groups_sha256 string"


def _align(path_a: str, path_b: str, links: str, room_of_block: int):
    def packed(block: int, rows: list) -> pa.RecordBatch:
        """A block: one row with its distinct pairs and their links, and a row for each document with its links' places among them."""
        sizes = [len(r[2]) // 8 for r in rows]
        pairs, place, times = np.unique(np.frombuffer(b"".join([r[2] for r in rows]), np.int64), return_inverse=True, return_counts=True)
        place = place.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
        columns: dict[str, list] = {f.name: [] for f in _ALIGNED}

        def add(*values):
            for c, v in zip(columns.values(), values):
                c.append(v)

        add(block, pairs.tobytes(), times.astype(np.int64).tobytes(), None, None, None, None, None, None, None)
        at = 0
        for (doc, digest, _, n_a, n_b, n_groups), n in zip(rows, sizes):
            add(block, None, None, doc, n_a, n_b, n_groups, n, place[at : at + n].tobytes(), digest)
            at += n
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ALIGNED], schema=_ALIGNED)

    def run(batches):
        tool, rows, room, block = aligner(path_a, path_b, links), [], room_of_block, None
        for batch in batches:
            numbers, ids, texts = batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text")
            texts = texts.to_pylist()
            for number, doc, text, found in zip(numbers, ids, texts, tool.documents(texts)):
                block = number if block is None else block
                rows.append((doc, *found))
                room -= len(text or "") + 64
                if room <= 0:
                    yield packed(block, rows)
                    rows, room, block = [], room_of_block, None
        if rows:
            yield packed(block, rows)

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Staged blocks of aligned documents, see ``_align``."""
    if links not in LINKS:
        raise ValueError(f"links must be one of {LINKS}")
    rows = docs.select(as_id(id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    return stage(rows.mapInArrow(_align(path_a, path_b, links, block), ALIGNED), "aligned")


def block_pairs(aligned: DataFrame) -> DataFrame:
    """(block, place, code, n): each distinct pair of a block with its links there."""

    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                codes, n = (np.frombuffer(batch.column(c)[j].as_py(), np.int64) for c in ("pairs", "times"))
                for at in range(0, len(codes), 1 << 16):
                    part = codes[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column("block")[j].as_py())), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part), pa.array(n[at : at + (1 << 16)])], ["block", "place", "code", "n"])

    return aligned.where("pairs IS NOT NULL").select("block", "pairs", "times").mapInArrow(run, "block long, place int, code long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(code, a_id, b_id, count, best): links of an id pair in the whole corpus, and whether no other A id has more with its B id."""
    counts = pairs.groupBy("code").agg(F.sum("n").alias("count")).withColumn("b_id", F.col("code").bitwiseAND(0xFFFFFFFF).cast("int"))
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))  # one row for an id of B's vocabulary
    told = counts.join(F.broadcast(most), "b_id")
    return told.select("code", F.shiftright("code", 32).cast("int").alias("a_id"), "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(documents: pa.Table, told: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of their links."""
    n = told.num_rows
    place = told.column("place").to_numpy()
    count, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    count[place], best[place] = told.column("count").to_numpy(), told.column("best").to_numpy(zero_copy_only=False)
    kind = "<u2" if n <= 1 << 16 else "<u4"
    sums = []
    for x in documents.column("links"):
        own = np.frombuffer(x.as_py(), kind)
        sums.append((int(best[own].sum()), int(count[own].sum())))
    out = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array([x for x, _ in sums], pa.int64())).append_column("count_sum", pa.array([x for _, x in sums], pa.int64()))
    return out.append_column("groups_sha256", documents.column("groups_sha256"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def cross_tokenizer_alignment(docs: DataFrame, path_a: str, path_b: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """For each document its tokens, groups and links, and what the corpus says of its links."""
    aligned = align_documents(docs, path_a, path_b, links, id_col, text_col, block)
    pairs = block_pairs(aligned)
    told = pairs.select("block", "place", "code").join(pair_counts(pairs).select("code", "count", "best"), "code").select("block", "place", "count", "best")
    documents = aligned.where("pairs IS NULL").drop("pairs", "times")
    return documents.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scored, SCORED)
