"""Token ids of whole texts with a ``tokenizers`` file, encoded by chunks.

The pre-tokenizers of the supported files always cut before a single space, so
a text's ids are the ids of its space-separated chunks in order. Chunks repeat
far more often than texts: each worker encodes a chunk once, with the
tokenizers library, and keeps its packed ids in a bounded table. Texts with
other or adjoining white space, and tokenizers of any other kind, are encoded
whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: White space that isn't a single blank or line break between two chunks.
_ODD_SPACE = ["  ", "\n\n", " \n", "\n ", *(chr(c) for c in (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
_PLAIN = re.compile(r"([\n\r]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z")
_workers: dict[str, Encoder] = {}


def _visible_bytes() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in kept)
    return {b: 256 + i for i, b in enumerate(others)}


_VISIBLE = _visible_bytes()


class _Known(dict):
    """Chunk to packed ids; asks ``learn`` for an unseen chunk."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        data = self[chunk] = self.learn(chunk)
        return data


class Encoder:
    """Encodes texts to packed ids; ``dtype`` is uint16 where all ids fit."""

    def __init__(self, path: str, room: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        self.room, self.known, self.older, self.pre = room, _Known(self._learn), {}, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        if self.kind == "whole":
            yield from self._encode(texts)
            return
        for text in texts:
            chunks = self._chunks(text)
            if chunks is None:
                yield self._encode([text])[0]
                continue
            if len(self.known) > self.room // 2:
                self.older, self.known = self.known, _Known(self._learn)
            yield b"".join(map(self.known.__getitem__, chunks))

    def _learn(self, chunk: str) -> bytes:
        """Ids of an unseen chunk; those of the last generation of the table are kept if they come again."""
        data = self.older.get(chunk)
        if data is None:
            data = self._plain(chunk)
        return self._encode([self._spelt(chunk)])[0] if data is None else data

    def _plain(self, chunk: str) -> bytes | None:
        """Ids of letters of the Latin-1 block with an optional line break before and marks after, or None.

        Such a chunk is at most a line break, a word and a run of marks, each a
        pre-token of its own, which goes to the library's model directly.
        """
        match = _PLAIN.match(chunk)
        if match is None:
            return None
        first, word, marks = match.groups()
        if self.kind == "dropped":
            word, head = word.lower(), b""
        elif first == "\n":
            head = self._pre("\n")
        else:
            head, word = b"", word if first else " " + word
        data = None
        if marks and not first:
            data = self.known.get(word.lstrip(" "))
        data = head + (self._pre(word) if data is None else data)
        return data + self._pre(marks) if marks else data

    def _pre(self, text: str) -> bytes:
        """Ids of one pre-token."""
        data = self.pre.get(text)
        if data is None:
            data = array(self.code, [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(_VISIBLE))]).tobytes()
            if len(text) <= 4:
                self.pre[text] = data
        return data

    def _chunks(self, text: str) -> list[str] | None:
        if self.kind == "dropped":
            return text.replace("\n", " ").split(" ")
        if not text:
            return []
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in _ODD_SPACE):
            return None
        chunks = text.replace("\n", " \n").split(" ")
        chunks[0] = "\r" + chunks[0]  # no text that comes here has this character
        return chunks

    def _spelt(self, chunk: str) -> str:
        if self.kind == "dropped" or chunk[0] == "\n":
            return chunk
        return chunk[1:] if chunk[0] == "\r" else " " + chunk


def _kind(spec: dict) -> str:
    """leading: a space opens the next chunk; dropped: white space gives no ids; whole: neither is known."""
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "leading"
    parts = pre.get("pretokenizers") or [{}]
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = parts[0]
    if split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in parts[1:]] == ["ByteLevel"] and not parts[1].get("add_prefix_space"):
        return "dropped" if r"\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "") else "whole"
    return "whole"


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; its table of chunks lives as long as the worker."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def packed_documents(batch, path: str, end_id: int, limit: int = 1 << 21):
    """(id, packed ids with the end id) of every row with columns id and text; null: empty text."""
    enc = encoder(path)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    ids, texts = batch.column("id").to_pylist(), batch.column("text")
    at = 0
    while at < len(ids):
        part, room = [], limit
        while at < len(ids) and (room > 0 or not part):
            text = texts[at].as_py() or ""
            room -= len(text)
            part.append((ids[at], text))
            at += 1
        for (doc, _), data in zip(part, enc.packed([t for _, t in part])):
            yield doc, data + end
