"""Byte-level BPE ids of many texts at once.

The tokenizer's own pre-tokenisation (contractions, words, numbers, other
runs, white space) is found for a whole batch by array operations over the
character classes. Each distinct piece is then encoded once by the tokenizer
and remembered, and ids are gathered. That gives the tokenizer's ids, since its
merges never cross a piece."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Characters of a batch that are split together, and distinct pieces that a worker remembers.
BLOCK_CHARS = 2_000_000
CACHE_PIECES = 1_000_000


@cache
def _class_table() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    # Unicode White_Space
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


@cache
def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if
    it is visible Latin-1, else the next unused one from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The pre-tokens of all texts, one after another, and which of them only
    mark the end of a text."""
    joined = "\0".join(texts) + "\0"
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = _class_table()[chars]
    kind[ends] = END
    before, after = np.full(len(kind), END, np.uint8), np.full(len(kind), END, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    space = kind == SPACE
    # the last white space before something stands alone, or joins what follows if it is a blank
    last = space & (after != SPACE) & (after != END)
    joins = last & (chars == 0x20)
    start = (kind != before) | last
    start[1:] &= ~joins[:-1]
    start[ends] = True
    quote = np.flatnonzero((chars == 0x27) & start & (kind == OTHER))
    if len(quote):
        padded = np.concatenate((chars, [0, 0, 0]))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & np.isin(one * 0x10000 + two, [ord(a) * 0x10000 + ord(b) for a, b in ("re", "ve", "ll")])
        for at, width in ((quote[short], 1), (quote[long], 2)):
            for k in range(1, width + 1):
                start[at + k] = False
            start[at + width + 1] = True  # the end mark follows at the latest
    at = np.flatnonzero(start)
    width = np.ones(len(chars), np.uint8)
    for limit in (0x80, 0x800, 0x10000):
        width += chars >= limit
    upto = np.zeros(len(chars) + 1, np.int32)
    np.cumsum(width, out=upto[1:])
    offsets = upto[np.append(at, len(chars))]
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(joined.encode()))
    return found, kind[at] == END


class Encoder:
    """Ids of texts by a byte-level BPE file, each text closed by `end_id`.
    A text that holds one of the file's added tokens is left to the tokenizer."""

    def __init__(self, path: str, end_id: int = 0):
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.known = end_id, {}
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        # a normalised token may match in other forms than its own
        self.plain = not any(t.content and t.normalized and self.tokenizer.normalizer for t in tokens)
        contents = sorted((re.escape(t.content) for t in tokens if t.content), key=len, reverse=True)
        self.added = re.compile("|".join(contents)) if contents else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids a text), each text's closing id included."""
        ids, counts, at = [], [], 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= BLOCK_CHARS):
                chars += len(texts[to])
                to += 1
            x, n = self._block(texts[at:to])
            ids.append(x)
            counts.append(n)
            at = to
        if not ids:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _holds_added(self, text: str) -> bool:
        return not self.plain or bool(self.added and self.added.search(text))

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = [k for k, t in enumerate(texts) if self._holds_added(t)]
        if not held:
            return self._pieced(texts)
        # the others keep their places; those texts come in between as empty ones
        special = set(held)
        ids, counts = self._pieced(["" if k in special else t for k, t in enumerate(texts)])
        rows = np.split(ids, np.cumsum(counts)[:-1])
        for k in held:
            rows[k] = np.array([*self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.end_id], ids.dtype)
        return np.concatenate(rows), np.array([len(r) for r in rows], counts.dtype)

    def _pieced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, closes = pieces(texts)
        coded = found.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            merge, letters = self.tokenizer.model.tokenize, _byte_letters()
            for w in new:
                known[w] = [t.id for t in merge(w.encode().decode("latin-1").translate(letters))]
        rows = [known[w] for w in words] + [[self.end_id]]
        sizes = np.array([len(r) for r in rows])
        flat = np.array([i for r in rows for i in r], np.uint32)
        begins = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy().copy()
        codes[closes] = len(words)
        each = sizes[codes]
        upto = np.cumsum(each)
        ids = flat[np.repeat(begins[codes] - (upto - each), each) + np.arange(upto[-1])]
        return ids, np.diff(upto[closes], prepend=0)


@cache
def encoder(path: str, end_id: int = 0) -> Encoder:
    """One per worker process; its memory of pieces lives on between tasks."""
    return Encoder(path, end_id)
