"""Token ids of whole batches of texts, from a vocabulary file of the tokenizers library.

A byte-level BPE never merges across the pieces that its split pattern makes, and a corpus has few different pieces
for its size. So the split is done on arrays of code points, pieces are told apart by a dictionary encoding, and only
pieces that the worker hasn't met go through the library's model. Texts are cut at added tokens first (of several that
fit at a place at the longest), as the library does, so the ids are those of encode(add_special_tokens=False).
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from .textvec import ragged

#: Pieces that a worker remembers at most; later ones are encoded each time they occur in a batch.
MEMORY = 200_000
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
# White space as the split pattern has it, and the suffixes it splits off after an apostrophe.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[_SPACES] = _SPACE
    return out


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point. text_starts: where the non-empty texts begin."""
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)  # of a text, or the end of all
    first[text_starts] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    blank = points == 0x20
    # The last of several white-space characters before a word stands alone or goes with the word.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]
    start |= last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & blank[:-1]
    start &= ~joined
    # An apostrophe alone, not after a blank, takes a suffix from the letters behind it.
    quote = np.flatnonzero((points == 0x27) & start & change)
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    open_ = np.ones(len(quote), bool)
    for suffix in _SUFFIXES:
        k = len(suffix)
        at = np.minimum(quote[:, None] + 1 + np.arange(k), n - 1) if len(quote) else np.zeros((0, k), int)
        fits = open_ & (quote + k < n)
        fits &= (points[at] == np.array([ord(c) for c in suffix])).all(axis=1)
        for j in range(1, k):
            fits &= ~first[np.minimum(quote + 1 + j, n)]
        q = quote[fits]
        start[q + 1] = False
        after = q + 1 + k
        start[after[after < n]] = True
        open_ &= ~fits
    return start


class Encoder:
    """Ids of batches of texts; keeps what it has learnt between batches."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model, self.memory, self.vocabulary = tokenizer.model, memory, tokenizer.get_vocab_size()
        added = tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that take the space around them aren't supported")
        self.added = {t.content: i for i, t in added.items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.known: dict[str, int] = {}
        self.start, self.length, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = 0
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def _piece(self, piece: str) -> list[int]:
        if piece in self.added:  # only an added token itself is such a piece
            return [self.added[piece]]
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start and length of each piece's ids in an array of ids."""
        known, find = self.known, self.known.get
        at = np.fromiter((find(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        fresh = [self._piece(pieces[i]) for i in new.tolist()]
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        flat = np.fromiter((x for ids in fresh for x in ids), np.uint32, int(lengths.sum()))
        begin = np.cumsum(lengths) - lengths
        room = max(0, min(len(new), self.memory - len(known)))
        if room:
            taken = int(lengths[:room].sum())
            k = len(known)
            while self.used + taken > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while k + room > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.ids[self.used : self.used + taken] = flat[:taken]
            self.start[k : k + room], self.length[k : k + room] = begin[:room] + self.used, lengths[:room]
            known.update(zip((pieces[i] for i in new[:room].tolist()), range(k, k + room), strict=True))
            self.used += taken
        # Of this batch: what was known by its place in memory, the rest behind it.
        starts, sizes = self.start[at], self.length[at]
        starts[new], sizes[new] = begin + self.used, lengths
        return starts, sizes, np.concatenate([self.ids[: self.used], flat])

    def _added(self, texts: list[str], begins: np.ndarray) -> np.ndarray:
        """(start, end) of the added tokens in the texts put in a row."""
        found = [m.span() + (b,) for t, b in zip(texts, begins.tolist(), strict=True) if any(a in t for a in self.added) for m in self.marks.finditer(t)]
        return np.array([(s + b, e + b) for s, e, b in found], np.int64).reshape(-1, 2)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each text's."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        cuts = self._added(texts, begins)
        start = piece_starts(points, np.concatenate([begins[sizes > 0], cuts[:, 0], cuts[cuts[:, 1] < len(points), 1]]))
        start[ragged(cuts[:, 0] + 1, cuts[:, 1] - cuts[:, 0] - 1)] = False
        starts = np.flatnonzero(start)
        data = joined.encode()
        if len(data) == len(points):
            offsets = np.append(starts, len(data)).astype(np.int64)
        else:
            width = (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8) + np.uint8(1)
            offsets = np.append(0, np.cumsum(np.add.reduceat(width, starts, dtype=np.int64)))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        begin, length, ids = self._learn(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = pieces.indices.to_numpy()
        lengths = length[codes]
        out = ids[ragged(begin[codes], lengths)]
        # pieces per text, then ids per text
        bounds = np.searchsorted(starts, np.append(begins, ends[-1]))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return out, np.diff(total[bounds])


@cache
def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)
