"""Tokenising whole blocks of texts through the pieces that occur in them.

Split patterns of byte-level BPE never let a match run from ink into a blank or newline, nor from an ASCII letter into
ASCII punctuation. Texts are cut there in numpy, and only pieces whose hash is not known yet are tokenised. A second hash, of other byte values, tells pieces
apart whose first hashes are equal. Texts that hold a string which cuts could take apart are tokenised whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from .common import BYTE, MULT, U64, Block, flat, mix, span_hash

#: Pieces kept by each worker; beyond that it keeps the half that was used last.
KNOWN = 1_000_000
OTHER = mix(BYTE + MULT[0]) | U64(1)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_INK = np.zeros(256, bool)
_INK[33:127] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True


def laid(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of ids end to end, where each begins, and their lengths."""
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum())), np.cumsum(count) - count, count


def cuts(b: Block) -> np.ndarray:
    """Where pieces begin, each document's first included, and the end of all bytes."""
    d = b.data
    n = len(d)
    if not n:
        return np.zeros(1, np.int64)
    ink = _INK[d[:-1]]
    ink[1:] |= (d[1:-1] >= 0x80) & (d[:-2] == 0xC3)  # the letters from U+00C0 to U+00FF, and two signs
    at = np.zeros(n + 1, bool)
    at[1:-1] = ink & _BREAK[d[1:]] | _LETTER[d[:-1]] & _PUNCT[d[1:]]
    at[b.offs] = True
    return np.flatnonzero(at)


class Pieces:
    """tokenise: takes pieces as bytes, gives ids end to end, where each piece's begin, and how many it has. tokens: the bytes that each id stands for.

    uncut: strings that are seen in whole texts only; a text that holds one is tokenised as one piece.
    """

    def __init__(self, tokenise: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], tokens: dict[int, bytes], uncut: tuple[bytes, ...] = ()):
        self.tokenise, self.uncut = tokenise, uncut
        top = max(tokens, default=-1) + 1
        own = [tokens.get(i, b"") for i in range(top)]
        self.bytes = np.frombuffer(b"".join(own), np.uint8)
        self.byte_at = np.cumsum([0, *map(len, own)])
        self.size = np.diff(self.byte_at)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.others, self.begin, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.used, self.clock = np.zeros(0, np.int32), 0

    def _learn(self, hashes: np.ndarray, others: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces by their ascending, unknown hashes."""
        ids, begin, count = self.tokenise(pieces)
        begin = begin + len(self.pool)
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
        at = np.searchsorted(self.hashes, hashes)
        for name, values in (("hashes", hashes), ("others", others), ("begin", begin), ("count", count), ("used", self.clock)):
            setattr(self, name, np.insert(getattr(self, name), at, values))

    def _forget(self) -> None:
        """Keeps the KNOWN / 2 pieces that were used last."""
        keep = np.sort(np.argsort(self.used, kind="stable")[-(KNOWN // 2) :])
        self.hashes, self.others, self.used = self.hashes[keep], self.others[keep], self.used[keep]
        begin, self.count = self.begin[keep], self.count[keep]
        self.pool = self.pool[flat(begin, self.count)]
        self.begin = np.cumsum(self.count, dtype=np.int64) - self.count

    def _whole(self, b: Block, raw: bytes) -> np.ndarray:
        """The documents that hold one of the uncut strings; one that runs over a document's end is none."""
        found = set()
        for u in self.uncut:
            at = raw.find(u)
            while at >= 0:
                k = int(np.searchsorted(b.offs, at, side="right")) - 1
                if at + len(u) <= b.offs[k + 1]:
                    found.add(k)
                    at = raw.find(u, int(b.offs[k + 1]))
                else:
                    at = raw.find(u, at + 1)
        return np.array(sorted(found), np.int64)

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's documents end to end, and where each document's begin (one more at the end)."""
        edge, raw = cuts(b), b.data.tobytes()
        start, end = edge[:-1], edge[1:]
        h, other = span_hash(b.prefix(BYTE), start, end), span_hash(b.prefix(OTHER), start, end)
        order = np.argsort(h)
        lead = np.ones(len(h), bool)
        lead[1:] = h[order][1:] != h[order][:-1]
        first, each = order[lead], h[order[lead]]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(lead) - 1
        if len(self.hashes) > KNOWN:
            self._forget()
        self.clock += 1
        at = np.minimum(np.searchsorted(self.hashes, each), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != each if len(self.hashes) else np.ones(len(each), bool)
        if new.any():
            self._learn(each[new], other[first[new]], [raw[s:e] for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            at = np.searchsorted(self.hashes, each)
        self.used[at] = self.clock
        begin, count = self.begin[at][inverse], self.count[at][inverse]
        ids = self.pool[flat(begin, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        offs = total[np.searchsorted(start, b.offs)] if len(start) else np.zeros(len(b) + 1, np.int64)
        # two pieces with one hash: no text goes by its pieces
        whole = self._whole(b, raw) if np.array_equal(self.others[at][inverse], other) else np.arange(len(b))
        if len(whole):
            out = [ids[s:e] for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            for k in whole.tolist():
                out[k] = self.tokenise([raw[b.offs[k] : b.offs[k + 1]]] if b.offs[k + 1] > b.offs[k] else [])[0]
            return np.concatenate(out).astype(np.int32), np.cumsum([0, *map(len, out)])
        return ids, offs

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return self.bytes[flat(self.byte_at[ids], self.size[ids])]
