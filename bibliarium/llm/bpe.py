"""Byte-level BPE (operator 7): encoding by merge ranks with a hierarchical-bitmap rank queue, and decoding.

Each match of the split pattern is merged by itself: positions of a doubly linked list of parts wait in one bucket per
merge rank, a bitmap of three levels tells the lowest rank that waits (find-first-set on each level), and positions
whose pair has changed since they were queued are skipped. One queue serves all matches of a batch, short or long: they
never touch, and no match has a pair of a rank below the lowest of all, so a popped bucket's positions merge together
in numpy. The cost is linear in the queued pairs whatever the length of the matches. Null and empty texts give no ids;
every row is encoded, repeated or not; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .pieces import Pieces, laid

#: Bytes of the matches that share a queue, unless one alone has more.
BATCH = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Ranks that have positions waiting. A rank's three digits of WIDTH bits index the bitmap's levels."""

    WIDTH = 7
    MASK = (1 << WIDTH) - 1

    __slots__ = ("top", "middle", "low", "buckets")

    def __init__(self):
        self.top, self.middle, self.low, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        a, b = rank >> 2 * self.WIDTH, rank >> self.WIDTH
        self.top |= 1 << a
        self.middle[a] = self.middle.get(a, 0) | 1 << (b & self.MASK)
        self.low[b] = self.low.get(b, 0) | 1 << (rank & self.MASK)

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        """The lowest rank with all its positions."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        bits = self.middle[a]
        b = a << self.WIDTH | (bits & -bits).bit_length() - 1
        bits = self.low[b]
        rank = b << self.WIDTH | (bits & -bits).bit_length() - 1
        self.low[b] = bits = bits & (bits - 1)
        if not bits:
            self.middle[a] &= ~(1 << (b & self.MASK))
            if not self.middle[a]:
                self.top &= ~(1 << a)
        return rank, self.buckets.pop(rank)


class Encoder:
    """Ids of texts by the ranks of a file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        top = max(ranks.values(), default=0)
        if top >> 3 * RankQueue.WIDTH:
            raise ValueError("ranks of over 21 bits")
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((u << 24 | v, r) for t, r in ranks.items() for k in range(1, len(t)) if (u := ranks.get(t[:k])) is not None and (v := ranks.get(t[k:])) is not None)
        self.keys, self.values = (np.array([p[k] for p in pairs] + [-2 if k else 1 << 62], np.int64) for k in range(2))
        # tokens that may make a pair of a lower rank than their own
        self.lower = np.zeros(top + 1, bool)
        for side in (self.keys[:-1] >> 24, self.keys[:-1] & 0xFFFFFF):
            self.lower[side[self.values[:-1] < side]] = True

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of what neighbouring parts make together; -1 for nothing, and wherever a part is -1."""
        want = a << 24 | b
        at = np.searchsorted(self.keys, want)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.values[at], -1)

    def merge(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches end to end, and how many each has."""
        size = np.fromiter(map(len, matches), np.int64, len(matches))
        n = int(size.sum())
        if not n:
            return np.zeros(0, np.int64), size
        part = np.append(self.single[np.frombuffer(b"".join(matches), np.uint8)], -1)  # what stands beyond an end makes no pair
        of = np.repeat(np.arange(len(matches)), size)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        edge = np.append(of[1:] != of[:-1], True)
        after[:-1][edge] = n
        before[1:][edge] = -1
        live, waits = np.ones(n, bool), np.full(n + 1, -1)
        queue = RankQueue()

        def push(at: np.ndarray) -> None:
            """Ascending positions, each under the rank of its pair."""
            waits[at] = r = self.pair_ranks(part[at], part[after[at]])
            keep = r >= 0
            at, r = at[keep], r[keep]
            if len(at) < 2:
                if len(at):
                    queue.push(int(r[0]), at)
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            begin = np.flatnonzero(np.append(True, r[1:] != r[:-1])).tolist()
            for lo, hi in zip(begin, [*begin[1:], len(at)]):
                queue.push(int(r[lo]), at[lo:hi])

        push(np.flatnonzero(~edge))
        while (got := queue.pop()) is not None:
            rank, waiting = got
            at = waiting[0] if len(waiting) == 1 else np.unique(np.concatenate(waiting))
            at = at[waits[at] == rank]  # the others are stale
            if not len(at):
                continue
            go = at
            # of positions whose pairs overlap, the leftmost goes and takes the next one's part
            clash = after[at[:-1]] == at[1:]
            if clash.any():
                lead = np.append(True, ~clash)
                run = np.arange(len(at))
                go = at[(run - np.maximum.accumulate(np.where(lead, run, 0))) % 2 == 0]
            if self.lower[rank]:
                go = self._until_lower(rank, go, part, after, before, of)
            gone = after[go]
            part[go], waits[gone], live[gone] = rank, -1, False
            follow = after[go] = after[gone]
            before[follow] = go  # that of the end says nothing
            left = before[go]
            push(np.unique(np.concatenate([go, left[left >= 0]])))
            if self.lower[rank]:
                again = at[(waits[at] == rank) & ~np.isin(at, go)]
                if len(again):
                    queue.push(rank, again)
        ids = part[:n][live]
        return ids, np.bincount(of[live], minlength=len(matches))

    def _until_lower(self, rank: int, go: np.ndarray, part: np.ndarray, after: np.ndarray, before: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of the positions to merge, those of each match up to the first whose merge makes a pair of a lower rank, which is to go first."""
        left = before[go]
        taken = np.zeros(len(part), bool)
        taken[after[go]] = True
        own = np.full(len(go), rank)
        low = np.zeros(len(go), bool)
        for r in (self.pair_ranks(np.where(taken[left] & (left >= 0), rank, part[left]), own), self.pair_ranks(own, part[after[after[go]]])):
            low |= (r >= 0) & (r < rank)
        if not low.any():
            return go
        match = of[go]
        first = np.full(int(match.max()) + 1, len(part))
        np.minimum.at(first, match[low], go[low])
        return go[go <= first[match]]

    def tokenise(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of text that begin and end where matches do."""
        matches = [[m.encode() for m in self.pattern.findall(p.decode())] for p in pieces]
        ids: dict[bytes, list[int]] = {}
        rest, size = [], 0

        def flush() -> None:
            flat, count = self.merge(rest)
            flat, ends = flat.tolist(), np.cumsum(count).tolist()
            ids.update(zip(rest, (flat[lo:hi] for lo, hi in zip([0, *ends], ends))))

        for m in {m for x in matches for m in x}:
            whole = self.ranks.get(m)
            if whole is not None:
                ids[m] = [whole]
                continue
            rest.append(m)
            size += len(m)
            if size > BATCH:
                flush()
                rest, size = [], 0
        if rest:
            flush()
        return [ids[x[0]] if len(x) == 1 else [i for m in x for i in ids[m]] for x in matches]

    def encode(self, text: str) -> list[int]:
        return self.tokenise([text.encode()])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple[str, str], tuple[Encoder, Pieces]] = {}


def encoder(path: str, pattern: str) -> tuple[Encoder, Pieces]:
    """One per worker process, vocabulary and pattern."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        enc = Encoder(read_ranks(path), pattern)
        _encoders[path, pattern] = enc, Pieces(lambda p: laid(enc.tokenise(p)), enc.tokens)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to), and with_ids also ids."""

    def run(batches):
        enc, pieces = encoder(path, pattern)
        decimal = [f"{i}" for i in range(max(enc.tokens, default=-1) + 1)]
        for b in blocks(batches, 3 << 20):
            ids, offs = pieces.encode(b)
            back = pieces.decode(ids).tobytes()
            size = np.concatenate([[0], np.cumsum(np.diff(pieces.byte_at)[ids])])[offs].tolist()
            names = list(map(decimal.__getitem__, ids.tolist()))
            at = offs.tolist()
            one = [hashlib.sha256(",".join(names[lo:hi]).encode()).hexdigest() for lo, hi in zip(at, at[1:])]
            two = [hashlib.sha256(back[lo:hi]).hexdigest() for lo, hi in zip(size, size[1:])]
            cols = [b.ids, pa.array(np.diff(offs), pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            yield pa.record_batch(cols + [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of each row's ids; null ids give null."""

    def run(batches):
        enc, _ = encoder(path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id bigint, decoded binary")
