"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified (S if smaller than the next, else L), the leftmost-smaller (LMS) substrings are sorted by
inducing, named, and sorted recursively where names repeat; sorted LMS suffixes then induce all others. Over bytes each
bucket's suffixes induce those before them in one numpy step; the reduced strings below, whose alphabets are large,
are sorted by the same procedure one suffix at a time.
"""

from __future__ import annotations

import numpy as np

from .common import MULT, U64, mix, powers


def _lms(is_s: np.ndarray) -> np.ndarray:
    at = is_s.copy()
    at[0] = False
    at[1:] &= ~is_s[:-1]
    return np.flatnonzero(at)


def _types(t: np.ndarray) -> np.ndarray:
    """True for S. The last symbol is the only 0."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32))).astype(np.int8)
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[np.minimum(at, max(n - 2, 0))] > 0, True) if n > 1 else np.ones(1, bool)


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes, induced from LMS suffixes that are in order within their buckets (t: 16-bit symbols, size: bucket sizes)."""
    n, k = len(t), len(size)
    head = np.cumsum(size) - size
    tail = head + size
    sa = np.full(n, -1, np.int64)
    by = lms[np.argsort(t[lms], kind="stable")]
    cut = np.searchsorted(t[by], np.arange(k + 1))
    fill = head.copy()
    for c in np.flatnonzero(size).tolist():
        done = head[c]
        while done < fill[c]:
            before = sa[done : fill[c]] - 1
            before = before[before >= 0]
            before = before[(t[before] == c) & ~is_s[before]]
            done = fill[c]
            sa[done : done + len(before)] = before
            fill[c] += len(before)
        own = sa[head[c] : fill[c]]
        before = (np.concatenate([own, by[cut[c] : cut[c + 1]]]) if cut[c + 1] > cut[c] else own) - 1
        before = before[before >= 0]
        before = before[~is_s[before] & (t[before] > c)]
        if len(before):
            to = t[before]
            order = np.argsort(to, kind="stable")
            to, before = to[order], before[order]
            each = np.bincount(to, minlength=k)
            sa[fill[to] + np.arange(len(to)) - (np.cumsum(each) - each)[to]] = before
            fill += each
    left = fill.copy()  # where L suffixes end in each bucket
    fill = tail.copy()
    sa[0], fill[0] = n - 1, 0
    for c in np.flatnonzero(size)[::-1].tolist():
        done = tail[c]
        while done > fill[c]:
            before = sa[fill[c] : done][::-1] - 1
            before = before[before >= 0]
            before = before[(t[before] == c) & is_s[before]]
            done = fill[c]
            sa[done - len(before) : done] = before[::-1]
            fill[c] -= len(before)
        before = np.concatenate([sa[fill[c] : tail[c]][::-1], sa[head[c] : left[c]][::-1]]) - 1
        before = before[before >= 0]
        before = before[is_s[before] & (t[before] < c)]
        if len(before):
            to = t[before]
            order = np.argsort(to, kind="stable")
            to, before = to[order], before[order]
            each = np.bincount(to, minlength=k)
            sa[fill[to] - 1 - np.arange(len(to)) + (np.cumsum(each) - each)[to]] = before
            fill -= each
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The name of each LMS substring, lms being in text order and order giving them sorted; equal ones share one."""
    up, down = powers(len(t))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(t.astype(np.uint64) + MULT[30]) * up)])
    end = np.minimum(np.append(lms[1:], lms[-1]) + 1, len(t))
    h = mix((sums[end] - sums[lms]) * down[lms] + (end - lms).astype(np.uint64) * MULT[31])
    names = np.empty(len(lms), np.int64)
    sorted_h = h[order]
    names[order] = np.concatenate([[0], np.cumsum(sorted_h[1:] != sorted_h[:-1])])
    return names


def _small(t: list[int], k: int) -> list[int]:
    """The same procedure over a list of symbols below k, whose last is the only 0."""
    n = len(t)
    if n < 3:
        return list(range(n - 1, -1, -1)) if n < 2 or t[0] > t[-1] else list(range(n))
    s = bytearray(n)
    s[n - 1] = 1
    for i in range(n - 2, -1, -1):
        s[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and s[i + 1])
    lms = [i for i in range(1, n) if s[i] and not s[i - 1]]
    size = [0] * k
    for c in t:
        size[c] += 1

    def induce(seeds: list[int]) -> list[int]:
        heads, tails, at = [0] * k, [0] * k, 0
        for c in range(k):
            heads[c] = at
            at += size[c]
            tails[c] = at
        sa, end = [-1] * n, tails[:]
        for i in reversed(seeds):
            end[t[i]] -= 1
            sa[end[t[i]]] = i
        for p in range(n):
            j = sa[p] - 1
            if j >= 0 and not s[j]:
                sa[heads[t[j]]] = j
                heads[t[j]] += 1
        for p in range(n - 1, -1, -1):
            j = sa[p] - 1
            if j >= 0 and s[j]:
                tails[t[j]] -= 1
                sa[tails[t[j]]] = j
        sa[0] = n - 1
        return sa

    first = induce(lms)
    is_lms = bytearray(n)
    follow = {}
    for a, b in zip(lms, [*lms[1:], n - 1]):
        is_lms[a], follow[a] = 1, b + 1
    order = [i for i in first if is_lms[i]]
    name, last, names = 0, None, {}
    for i in order:
        if last is not None and t[last : follow[last]] != t[i : follow[i]]:
            name += 1
        names[i], last = name, i
    if name + 1 < len(lms):
        order = [lms[i] for i in _small([names[i] for i in lms], name + 1)]
    return induce(order)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffix array of bytes (or other symbols below 65,000)."""
    if not len(data):
        return np.zeros(0, np.int64)
    t = np.append(data.astype(np.uint16) + np.uint16(1), np.uint16(0))
    size = np.bincount(t)
    is_s = _types(t)
    lms = _lms(is_s)
    first = _induce(t, is_s, lms, size)
    place = np.full(len(t), -1)
    place[lms] = np.arange(len(lms))
    order = place[first]
    order = order[order >= 0]
    names = _names(t, lms, order)
    if names.max() + 1 < len(lms):
        order = np.array(_small(names.tolist(), int(names.max()) + 1), np.int64)
    return _induce(t, is_s, lms[order], size)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: at each place of the text, how much its suffix shares with the one before it in sa, up to `most` bytes."""
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.empty(n + most + 8, np.uint64)
    for r in range(8):
        m = (len(padded) - r) // 8
        words[r::8] = padded[r : r + 8 * m].view("<u8")[: len(words[r::8])]
    p = np.flatnonzero(phi >= 0)
    q = phi[p]
    for o in range(0, most, 8):
        differ = words[p + o] ^ words[q + o]
        end = differ != 0
        x = differ[end]
        out[p[end]] = o + (np.bitwise_count((x & (~x + U64(1))) - U64(1)) >> 3)
        p, q = p[~end], q[~end]
        if not len(p):
            break
    out[p] = most
    return np.minimum(out, np.minimum(most, n - np.maximum(np.arange(n), phi)))
