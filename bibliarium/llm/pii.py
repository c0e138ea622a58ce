"""Personal data (operator 5): fixed patterns, and a semi-Markov conditional random field over whole spans.

Words in which a digit or an at sign stands form islands, runs of such words. A segment of the model is up to
LONGEST words of an island, trimmed of punctuation, and is scored by features of the whole span (shape, digits,
checksum, grouping, the word before). segment() chooses the segmentation with the highest sum by dynamic programming
over bounded lengths, boundaries and types at once. Outside islands no segment can be an entity, so nothing is
lost there. Weights are learned by conditional likelihood (forward-backward) from generated labelled islands. Spans of
the patterns always stay; the model's are added where they overlap none of those. Offsets count code points; null and
empty texts have no spans; every row is scanned; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]
LONGEST = 5
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
# fixed values: the characters and patterns of the base
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TRIGGER = np.zeros(256, bool)
_TRIGGER[48:58] = _TRIGGER[64] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Each at sign with the local part before it and the domain after it: what a search from the left finds, in linear time."""
    out, last, p = [], 0, t.find("@")
    while p >= 0:
        start = last + len(t[last:p].rstrip(LOCAL))
        m = DOMAIN.match(t, p + 1) if start < p else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else p + 1
        p = t.find("@", last)
    return out


def ips(t: str) -> list[tuple[int, int]]:
    """Four parts at a time of the runs of digits and dots."""
    out = []
    for m in DOTTED.finditer(t):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        begin = []
        for p in parts:
            begin.append(at)
            at += len(p) + 1
        i = 0
        while i + 4 <= len(parts):
            blank = next((k for k in range(3, -1, -1) if not parts[i + k]), None)
            if blank is not None:
                i += blank + 1
                continue
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                out.append((begin[i], begin[i + 3] + len(parts[i + 3])))
            i += 4
    return out


def cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end), in that order."""
    return [(k, s, e) for k, find in enumerate((emails, ips, cards, phones)) for s, e in find(t)]


# --- the model ---
_GROUPED = re.compile(r"(\+?[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-][0-9]{4}")
_FOURS = re.compile(r"[0-9]{4}([ -][0-9]{4}){3}")
_DATE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}")
_CUES = {w: k for k, words in enumerate(("mail email e-mail", "ip host server address", "card visa mastercard credit", "phone tel call mobile fax telephone")) for w in words.split()}
N_FEATURES = 19


def trimmed(t: str, start: int, end: int) -> tuple[int, int]:
    """Without what punctuation stands around it."""
    s = t[start:end]
    cut = len(s) - len(s.lstrip("\"'[{<,;:.!?*#$%&|=/_-"))
    s = s[cut:].rstrip("\"'([{<,;:.!?*#$%&|]}>=/_-+@")
    if s.count("(") < s.count(")"):
        s = s.rstrip(")")
    if s.startswith("(") and s.count("(") > s.count(")"):
        s, cut = s[1:], cut + 1
    return start + cut, start + cut + len(s)


def span_features(s: str, words: int, before: str) -> np.ndarray:
    """Features of a whole candidate span of so many words, after a word."""
    digits = re.sub("[^0-9]", "", s)
    n = len(digits)
    cue = _CUES.get(before.lower().strip(":.,=("), -1)
    only = re.fullmatch(r"[+]?[0-9() .-]+", s) is not None
    at = s.find("@")
    mail = 0 < at and emails(s) == [(0, len(s))]
    dotted = ips(s) == [(0, len(s))]
    return np.array([
        1, mail, at >= 0, dotted, only, only and n < 7, only and 7 <= n <= 8, only and 9 <= n <= 15, only and n > 15,
        only and 13 <= n <= 19 and luhn(digits), _FOURS.fullmatch(s) is not None, s.startswith("+") and only, _GROUPED.fullmatch(s) is not None and "." not in s.strip("."),
        "(" in s and ")" in s and only, words > 1, _DATE.fullmatch(s) is not None, cue == 2 and only, cue == 3 and only, not only and at < 0,
    ], float)


def _segments(t: str, words: list[tuple[int, int]], before: str) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Candidates of an island: (first word, one past the last, start, end), and their features."""
    cand, rows = [], []
    for i in range(len(words)):
        prev = t[words[i - 1][0] : words[i - 1][1]] if i else before
        for j in range(i + 1, min(i + LONGEST, len(words)) + 1):
            s, e = trimmed(t, words[i][0], words[j - 1][1])
            cand.append((i, j, s, e))
            rows.append(span_features(t[s:e], j - i, prev) if e > s else np.zeros(N_FEATURES))
    return cand, np.array(rows).reshape(-1, N_FEATURES)


def _generated(rng: random.Random) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]:
    """An island with its words, and the entities among them (kind's place in KINDS, first word, one past the last)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + d(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 99)}{a}{b}{c}"])

    def mail() -> str:
        return f"{rng.choice(['ann', 'j.doe', 'x_1'])}{rng.choice(['', '.7', '42'])}@{rng.choice(['mail', 'corp-x'])}{rng.randint(1, 9)}.{rng.choice(['example.com', 'org', 'co.uk'])}"

    def plain() -> str:
        return rng.choice([d(rng.randint(1, 6)), d(rng.randint(9, 12)), d(15) + rng.choice("012"), f"{d(2)}.{d(2)}", f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"1.{d(1)}.{d(2)}", f"{d(2)}:{d(2)}", f"v{d(1)}", f"x{d(3)}y{d(2)}", f"${d(2)}.{d(2)}", f"@user{d(2)}", f"{d(3)}-{d(2)}", f"3{d(2)}.9{d(2)}.{d(3)}.{d(2)}", f"{d(4)}-{d(4)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}"])

    def fours() -> str:
        c = card()
        return rng.choice([c, " ".join(c[k : k + 4] for k in range(0, 16, 4)), "-".join(c[k : k + 4] for k in range(0, 16, 4))])

    text, words, gold = "", [], []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice([0, 1, 2, 3, 3, 4, 4, 4])
        s = [mail, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), fours, phone, plain][kind]()
        s = s + rng.choice(["", "", "", ",", ".", "%%%", "!!"])
        first = len(words)
        for w in s.split(" "):
            words.append((len(text), len(text) + len(w)))
            text += w + " "
        if kind < 4:
            gold.append((kind, first, len(words)))
    return text, words, gold


def _partition(scores: np.ndarray, cand: list[tuple[int, int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log sums over all segmentations; scores: log sum over labels for each candidate."""
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0
    for k in sorted(range(len(cand)), key=lambda k: cand[k][1]):
        forward[cand[k][1]] = np.logaddexp(forward[cand[k][1]], forward[cand[k][0]] + scores[k])
    for k in sorted(range(len(cand)), key=lambda k: -cand[k][0]):
        backward[cand[k][0]] = np.logaddexp(backward[cand[k][0]], backward[cand[k][1]] + scores[k])
    return forward, backward


def _scored(x: np.ndarray, w: np.ndarray, cand: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Scores by candidate and label; other is of one word only, and an entity is of some text."""
    s = x @ w.T
    s[[k for k, c in enumerate(cand) if c[1] - c[0] > 1], 0] = -np.inf
    s[[k for k, c in enumerate(cand) if c[3] <= c[2]], 1:] = -np.inf
    return s


@functools.cache
def train(n: int = 260, rounds: int = 60, rate: float = 0.5, l2: float = 2e-3, seed: int = 11) -> np.ndarray:
    """Weights (label by feature) by gradient ascent (Adagrad) on the conditional likelihood of n generated islands."""
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        t, words, gold = _generated(rng)
        cand, x = _segments(t, words, "")
        inside = {k for _, a, b in gold for k in range(a, b)}
        want = {(a, b): kind + 1 for kind, a, b in gold} | {(k, k + 1): 0 for k in range(len(words)) if k not in inside}
        y = np.zeros((len(cand), len(LABELS)))
        for k, c in enumerate(cand):
            if c[:2] in want:
                y[k, want[c[:2]]] = 1
        data.append((len(words), cand, x, y.T @ x))
    w, past = np.zeros((len(LABELS), N_FEATURES)), np.full((len(LABELS), N_FEATURES), 1e-6)
    for _ in range(rounds):
        grad = -l2 * n * w
        for size, cand, x, gold in data:
            s = _scored(x, w, cand)
            top = np.logaddexp.reduce(s, axis=1)
            f, b = _partition(top, cand, size)
            start, end = np.array([c[0] for c in cand]), np.array([c[1] for c in cand])
            grad += gold - np.exp(s + (f[start] + b[end] - f[size])[:, None]).T @ x
        past += grad**2
        w += rate * grad / np.sqrt(past)
    return w


def segment(t: str, words: list[tuple[int, int]], before: str, w: np.ndarray) -> list[tuple[int, int, int]]:
    """Entities of the best segmentation of an island, as (kind's place in KINDS, start, end)."""
    out = []
    n = len(words)
    best, back = np.full(n + 1, -np.inf), [None] * (n + 1)
    best[0] = 0
    step = 2000  # words whose candidates are held at a time
    for lo in range(0, n, step):
        part = words[lo : lo + step + LONGEST - 1]
        cand, x = _segments(t, part, before if not lo else t[words[lo - 1][0] : words[lo - 1][1]])
        s = _scored(x, w, cand)
        label = s.argmax(1)
        for k, (i, j, a, e) in enumerate(cand):
            if i >= step:
                break
            score = best[lo + i] + s[k, label[k]]
            if score > best[lo + j]:
                best[lo + j], back[lo + j] = score, (lo + i, int(label[k]), a, e)
    while n:
        i, y, a, e = back[n]
        if y:
            out.append((y - 1, a, e))
        n = i
    return out[::-1]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every document: counts and digest of the base spans, and all spans by kind, then start."""
    w = train()

    def run(batches):
        for b in blocks(batches):
            start, end, first = b.words()
            total = np.zeros(len(b.data) + 1, np.int64)
            np.cumsum(_TRIGGER[b.data], out=total[1:])
            hot = np.flatnonzero(total[end] > total[start])
            doc = np.searchsorted(first, hot, side="right") - 1
            lead = (b.data & 0xC0) != 0x80
            rows = {}
            edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
            for lo, hi in zip(edge, [*edge[1:], len(doc)]):
                d, mine = int(doc[lo]), hot[lo:hi]
                t = b.data[b.offs[d] : b.offs[d + 1]].tobytes().decode()
                point = np.zeros(b.offs[d + 1] - b.offs[d] + 1, np.int64)
                np.cumsum(lead[b.offs[d] : b.offs[d + 1]], out=point[1:])
                base = base_spans(t)
                taken = sorted((s, e) for _, s, e in base)
                added = []
                begins, ends = point[start[mine] - b.offs[d]].tolist(), point[end[mine] - b.offs[d]].tolist()
                cut = [0, *(np.flatnonzero(np.diff(mine) > 1) + 1).tolist(), len(mine)]
                for x, y in zip(cut, cut[1:]):
                    k = mine[x] - 1
                    before = b.data[start[k] : end[k]].tobytes().decode() if k >= first[d] else ""
                    added += segment(t, list(zip(begins[x:y], ends[x:y])), before, w)
                starts, stops = np.array([s for s, _ in taken]), np.maximum.accumulate(np.array([e for _, e in taken])) if taken else None
                free = [(k, s, e) for k, s, e in added if not taken or (i := int(np.searchsorted(starts, e))) == 0 or stops[i - 1] <= s]
                rows[d] = base, free
            cols = [[], [], [], [], [], [], []]
            for d in range(len(b)):
                base, free = rows.get(d, ((), ()))
                for k in range(4):
                    cols[k].append(sum(x[0] == k for x in base))
                text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
                cols[4].append(hashlib.sha256(text(base).encode()).hexdigest())
                cols[5].append(text(sorted([*base, *free])))
                cols[6].append(len(free))
            yield pa.record_batch([b.ids, *(pa.array(c, pa.string() if k in (4, 5) else pa.int64()) for k, c in enumerate(cols))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
