"""Quality rules (operator 3): gradient-boosted trees over document statistics, with monotonic constraints.

features() gives one row of statistics per document, null and empty texts giving zeros. fit() trains logistic
trees on a bounded sample of labelled rows; Trees.predict() walks all trees over all rows at once by flat node
arrays. judge() joins both: documents that fail the base rule, or whose predicted probability of being good is
below the threshold, get kept = false. Repeated rows are judged one by one; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, MULT, SPACE, Block, blocks, gram_bounds, grams, mix, ranges, repeated, slices, span_hash, unused

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, bool)
PUNCT[list(b"!?")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_marks", "n_distinct", "n_lines"]
#: Name and sense of each feature: +1 may only raise the probability of being good, -1 only lower it, 0 either.
FEATURES = [("log_words", 0), ("word_length", 0), ("symbol_rate", -1), ("dup_line_rate", -1), ("repeat_rate", -1), ("upper_rate", -1), ("digit_rate", -1), ("mark_rate", -1), ("distinct_rate", 0), ("words_per_line", 0)]
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def count(b: Block) -> list[np.ndarray]:
    """COUNTS of each document of a block."""
    start, end, first = b.words()
    n = len(b)
    prefix = b.prefix(BYTE)
    h = span_hash(prefix, start, end)
    doc = np.repeat(np.arange(n), np.diff(first)).astype(np.uint64)
    space = SPACE[b.data]
    at, of = ranges(*gram_bounds(first, 3))
    g = grams(h, 3)[at] if len(at) else np.zeros(0, np.uint64)
    hit = at[repeated(mix(g + of.astype(np.uint64) * MULT[62]))]
    covered = np.zeros(len(h) + 2, bool)
    for k in range(3):
        covered[hit + k] = True
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(covered[: len(h)], out=total[1:])
    distinct = np.unique(mix(h + doc * MULT[61]), return_index=True)[1]
    # lines: the documents' edges and the newlines cut the bytes
    newline = np.flatnonzero(b.data == 10)
    owner = np.searchsorted(b.offs, newline, side="right") - 1
    begin = np.concatenate([b.offs[:-1], newline + 1])
    whose = np.concatenate([np.arange(n), owner])
    by = np.lexsort((begin, whose))
    begin, whose = begin[by], whose[by]
    stop = np.empty_like(begin)
    if len(begin):
        stop[:-1] = begin[1:] - 1
        stop[-1] = b.offs[-1]
        last = np.append(whose[1:] != whose[:-1], True)
        stop[last] = b.offs[1:][whose[last]]
    solid = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(~space, out=solid[1:])
    full = solid[stop] > solid[begin]
    begin, stop, whose = begin[full], stop[full], whose[full]
    line = mix(span_hash(prefix, begin, stop) + whose.astype(np.uint64) * MULT[60])
    _, seen = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[seen] = False
    lead = (b.data & 0xC0) != 0x80
    return [x.astype(np.int64) for x in (
        np.diff(first), b.per_doc(lead & ~space), b.per_doc(SYMBOL[b.data]), np.bincount(whose[again], minlength=n), np.diff(total[first]),
        b.per_doc(lead), b.per_doc(UPPER[b.data]), b.per_doc(DIGIT[b.data]), b.per_doc(PUNCT[b.data]), np.bincount(doc[distinct].astype(np.int64), minlength=n), np.bincount(whose, minlength=n))]


def _counts(batches):
    for b in blocks(batches):
        yield pa.record_batch([b.ids, *map(pa.array, count(b))], ["doc_id", *COUNTS])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every document."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_counts, SCHEMA)


def matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The model's features, one column each, from columns of counts."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_distinct"] / words, c["n_words"] / lines])


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of being good of each row."""
        score = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            row = np.arange(len(part))[:, None]
            at = np.tile(self.roots, (len(part), 1))
            for _ in range(self.depth):
                at = np.where(part[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            score[lo : lo + 4096] += self.value[at].sum(1)
        return 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, sense: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: float = 5.0) -> Trees:
    """Newton boosting of logistic loss on histograms.

    A split on a feature with a sense is taken only if its leaf values keep to that sense; the middle of both then
    bounds every value below, so that whole trees, and their sum, are monotonic. Without rows, or with one class
    only, there are no trees and the base rate decides.
    """
    n, m = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]) if n else np.zeros((0, m), int)
    score = np.full(n, base)

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        todo = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            k, rows, low, high, d = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, None)
            for f in range(m) if d < depth else ():
                size = len(edges[f]) + 1
                gl, hl = np.cumsum(np.bincount(binned[rows, f], grad[rows], size))[:-1], np.cumsum(np.bincount(binned[rows, f], hess[rows], size))[:-1]
                gr, hr = g - gl, h - hl
                vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g**2 / (h + l2)
                gain[(hl < least) | (hr < least) | (sense[f] * (vr - vl) < 0)] = -np.inf
                if len(gain) and gain.max() > best[0]:
                    s = int(gain.argmax())
                    best = (gain[s], (f, s, vl[s], vr[s]))
            if best[1] is None:
                value[k] = rate * float(np.clip(g / (h + l2), low, high))
                score[rows] += value[k]
                continue
            f, s, vl, vr = best[1]
            mid = (vl + vr) / 2
            feature[k], threshold[k], left[k], right[k] = f, edges[f][s], node(), node()
            goes = binned[rows, f] <= s
            down, up = ((low, mid), (mid, high)) if sense[f] > 0 else ((mid, high), (low, mid)) if sense[f] < 0 else ((low, high), (low, high))
            todo += [(left[k], rows[goes], *down, d + 1), (right[k], rows[~goes], *up, d + 1)]
    return Trees(np.array(feature or [0]), np.array(threshold or [np.inf]), np.array(left or [0]), np.array(right or [0]), np.array(value or [0.0]), np.array(roots or [0]), base, depth)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> Trees:
    """Trees fitted on at most `sample` labelled documents: those whose ids hash lowest. Rows without a label are not used."""
    some = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    joined = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "_id")  # of at most `sample` rows of two numbers
    rows = features(joined, "_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).drop("_id").orderBy("doc_id", *COUNTS).limit(2 * sample).toPandas()
    return fit(matrix({c: rows[c] for c in COUNTS}), rows["_y"].to_numpy(float), [s for _, s in FEATURES], **how)


def verdict(c: dict[str, np.ndarray], model: Trees, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, probability and kept, from columns of counts."""
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    p = model.predict(matrix(c))
    return failed, p, ~failed & (p >= threshold)


def keep(docs: DataFrame, model: Trees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    names = docs.columns
    rest, lead = [F.col(f"`{c}`") for c in names if c != text_col], unused(names, "_first")

    def run(batches):
        for piece in slices(batches):
            c = dict(zip(COUNTS, count(Block(piece))))
            yield piece.filter(pa.array(verdict(c, model, threshold)[2])).drop_columns([lead])

    laid = docs.select(F.lit(0).alias(lead), F.col(f"`{text_col}`"), *rest)
    return laid.mapInArrow(run, laid.drop(lead).schema).select(*(f"`{c}`" for c in names))


def judge(counts: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, probability and kept to what features() gives."""

    def score(batches):
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in COUNTS}
            yield pa.record_batch([*b.columns, *map(pa.array, verdict(c, model, threshold))], [*b.schema.names, "base_failed", "probability", "kept"])

    return counts.mapInArrow(score, f"{SCHEMA}, base_failed boolean, probability double, kept boolean")
