"""LM scoring (operator 8): deleted interpolation of n-gram estimates, mixed by context-frequency buckets.

Tokens are words (ASCII letters in lower case) and one end for each document. A token's probability mixes a uniform
share and its unigram, bigram and trigram maximum-likelihood estimates, with weights for each bucket of context
frequency (powers of two of the count of the two tokens before, or of the one before where the two are new). Weights
come from expectation-maximisation on held-out counts: a seventh of the training documents, by their ids, is taken off
the counts, and weights are those under which the counts of the others predict it best. The model then uses the counts
of all training documents. All documents count and all are scored.

Texts become pieces of token numbers once. Each piece asks for the counts of its distinct n-grams: sorted hashes go to
buckets by hash range, a bucket adds up what all pieces bring and answers each, and answers meet their piece again. So a
word that every document has reaches its bucket once for each piece. A round of expectation-maximisation is one pass
over the distinct counts of the held-out tokens, of which each piece hands on sums by bucket only.

Null and empty texts are the end alone. Repeated rows count each time. Null ids are in the training part. Without
training tokens every probability is uniform; without held-out ones all estimates weigh the same. An empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MULT, blocks, bucket_of, dealt, free, mix, narrow, pack, pack_sorted, span_hash, unpack, unpack_sorted, written
from .exchange import pieces, text_columns

END = np.uint64(0xE0D0E0D0E0D0E0D1)
ORDER = 3
LEVELS = 26
#: Bytes of what pieces ask that a bucket takes, about.
BUCKET_BYTES = 4 << 20
PIECE_SCHEMA = "ids binary, has_id binary, held binary, deleted binary, lengths binary, hashes binary, tokens binary, train_tokens bigint, train_docs bigint, deleted_tokens bigint, deleted_docs bigint, n_tokens bigint"


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def deleted(id_col: str) -> Column:
    """Training documents that the weights are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 3, F.lit(False))


def _piece(batches: list[pa.RecordBatch]) -> dict:
    words, lengths = [], []
    for b in blocks(iter(batches)):
        start, end, first = b.words()
        h = span_hash(b.prefix(LOWER), start, end)
        words.append(np.insert(h, first[1:], END))
        lengths.append(np.diff(first) + 1)
    held, off = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]).astype(bool) for k in (2, 3))
    off &= ~held
    ids = pa.chunked_array([b.column(0) for b in batches])
    n = np.concatenate(lengths)
    hashes, tokens = np.unique(np.concatenate(words), return_inverse=True)
    return {
        "ids": pack(pc.fill_null(ids, 0).to_numpy()), "has_id": pack(pc.is_valid(ids).to_numpy()), "held": pack(held), "deleted": pack(off), "lengths": pack(n),
        "hashes": pack_sorted(hashes), "tokens": pack(tokens.astype(np.uint32)), "n_tokens": int(n.sum()),
        "train_tokens": int(n[~held].sum()), "train_docs": int((~held).sum()), "deleted_tokens": int(n[off].sum()), "deleted_docs": int(off.sum()),
    }


def _grams(hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1 to `order` tokens: ascending hashes of a piece's distinct ones, and which of them each token ends.

    Before a document's first token stand as many starts as needed.
    """
    first = np.cumsum(lengths) - lengths
    out, start = [(hashes, tokens)], MULT[10]
    for n in range(1, order):
        h, place = out[-1]
        before = np.empty(len(tokens), np.int64)
        before[1:] = place[:-1]
        before[first] = len(h)
        keys, inverse = np.unique(before * np.int64(len(hashes) + 1) + tokens, return_inverse=True)
        made = mix(np.append(h, start)[keys // (len(hashes) + 1)] * MULT[11 + 2 * n] + hashes[keys % (len(hashes) + 1)] * MULT[12 + 2 * n])
        by = np.argsort(made)
        rank = np.empty(len(made), np.int64)
        rank[by] = np.arange(len(made))
        out.append((made[by], rank[inverse]))
    return out


def _count(hashes: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], int]:
    """For each list of hashes the counts (of each kind) of all lists together; how many hashes have a first count."""
    h = np.concatenate(hashes)
    order = np.argsort(h)
    lead = np.ones(len(h), bool)
    lead[1:] = h[order][1:] != h[order][:-1]
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(lead) - 1
    cut = np.cumsum([len(x) for x in hashes])[:-1]
    out, seen = [], None
    for c in counts:
        total = np.add.reduceat(np.concatenate(c).astype(np.int64)[order], np.flatnonzero(lead)) if len(h) else np.zeros(0, np.int64)
        seen = int((total > 0).sum()) if seen is None else seen
        out.append(np.split(total[of], cut))
    return out, seen


@dataclass
class Mixture:
    """Weights of the uniform, unigram, bigram and trigram estimates by bucket of context frequency, and what they need."""

    weights: np.ndarray
    tokens: int
    types: int
    documents: int

    def estimates(self, counts: list[np.ndarray], contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket, and the estimates in columns. counts: of the n-grams; contexts: of what stands before the token in the bigram and in the trigram."""
        one, two = contexts
        bits = lambda c: np.minimum(np.frexp(c.astype(float))[1], LEVELS - 1)
        level = np.where(two > 0, LEVELS + bits(two), bits(one))
        p = [np.full(len(one), 1 / (self.types + 1)), counts[0] / max(self.tokens, 1)]
        p += [np.where(c > 0, n / np.maximum(c, 1), 0.0) for n, c in zip(counts[1:], contexts)]
        return level, np.stack(p, axis=1)

    def log10(self, counts: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        level, p = self.estimates(counts, contexts)
        return np.log10((self.weights[level] * p).sum(1))


def start_weights() -> np.ndarray:
    """All estimates alike, but for those that a bucket has no context for: its first LEVELS are those of new pairs, its first that of new words."""
    w = np.ones((2 * LEVELS, 1 + ORDER))
    w[:LEVELS, 3] = 0
    w[0, 2] = 0
    return w / w.sum(1, keepdims=True)


def step(weights: np.ndarray, level: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected counts of each bucket and estimate, of tokens that occur n times."""
    share = weights[level] * p
    share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
    return np.stack([np.bincount(level, share[:, k], len(weights)) for k in range(share.shape[1])], axis=1)


def renewed(expected: np.ndarray) -> np.ndarray:
    """The next weights. A little of the first ones keeps buckets without tokens, and what was not seen, above zero."""
    total = expected + 1e-3 * start_weights()
    return total / total.sum(1, keepdims=True)


def _contexts(counts: list[np.ndarray], lengths: np.ndarray, documents: int) -> list[np.ndarray]:
    """Counts of the token before, and of the two tokens before."""
    first, out = np.cumsum(lengths) - lengths, []
    for c in counts[: ORDER - 1]:
        x = np.empty(len(c), np.int64)
        x[1:] = c[:-1]
        x[first] = documents
        out.append(x)
    return out


def counted(docs: DataFrame, held: Column, off: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, Mixture, tuple[int, int]]:
    """A written table of pieces with the training counts of each token's n-grams (of 1 to `order` tokens), and of the deleted documents' tokens also those in deleted documents;
    a mixture without learned weights; and how many tokens and documents are deleted."""
    table = pieces(docs, _piece, PIECE_SCHEMA, "tokens", [*text_columns(id_col, text_col), held.alias("held"), off.alias("deleted")])
    n = table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("train_tokens", "train_docs", "deleted_tokens", "deleted_docs", "n_tokens"))).first()
    many = max(8, math.ceil(6 * max(order - 1, 1) * n[4] / BUCKET_BYTES))  # about six bytes for each bigram and trigram, and for words less

    key = dealt(docs.sparkSession, many)
    none = pack_sorted(np.zeros(0, np.uint64)), pack(np.zeros(0, np.uint8))

    def answers_for(orders: list[int]) -> DataFrame:
        """What buckets answer about n-grams of some orders, by piece."""
        names = ["deal", "bucket", "piece", *(f"{x}{k}" for k in orders for x in "hcd")]
        answered = ["piece", "bucket", "types", *(f"{x}{k}" for k in orders for x in "cd")]

        def ask(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    lengths = unpack(row["lengths"])
                    train, gone = (np.repeat(x, lengths) for x in (~unpack(row["held"]), unpack(row["deleted"])))
                    cells: dict[int, dict[str, bytes]] = {}
                    for k, (h, place) in enumerate(_grams(unpack_sorted(row["hashes"]), unpack(row["tokens"]).astype(np.int64), lengths, max(orders) + 1)):
                        if k in orders:
                            counts = [narrow(np.bincount(place[x], minlength=len(h))) for x in (train, gone)]
                            edge = bucket_of(h, many)
                            for b in np.flatnonzero(np.diff(edge)).tolist():
                                lo, hi = edge[b], edge[b + 1]
                                cells.setdefault(b, {}).update({f"h{k}": pack_sorted(h[lo:hi]), f"c{k}": pack(counts[0][lo:hi]), f"d{k}": pack(counts[1][lo:hi])})
                    some = sorted(cells)
                    yield pa.record_batch([pa.array(key[some], pa.int32()), pa.array(some, pa.int32()), pa.array(np.full(len(some), row["piece"])), *(pa.array([cells[b].get(x) for b in some], pa.binary()) for x in names[3:])], names)

        def answer(t: pa.Table) -> pa.Table:
            out, types = [], 0
            for k in orders:
                h = [unpack_sorted(x or none[0]) for x in t.column(f"h{k}").to_pylist()]
                counts, seen = _count(h, [[unpack(x or none[1]) for x in t.column(f"{c}{k}").to_pylist()] for c in "cd"])
                types = seen if k == 0 else types
                out += [pa.array([pack(narrow(x)) for x in c], pa.binary()) for c in counts]
            return pa.table([t.column("piece"), t.column("bucket"), pa.array(np.full(t.num_rows, types)), *out], answered)

        asked = table.select("piece", "hashes", "tokens", "lengths", "held", "deleted").mapInArrow(ask, "deal int, bucket int, piece bigint, " + ", ".join(f"{x} binary" for x in names[3:]))
        asked = asked.repartition(many, "deal")  # a given number of tasks, which follows the data
        found = asked.groupBy("deal").applyInArrow(answer, "piece bigint, bucket int, types bigint, " + ", ".join(f"{x} binary" for x in answered[3:]))
        return written(found, "answers")  # what was asked goes before more is asked, and before answers meet their pieces

    asked = [answers_for(orders) for orders in ([*range(min(order, 2))], [*range(2, order)]) if orders]
    words = asked[0]
    types = words.groupBy("bucket").agg(F.max("types").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    answers = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), asked)
    made = ["ids", "has_id", "held", "deleted", "lengths", *(f"{x}{k}" for k in range(order) for x in "cd")]

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        right = right.sort_by("bucket")
        lengths = unpack(row["lengths"])
        gone = np.repeat(unpack(row["deleted"]), lengths)
        out = [row[k] for k in made[:5]]
        for k, (_, place) in enumerate(_grams(unpack_sorted(row["hashes"]), unpack(row["tokens"]).astype(np.int64), lengths, order)):
            c, d = (np.concatenate([unpack(v) for v in right.column(f"{x}{k}").to_pylist() if v is not None]) for x in "cd")
            out += [pack(narrow(c[place])), pack(narrow(d[place[gone]]))]
        return pa.table([pa.array([x], pa.binary()) for x in out], made)

    body = table.select("piece", "ids", "has_id", "held", "deleted", "lengths", "hashes", "tokens")
    joined = written(body.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(gather, ", ".join(f"{x} binary" for x in made)), "counts")
    free(table, *asked)
    return joined, Mixture(start_weights(), n[0], types, n[1]), (n[2], n[3])


def _counts(row: dict) -> list[np.ndarray]:
    return [unpack(row[f"c{k}"]).astype(np.int64) for k in range(ORDER)]


def fit(joined: DataFrame, m: Mixture, without: tuple[int, int], rounds: int = 20) -> Mixture:
    """m with weights learned from the deleted documents, whose tokens and documents (without) are taken off the counts."""
    rest = Mixture(m.weights, m.tokens - without[0], m.types, m.documents - without[1])
    names = ["level", *(f"p{k}" for k in range(1 + ORDER)), "n"]

    def collect(batches):
        """The distinct buckets and estimates of a piece's deleted tokens, and how often each occurs."""
        for batch in batches:
            for row in batch.to_pylist():
                lengths, gone = unpack(row["lengths"]), unpack(row["deleted"])
                at = np.repeat(gone, lengths)
                if not at.any():
                    continue
                counts = [c[at] - unpack(row[f"d{k}"]).astype(np.int64) for k, c in enumerate(_counts(row))]
                counts += _contexts(counts, lengths[gone], rest.documents)
                order = np.lexsort(counts)
                new = np.append(True, np.any([np.diff(c[order]) != 0 for c in counts], axis=0))
                some = order[new]
                level, p = rest.estimates([c[some] for c in counts[:ORDER]], [c[some] for c in counts[ORDER:]])
                n = np.diff(np.append(np.flatnonzero(new), len(order)))
                yield pa.record_batch([pa.array([pack(x)], pa.binary()) for x in (narrow(level), *(np.ascontiguousarray(x) for x in p.T), narrow(n))], names)

    cells = written(joined.select("lengths", "deleted", *(f"{x}{k}" for k in range(ORDER) for x in "cd")).mapInArrow(collect, ", ".join(f"{x} binary" for x in names)), "cells")
    weights = m.weights
    for _ in range(rounds):

        def expect(batches, weights=weights):
            total = np.zeros_like(weights)
            for batch in batches:
                for row in batch.to_pylist():
                    total += step(weights, unpack(row["level"]).astype(np.int64), np.stack([unpack(row[f"p{k}"]) for k in range(1 + ORDER)], axis=1), unpack(row["n"]))
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

        # 2 * LEVELS * 4 numbers of each task
        sums = [np.frombuffer(r["sums"]).reshape(weights.shape) for r in cells.mapInArrow(expect, "sums binary").collect()]
        weights = renewed(np.sum(sums, axis=0) if sums else np.zeros_like(weights))
    free(cells)
    return Mixture(weights, m.tokens, m.types, m.documents)


def _scored(joined: DataFrame, m: Mixture, order: int) -> DataFrame:
    """Sums over the tokens of each document; the mixture's only of counts of all orders."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"] + ["score"] * (order == ORDER)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, counts = unpack(row["lengths"]), [unpack(row[f"c{k}"]).astype(np.int64) for k in range(order)]
                at = np.cumsum(lengths) - lengths
                logs = [np.log10((counts[0] + 1) / (m.tokens + m.types + 1))]
                if order == ORDER:
                    logs.append(m.log10(counts, _contexts(counts, lengths, m.documents)))
                known = np.add.reduceat((counts[0] > 0).astype(np.int64), at)
                yield pa.record_batch([pa.array(unpack(row["ids"]), mask=~unpack(row["has_id"])), pa.array(unpack(row["held"])), pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(np.full(len(at), m.tokens)), *(pa.array(np.add.reduceat(x, at)) for x in logs)], names)

    types = ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    return joined.select("ids", "has_id", "lengths", "held", *(f"c{k}" for k in range(order))).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def score(docs: DataFrame, held: Column | None = None, off: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10, the mixture)."""
    joined, m, without = counted(docs, held_out(id_col) if held is None else held, deleted(id_col) if off is None else off, id_col, text_col)
    return _scored(joined, fit(joined, m, without), ORDER)


def base(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score()'s columns but the mixture's score: only words are counted, and no weights are learned."""
    joined, m, _ = counted(docs, held_out(id_col) if held is None else held, F.lit(False), id_col, text_col, order=1)
    return _scored(joined, m, 1)
