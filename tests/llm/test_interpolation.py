import math
import random
import zlib
from collections import Counter

import numpy as np
from bibliarium.llm import interpolation
from tests.llm.brute import NASTY, WORD, lower

L = interpolation.LEVELS


def frame(spark, rows):
    return spark.createDataFrame([(i, t, True, 5) for i, t in rows], "doc_id long, text string, held boolean, score int")


def remainder(i):
    return zlib.crc32(str(i).encode()) % 7


class Plain:
    """Counts of some documents, and the estimates of a token from them."""

    def __init__(self, docs):
        self.n = [Counter(tuple(([0, 0, *d])[k + 2 - j : k + 3]) for d in docs for k in range(len(d))) for j in range(3)]
        self.documents, self.tokens = len(docs), sum(map(len, docs))

    def estimates(self, d, k, types):
        x = [0, 0, *d]
        gram = [tuple(x[k + 2 - j : k + 3]) for j in range(3)]
        one = self.documents if k == 0 else self.n[0][(d[k - 1],)]
        two = self.documents if k == 0 else self.n[1][tuple(x[k : k + 2])]
        level = L + min(two.bit_length(), L - 1) if two else min(one.bit_length(), L - 1)
        return level, [1 / (types + 1), self.n[0][gram[0]] / max(self.tokens, 1), self.n[1][gram[1]] / one if one else 0, self.n[2][gram[2]] / two if two else 0]


def brute(rows):
    docs = [[*WORD.findall(lower(t or "")), None] for _, t in rows]
    kind = [remainder(i) for i, _ in rows]
    every, rest = Plain([d for d, k in zip(docs, kind) if k != 2]), Plain([d for d, k in zip(docs, kind) if k not in (2, 3)])
    types = len(every.n[0])
    held = [rest.estimates(d, k, types) for d, x in zip(docs, kind) if x == 3 for k in range(len(d))]
    first = interpolation.start_weights()
    w = first.copy()
    for _ in range(20):
        total = 1e-3 * first
        for level, p in held:
            share = w[level] * p
            total[level] += share / max(share.sum(), 1e-300)
        w = total / total.sum(1, keepdims=True)
    return docs, kind, every, types, w


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t[:3000]) for i, t in rows] + [(5000 + i, t) for i, t in enumerate(NASTY)]
    docs, kind, every, types, w = brute(rows)
    joined, m, without = interpolation.counted(frame(spark, rows).repartition(4), interpolation.held_out("doc_id"), interpolation.deleted("doc_id"))
    assert joined.count() > 2 and (m.tokens, m.types, m.documents) == (every.tokens, types, every.documents)
    m = interpolation.fit(joined, m, without)
    assert np.allclose(m.weights, w, rtol=1e-6) and np.allclose(m.weights.sum(1), 1) and not m.weights[0, 2] and not m.weights[:L, 3].any()
    got = {r.doc_id: r for r in interpolation.score(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, _), d, k in zip(rows, docs, kind):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k == 2, len(d), sum(every.n[0][(x,)] > 0 for x in d), every.tokens)
        assert math.isclose(r.base_score, sum(math.log10((every.n[0][(x,)] + 1) / (every.tokens + types + 1)) for x in d), rel_tol=1e-9)
        want = sum(math.log10(w[level] @ p) for level, p in (every.estimates(d, j, types) for j in range(len(d))))
        assert math.isclose(r.score, want, rel_tol=1e-6)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_long_texts_and_copies(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(i, long if i % 10 == 0 else "a b c " * (i % 7)) for i in range(60)]
    got = {r.doc_id: r for r in interpolation.score(frame(spark, rows)).collect()}
    assert all(got[i].n_tokens == len(t.split()) + 1 and math.isfinite(got[i].score) for i, t in rows)
    assert len({round(got[i].score, 6) for i in range(0, 60, 10)}) == 1


def test_mixture_sums_to_one(spark):
    rows = [(i, "a b a c " * (i % 5) + "d") for i in range(60)]
    _, _, every, types, _ = brute(rows)
    joined, m, without = interpolation.counted(frame(spark, rows), interpolation.held_out("doc_id"), interpolation.deleted("doc_id"))
    m = interpolation.fit(joined, m, without)
    for a, b in (("b", "a"), ("a", "b"), ("a", "c")):
        words = [*every.n[0], ("unseen",)]
        p = 10 ** m.log10([np.array([every.n[j][((a, b)[2 - j :] + w)] for w in words]) for j in range(3)], [np.full(len(words), every.n[0][(b,)]), np.full(len(words), every.n[1][a, b])])
        assert abs(p.sum() - 1) < 1e-9


def test_weights_climb_the_likelihood():
    rng = np.random.default_rng(1)
    level, n = rng.integers(L + 1, L + 5, 400), rng.integers(1, 50, 400)
    p = np.stack([np.full(400, 1e-3), rng.random(400) ** 4, rng.random(400) ** 2, np.where(rng.random(400) < 0.5, 0, rng.random(400))], axis=1)
    w, like = interpolation.start_weights(), []
    for _ in range(20):
        like.append(float(n @ np.log((w[level] * p).sum(1))))
        w = interpolation.renewed(interpolation.step(w, level, p, n))
    assert like == sorted(like)


def test_no_training_tokens_null_ids_empty(spark):
    i = next(i for i in range(100) if remainder(i) == 2)
    r = interpolation.score(frame(spark, [(i, "a b")])).collect()[0]
    assert r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)
    rows = interpolation.score(frame(spark, [(None, "a b"), (1, None), (1, "a b")])).collect()
    assert sorted((x.doc_id or -1, x.n_tokens) for x in rows) == [(-1, 3), (1, 1), (1, 3)]
    assert interpolation.score(frame(spark, [])).count() == 0


def test_base_is_the_scores_own_from_counts_of_words_alone(spark):
    rows = [(r.doc_id, r.text[:500]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + [(5000 + i, t) for i, t in enumerate(NASTY)] + [(None, "a b"), (None, None)]
    got = interpolation.base(frame(spark, rows))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, interpolation.score(frame(spark, rows)).drop("score").collect()))
    joined, _, _ = interpolation.counted(frame(spark, rows), interpolation.held_out("doc_id"), interpolation.deleted("doc_id"), order=1)
    assert not {"c1", "c2"} & set(joined.columns)
    assert interpolation.base(frame(spark, [])).count() == 0
