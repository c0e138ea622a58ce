import hashlib
import itertools
import random
import re

import numpy as np
from bibliarium.llm import pii
from tests.llm.brute import NASTY

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return (
        [(0, *m.span()) for m in EMAIL.finditer(t)]
        + [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        + [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    )


CASES = [
    *NASTY, "a@b.c@d.e x@y @z.w q@r..s a.b@c-d.e.f. é@x.yz ü a@b.c", "1.2..3.4.5.6 1.2.3.4.5.6.7.8.9 256.1.1.1 001.002.003.004 1.2.3 ....", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12345678901234567890",
    "+1 (487) 555-7209 call (487) 555-7209, or 487-555-7209. +12 +1(((((( +123456789 +1-2-3-4-5-6-7-8-9.", "🙂 ann@mail.example.com 🙂 +44 20 7946 0958!", "5.5.5.5 " * 50, "@" * 2000, "1" * 20_000, "a" * 20_000, "a." * 3000 + "@", "+" * 3000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_finders_equal_the_patterns():
    rng = random.Random(5)
    texts = [t for t in CASES if t and len(t) < 3000] + ["".join(rng.choice("01259. -+()@ab,é") for _ in range(rng.randint(1, 60))) for _ in range(20_000)]
    for t in texts:
        assert pii.base_spans(t) == base(t), t


def test_scan(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toPandas()["text"].tolist()
    n = len(texts)
    texts += CASES
    got = {r.doc_id: r for r in pii.scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t or "") if len(t or "") < 4000 or i < n else pii.base_spans(t)
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x[0] == k for x in want) for k in range(4))
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_added == len([x for x in got[i].spans.split(",") if x]) - len(want)
    assert sum(got[i].n_added for i in range(n)) <= n // 200
    call = CASES.index(next(t for t in CASES if t and "call (487)" in t))
    assert got[n + call].n_added >= 2
    assert pii.scan(frame(spark, [])).count() == 0


def test_dynamic_programme_is_optimal():
    w = np.random.default_rng(0).normal(size=(len(pii.LABELS), pii.N_FEATURES))
    rng = random.Random(3)
    for _ in range(30):
        t, words, _ = pii._generated(rng)
        words = words[:6]
        cand, x = pii._segments(t, words, "")
        s = pii._scored(x, w, cand)
        score = {c[:2]: s[k].max() for k, c in enumerate(cand)}
        n, best = len(words), -np.inf
        for cut in itertools.product([0, 1], repeat=n - 1):
            edges = [0, *(k + 1 for k, c in enumerate(cut) if c), n]
            best = max(best, sum(score.get((a, b), -np.inf) for a, b in zip(edges, edges[1:])))
        label = {(c[2], c[3], y): s[k, y] for k, c in enumerate(cand) for y in range(len(pii.LABELS))}
        found = pii.segment(t, words, "", w)
        free = [k for k, (a, b) in enumerate(words) if not any(a <= s_ < b or s_ <= a < e for _, s_, e in found)]
        total = sum(label[s_, e, k + 1] for k, s_, e in found) + sum(s[[c[:2] for c in cand].index((k, k + 1)), 0] for k in free)
        assert abs(total - best) < 1e-9


def test_held_out_accuracy():
    rng, right, wrong, missed = random.Random(99), 0, 0, 0
    w = pii.train()
    for _ in range(300):
        t, words, gold = pii._generated(rng)
        want = {(k, *pii.trimmed(t, words[a][0], words[b - 1][1])) for k, a, b in gold}
        got = set(pii.segment(t, words, "", w))
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    print(right, wrong, missed)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9
