import random
from collections import defaultdict

import numpy as np
import pytest
from bibliarium.llm import partenum
from bibliarium.llm.components import components
from tests.llm.brute import NASTY, WORD, lower


def shingles(t, n=4):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85, n=4):
    """rows: (id, text) with distinct ids; gives id: (size, component, links)."""
    s = [shingles(t, n) for _, t in rows]
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    by, links = defaultdict(list), defaultdict(int)
    for k, x in enumerate(s):
        for f in x:
            by[f].append(k)
    pairs = {(a, b) for v in by.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        common = len(s[a] & s[b])
        if 100 * common >= percent * (len(s[a]) + len(s[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = root(rows[a][0]), root(rows[b][0])
            top[max(x, y)] = min(x, y)
    return {i: (len(s[k]), root(i), links[k]) for k, (i, _) in enumerate(rows)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, "n") for i, t in rows], "doc_id long, text string, node int, component string")


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        p = rng.randrange(len(w))
        w[p] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_join_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(NASTY)]
    for f in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 8, 12, 20, 40, 90, 300]))]
        rows += [(2000 + 100 * f + k, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, len(base) // 20]))) for k in range(12)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in partenum.join(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c, _ in want.values()}) < len(rows) - 150


def test_large_family_in_squares(spark, monkeypatch):
    monkeypatch.setattr(partenum, "SIDE", 40)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2]))) for i in range(150)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in partenum.join(frame(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
@pytest.mark.parametrize("common_words", [False, True])
def test_signatures_lose_no_link(percent, common_words):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 40), 64, 100, 250, 500, 900, 3000]:
        for _ in range(25):
            g = rng.integers(1, 2**63, size, dtype=np.uint64)
            drop = rng.integers(0, min(size, size * (100 - percent) // 50 + 2) + 1)
            other = np.concatenate([g[: size - drop], rng.integers(1, 2**63, rng.integers(0, drop + 2), dtype=np.uint64)])
            common = size - drop
            if not common or 100 * common < percent * (size + len(other) - common) or common == size == len(other):
                continue
            often = np.sort(g[: rng.integers(0, size + 1)]) if common_words else None
            sig, doc, _ = partenum.signatures(np.concatenate([np.sort(g), np.sort(other)]), np.array([0, size, size + len(other)]), percent, often)
            assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist())


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_empty_choices_are_hardly_told(percent):
    rng = np.random.default_rng(0)
    for size in (30, 50, 100, 300, 800, 2000, 6000, 20000):
        sizes = rng.integers(size, size * 5 // 4, max(20, 100_000 // size))
        _, _, tells = partenum.signatures(rng.integers(1, 2**63, int(sizes.sum()), dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)]), percent)
        assert tells.mean() <= 0.005, size


@pytest.mark.parametrize(("percent", "n"), [(80, 5), (85, 4)])
def test_few_links_of_unlike_sets(percent, n):
    """Of the links from each signature's documents to one of them, few are of sets that share less than a tenth."""
    import pyarrow.parquet as pq
    from bibliarium.llm.common import blocks

    of = {}
    for b in blocks(pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_batches()):
        g, begin, both = partenum.sets(b, n)
        of |= {h: g[x:y] for h, x, y in zip(both[:, 0].tolist(), begin, begin[1:]) if y > x}
    every = list(of.values())
    often = partenum._frequent(every, len(every))[0].view(np.uint64)
    sig, doc, _ = partenum.signatures(np.concatenate(every), np.cumsum([0, *map(len, every)]), percent, often)
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    lead = np.append(True, sig[1:] != sig[:-1])
    pairs = np.unique(np.stack([doc[lead][np.cumsum(lead) - 1], doc]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]].T.tolist()
    unlike = 0
    for a, b in pairs:
        common = len(np.intersect1d(every[a], every[b], assume_unique=True))
        unlike += common < 0.1 * (len(every[a]) + len(every[b]) - common)
    assert unlike < 0.05 * len(pairs), (unlike, len(pairs))


def test_repeated_null_and_empty(spark):
    rows = [(1, "a b c d e"), (1, "x y z w v"), (2, "x y z w v"), (None, "a b c d e"), (3, None), (3, None), (4, "A B C D E")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in partenum.join(frame(spark, rows)).collect())
    assert got == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3), (4, 2, 1)]
    assert partenum.join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("side", [512, 2])
def test_repeated_ids_with_other_texts(spark, monkeypatch, side):
    monkeypatch.setattr(partenum, "SIDE", side)
    rng = random.Random(5)
    a, b, c = ([f"{x}{k}" for k in range(60)] for x in "abc")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, edited(rng, b, 1)), (3, edited(rng, a, 1)), (4, edited(rng, a, 1)), (7, " ".join(c)), (7, edited(rng, c, 1)), (8, "other words stand here alone")]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id, r.n_links) for r in partenum.join(frame(spark, order)).collect())
        assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 1, 1), (7, 7, 1), (7, 7, 1), (8, 8, 0)]


def test_more_pieces_than_sets(spark, monkeypatch):
    monkeypatch.setattr(partenum, "SIDE_FEATURES", 20)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, edited(rng, base, 1)) for i in range(4)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in partenum.join(frame(spark, rows)).collect()}
    assert got == brute(rows) and any(n for _, _, n in got.values())


def test_square_with_an_empty_piece_has_no_links():
    import pyarrow as pa

    t = {"i": [0, 0], "j": [1, 1], "side": [0, 0], "node": [1, 2], "first_id": [1, 2], "weight": [1, 1], "features": [partenum.pack(np.arange(50, dtype=np.uint64))] * 2}
    assert partenum._compare(pa.table(t), 85).num_rows == 0
    assert partenum._compare(pa.table(t | {"j": [0, 0]}), 85).column("links").to_pylist() == [1, 1]


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 5, 6, 7), (2, "a b c d e f", 8, 9, 1), (3, "other words that stand here alone", 1, 2, 3), (3, "a b c d e f", 1, 1, 1), (None, None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _drop int, _row int, `a.b` int")
    got = partenum.one_of_each(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r._drop, r._row, r["a.b"]) for r in got.collect()) == [(0, 1, 2, 3), (1, 5, 6, 7)]


def test_components(spark):
    rng = random.Random(0)
    for links in ([(i, i + 1) for i in range(300)], [(rng.randrange(400), rng.randrange(400)) for _ in range(300)], [(0, i) for i in range(500)], [(1, None), (2, 2)]):
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        top = {}

        def root(i):
            while top.setdefault(i, i) != i:
                i = top[i]
            return i

        for a, b in links:
            if b is not None and a != b:
                a, b = root(a), root(b)
                top[max(a, b)] = min(a, b)
        assert got == {i: root(i) for i in list(top)}
