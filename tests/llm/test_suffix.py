import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from bibliarium.llm import suffix, suffix_dedup
from tests.llm.brute import NASTY


def brute(texts, window=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        last = -1
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                for k in range(max(i, last + 1), i + window):
                    gone[k] = True
                last = i + window - 1
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_bytes int").repartition(parts, "doc_id")


def passages(rng, docs=60):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(n) for n in (20, 40, 45, 50, 60, 120)]
    out = [*NASTY, "x" * 199, "x" * 200, "x" * 201, "ab" * 150, line(30) * 4]
    for _ in range(docs):
        out.append(" ".join(rng.choice([line(rng.randint(1, 30)), rng.choice(shared), rng.choice(shared)[: rng.randint(1, 400)]]) for _ in range(rng.randint(1, 6))))
    return out + out[-5:] + [t.replace("a", "b", 1) for t in out[-8:]]


@pytest.mark.parametrize("hot", [2000, 1])
def test_dedup_equals_brute_force(spark, hot):
    texts = passages(random.Random(hot)) + spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").toPandas()["text"].tolist()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(frame(spark, texts, 5), hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sum(x[1] > 0 for x in got.values()) > 50


def test_null_and_repeated_ids_and_empty_tables(spark):
    t = "".join(random.Random(3).choice("abcdef gh") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t + "x"), (None, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup(df).collect())
    assert got == [(0, 0, 0, b""), (1, 300, 300, b""), (1, 301, 300, b"x"), (2, 0, 0, b"")]
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for k in range(300):
        b = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 80))) * rng.choice([1, 1, 3])
        d = np.frombuffer(b, np.uint8)
        sa = suffix.suffix_array(d)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = suffix.common_prefixes(d, sa, 24)
        for x, y in zip(sa, sa[1:]):
            n = next((i for i in range(min(len(b) - x, len(b) - y)) if b[x + i] != b[y + i]), min(len(b) - x, len(b) - y))
            assert shared[y] == min(n, 24)


def test_anchors_do_not_depend_on_what_stands_around():
    """Windows of equal bytes, whose least grams tie, in blocks of different sizes."""
    from bibliarium.llm.common import BYTE, Block
    import pyarrow as pa

    rng = random.Random(8)
    text = "".join(rng.choice(["ab" * 40, "abcdefghijklmnopq" * 9, "x" * 70, "".join(rng.choice("abc") for _ in range(60))]) for _ in range(40))
    own = {}
    for before in ("", "y" * 70_001, "z" * 3_000_000):
        b = Block(pa.record_batch([pa.array([1]), pa.array([before + text])], ["doc_id", "text"]))
        s, w, a = suffix_dedup._anchors(b.prefix(BYTE), b.offs, 200)
        at = {int(x) + k - len(before): int(y) - len(before) for x, n, y in zip(s, w, a) for k in range(n) if x + k >= len(before)}
        own.setdefault("first", at)
        assert at == own["first"] and len(at) == len(text) - 199


def test_equal_hashes_of_different_bytes(spark, monkeypatch):
    """Segments are told apart by their bytes where all their hashes are equal."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(230)
    texts = [word(150) + shared + word(150) for _ in range(6)] + [shared, shared]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    assert suffix_dedup._differ(raw, starts[:1], starts[1:2], np.array([380])).tolist() == [True]
    assert suffix_dedup._differ(raw, starts[[6, 6]], starts[[7, 0]], np.array([230, 230])).tolist() == [False, True]
    assert suffix_dedup._differ(raw, starts[:0], starts[:0], ends[:0]).tolist() == []
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 100)
    assert suffix_dedup._differ(raw, starts[[6, 6, 6]], starts[[7, 0, 7]], np.array([230, 230, 230])).tolist() == [False, True, False]
