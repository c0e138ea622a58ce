import hashlib
import random

from bibliarium.llm import simhash
from tests.llm.brute import NASTY


def frame(spark, texts):
    return spark.createDataFrame([(3 * i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")


def test_edited_against_brute_force(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").toPandas()["text"].tolist() + NASTY
    df = frame(spark, texts).repartition(5)
    single = {r.doc_id: f"{r.fingerprint & (1 << 64) - 1:016x}" for r in simhash.fingerprint(df).collect()}
    got = {r.doc_id: r for r in simhash.edited(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, n, r = t or "", texts[(i + 1) % len(texts)] or "", got[3 * i]
        k = len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        assert r.fingerprint == single[3 * i] and r.next_fingerprint == single[3 * ((i + 1) % len(texts))]
        assert r.near_next == 1 - bin(int(r.fingerprint, 16) ^ int(r.next_fingerprint, 16)).count("1") / 64
    long = [r for i, r in got.items() if r.n_chars > 800]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long)
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(t or "", set()).add(got[3 * i].fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_one_document_and_none(spark):
    r = simhash.edited(frame(spark, ["ab cd"])).collect()[0]
    assert r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and r.near_next == 1
    assert simhash.edited(frame(spark, [])).count() == 0


def test_search_is_complete(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(10)] + [0, 0, 2**63]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)) + [(900, None)], "doc_id long, fingerprint long")
    for radius in (0, 1, 3):
        got = sorted((r.query_id, r.doc_id, r.distance) for r in simhash.search(df, df.where("doc_id % 5 = 0"), radius).collect())
        want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(prints) if i % 5 == 0 for j, b in enumerate(prints) if (a ^ b).bit_count() <= radius)
        assert got == want
