import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from bibliarium.llm import bpe, wavelet
from bibliarium.llm.common import shared_path
from tests.llm.brute import NASTY

SF = "/root/testdata/sf0.001/documents.parquet"
ODD = [*NASTY, "aaaa" * 3000, " " * 5001, "\n \n\n  x \t y", "\x1c a\x1c\x1c b\x85c\xa0 d　e  f \n g", "don't I'll 'squote' x's' A'S"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 5, "y") for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string, start int, ids string")


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = spark.read.parquet(SF).select("text").toPandas()["text"].tolist() + ODD
    got = bpe.encode(frame(spark, texts), path, pattern)
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].ids for i in range(len(texts))] == [other.encode_ordinary(t or "") for t in texts]
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(got, path, pattern).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(frame(spark, []), path, pattern).count() == 0


def plain_merge(ranks, match):
    """The lowest rank first, of equal ones the leftmost, one pair at a time."""
    parts = [bytes([b]) for b in match]
    while match not in ranks:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[match]] if match in ranks else [ranks[p] for p in parts]


def test_queue_equals_plain_merging():
    enc = bpe.Encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(4)
    words = ["".join(rng.choice("aeiorstn lhdé\n") for _ in range(rng.randint(1, 40))).encode() for _ in range(3000)]
    words += [b"a" * 200, b"ab" * 150, b" " * 301]
    words = [w for w in words if w not in enc.ranks]
    ids, count = enc.merge(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [plain_merge(enc.ranks, w) for w in words]


@pytest.mark.parametrize("seed", range(40))
def test_queue_with_ranks_in_any_order(seed):
    """Ranks under which a merge makes a pair of a lower rank than its own."""
    rng = random.Random(seed)
    made = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(60)})
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(made)}
    enc = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    words = [w for w in (bytes(rng.choice(b"abc") for _ in range(rng.randint(7, 80))) for _ in range(60)) if w not in ranks] + [b"a" * 100, b"abc" * 40]
    ids, count = enc.merge(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [plain_merge(ranks, w) for w in words]


def test_wavelet_round_trip(spark):
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(vocabulary)
    texts = spark.read.parquet(SF).select("text").toPandas()["text"].tolist() + ODD
    ids = random.Random(2).sample(range(10_000), len(texts))
    shards = wavelet.encode(frame(spark, texts, ids), vocabulary, shared_path(spark, "test"), shard_ids=20_000)
    assert shards.count() > 5
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.directory(shards).collect()}
    want, at = {}, 0
    for i, t in sorted(zip(ids, texts)):
        e = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
        at += len(e)
    assert got == want


def test_added_tokens_as_in_whole_texts(spark):
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    own, t = Tokenizer.from_file(vocabulary), "<|endoftext|>"
    texts = [f"a {t} b", f"a{t}b", t, t + t, f" {t} ", f"<|{t}|>", f"a\n{t}\n\nb", "x <|endof", "text|> y", f"é{t}日本 {t}", "a b", None, f"{'word ' * 400}{t} end", "<|endoftext |>"]
    shards = wavelet.encode(frame(spark, texts).coalesce(1), vocabulary, shared_path(spark, "test"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.directory(shards).collect()}
    want, at = {}, 0
    for i, x in enumerate(texts):
        e = [*own.encode(x or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
        at += len(e)
    assert own.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert got == want


def test_null_and_repeated_ids(spark):
    df = frame(spark, ["b", "a", None, "a"], [3, 3, None, None])
    shards = wavelet.encode(df, public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "test"))
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in wavelet.directory(shards).collect())
    assert rows == [(0, None, 1), (1, None, 2), (3, 3, 2), (5, 3, 2)]
    empty = wavelet.encode(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "test"))
    assert wavelet.directory(empty).count() == 0


def test_folders_lie_in_the_default_file_system(spark, tmp_path):
    """A folder without a scheme is where Spark looks for it, not on the disk of whichever machine runs the task."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert wavelet.qualified(spark, "/a b/c") == wavelet.qualified(spark, "file:///a b/c") == wavelet.qualified(spark, "file:/a b/c") == "/a b/c"
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.shards.link./in", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://shards")
    try:
        assert wavelet.qualified(spark, "/in/x") == "viewfs://shards/in/x" and wavelet.qualified(spark, f"file://{tmp_path}") == str(tmp_path)
    finally:
        conf.set("fs.defaultFS", before)
    for unknown in ("s3a://b/x", "dbfs:/x", "ftp://h/x"):
        with pytest.raises(ValueError):
            wavelet.encode(frame(spark, ["a"]), public_tokenizers.path("byte_bpe_50k.json"), unknown)


@pytest.mark.parametrize("block", [1 << 16, 512])
def test_wavelet_access_rank_select(monkeypatch, block):
    monkeypatch.setattr(wavelet, "BLOCK", block)
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.4, 3000) % 300).astype(np.uint32)
    m = wavelet.open_bytes(wavelet.image(ids, np.zeros(1, np.int64), np.ones(1, bool), np.array([3000])))
    assert (m.ids() == ids).all()
    for i in range(0, 3000, 7):
        assert m.access(i) == ids[i] and m.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum() and m.select(int(ids[i]), m.rank(int(ids[i]), i)) == i
    assert m.occurrences(5) == np.flatnonzero(ids == 5).tolist() and m.count(5, 100, 900) == (ids[100:900] == 5).sum()
    assert m.count(9999) == 0 and m.count(5) == (ids == 5).sum()
    with pytest.raises(IndexError):
        m.select(5, 3000)
    with pytest.raises(IndexError):
        m.access(3000)


def test_calls_read_part_of_a_file(tmp_path):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, 1_000_000).astype(np.uint32)
    (tmp_path / "a.wmx").write_bytes(data := wavelet.image(ids, np.arange(2), np.ones(2, bool), np.array([400_000, 600_000])))
    m, read = wavelet.open_file(str(tmp_path / "a.wmx")), []
    m.read = (lambda f: lambda at, size: read.append(size) or f(at, size))(m.read)
    assert m.access(777_777) == ids[777_777] and m.count(int(ids[5])) == (ids == ids[5]).sum()
    assert m.select(int(ids[5]), 0) == np.flatnonzero(ids == ids[5])[0] and sum(read) < len(data) / 3
    assert (m.ids() == ids).all()
    with pytest.raises(ValueError):
        wavelet.open_bytes(b"no shard at all, whatever it holds, and long enough for a header")
