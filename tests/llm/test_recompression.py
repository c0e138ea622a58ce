import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from bibliarium.llm import recompression
from bibliarium.llm.common import pack, unpack
from tests.llm.brute import NASTY, WORD


def brute(texts, window):
    docs = [WORD.findall(t or "") for t in texts]
    often = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = {k for i in range(len(w) - window + 1) if often[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def got(spark, texts, window, parts=3):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in recompression.dedup(rows, window).collect()}


@pytest.mark.parametrize("window", [35, 12, 3, 1])
@pytest.mark.parametrize("letters", ["abc", [f"w{k}" for k in range(12)]])
def test_equals_brute_force(spark, window, letters):
    rng = random.Random(window)
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(30)]
    new = " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(100))
    texts += ["a " * 200, "a " * 90 + "b " * 80, "b " * 50 + "a " * 100, "a b " * 60, "b a " * 55, texts[3], texts[3] + " x y z", "q " + texts[5], "pre " + new, new + " post", new[:300], new.replace(" ", "\n\t"), *NASTY]
    assert got(spark, texts, window) == dict(enumerate(brute(texts, window)))


def test_long_texts_and_one_passage_in_most_documents(spark):
    rng = random.Random(3)
    shared = " ".join(f"s{rng.randint(0, 500)}" for _ in range(60))
    texts = [" ".join(f"v{rng.randint(0, 10**9)}" for _ in range(40)) + " " + shared + f" e{k}" for k in range(400)]
    texts += [" ".join(f"l{rng.randint(0, 300)}" for _ in range(60000)) + " " + shared, "run " * 30000, "x" * 200000]
    want = brute(texts, 35)
    assert got(spark, texts, 35, 7) == dict(enumerate(want)) and all(w[1] == 60 for w in want[:400])


def test_buckets_name_by_content_what_stands_twice():
    def cell(piece, rows, twice):
        a, ka, b, kb = (np.array(x, np.uint64) for x in zip(*rows))
        return {"deal": 0, "bucket": 5, "piece": piece, "a": pack(a), "b": pack(ka), "c": pack(b), "d": pack(kb), "twice": pack(np.array(twice))}

    rows = [cell(1, [(1, 1, 2, 1), (1, 2, 2, 1), (3, 4, 0, 0)], [False, False, True]), cell(2, [(1, 1, 2, 1), (1, 1, 2, 2)], [False, False])]
    told = {r["piece"]: unpack(r["told"]).tolist() for r in recompression._name_pairs(2)(pa.Table.from_pylist(rows)).to_pylist()}
    (same, alone, run), (again, other) = told[1], told[2]
    assert same == again != 0 and alone == other == 0 and run not in (0, same) and same >> 58 == 2 and same >> 32 & 0xFFFFFF == 5


def test_empty_table_null_ids_repeated_rows_and_extra_columns(spark):
    empty = recompression.dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"] and empty.count() == 0
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text, "a"), (7, text, "b"), (7, text, "c"), (8, " ".join(f"z{k}" for k in range(40)), None)]
    out = recompression.dedup(spark.createDataFrame(rows, "doc_id long, text string, piece string"), with_text=False)
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in out.collect()) == [(-1, 40, 40), (7, 40, 40), (7, 40, 40), (8, 40, 0)]
    with pytest.raises(ValueError):
        recompression.dedup(empty, 0)
