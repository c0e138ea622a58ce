"""Every registered query, as it is registered, over whole tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from bibliarium.llm import mixing, pii, quality, queries, secrets
from tests.llm.brute import WORD, quality_counts
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def spans_of(text):
    return [(k, int(s), int(e)) for k, s, e in (x.rsplit(":", 2) for x in text.split(",") if x)]


def test_op1_adds_what_the_models_tell(spark, texts, tmp_path):
    """With random strings that no pattern takes, and identifiers, put between the words of some documents."""
    import math
    import random
    import re

    rng = random.Random(9)
    odd = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(rng.randint(18, 60))) for _ in range(30)] + ["the_ordinary_identifier_of_something", "another-name-of-some-words-in-a-row"]
    texts = texts | {9000 + k: f"some words {x} and {x[:12]} then {rng.choice(odd)}, more" for k, x in enumerate(odd)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = [float(x) for x in secrets.train(secrets.samples(docs)).split(",")]
    added = 0
    for r in queries.op1_secret_scan(spark, str(tmp_path)).collect():
        t, spans = texts[r.doc_id], spans_of(r.spans)
        base = [x for x in spans if x[0] != "markov"]
        want = []
        for m in re.finditer(secrets.RUN, t):
            at = [0, *(secrets.ALPHABET.index(c) + 1 for c in m[0])]
            ratio = math.fsum(model[a * secrets.SIZE + b] for a, b in zip(at, at[1:])) / len(m[0])
            if ratio > 0.8 and not any(s < m.end() and m.start() < e for _, s, e in base):
                want.append(("markov", m.start(), m.end()))
        assert [x for x in spans if x[0] == "markov"] == want and r.n_markov == len(want)
        assert len(base) == r.n_assign + r.n_access + r.n_hex
        added += len(want)
        assert not want or not any(x in t[s:e] for x in odd[-2:] for _, s, e in want)
    assert added >= 25


def test_op2_takes_blocks_in_their_order_within_budgets(spark, texts):
    """The selection by itself: whole epochs, then blocks in the last epoch's order, then documents of one block while they fit."""
    rows = mixing.counted(spark.read.parquet(f"{SF}/documents.parquet"))
    facts = {r.doc_id: r for r in rows.collect()}
    total = defaultdict(int)
    for r in facts.values():
        total[r.source] += r.n_tokens
    plan = {x["source"]: x for x in mixing.plan(list(total.items()), 0.97, 4.0, 1.0).sources}
    got = defaultdict(set)
    block = {}
    for r in queries.op2_mixing(spark, SF).collect():
        assert (r.doc_id, r.epoch) not in got[r.source] and r.n_tokens == facts[r.doc_id].n_tokens
        got[r.source].add((r.doc_id, r.epoch))
        block[r.doc_id] = r.block
    from pyspark.sql import functions as F

    order = {(r.b, r.e): r.h for r in spark.range(1024).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("e")).select("b", "e", F.xxhash64("b", "e", F.lit(1)).alias("h")).collect()}
    keys = {r.doc_id: (r.b, r.k) for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(1)), F.lit(1024)).alias("b"), F.xxhash64("doc_id", "text_hash", F.lit(2)).alias("k")).collect()}
    for s, x in plan.items():
        mine = [i for i, r in facts.items() if r.source == s]
        want = {(i, e) for i in mine for e in range(x["whole"])}
        left, e = x["rest"], x["whole"]
        blocks = defaultdict(list)
        for i in mine:
            blocks[keys[i][0]].append(i)
        for b in sorted(blocks, key=lambda b: (order[b, e], b)):
            if left <= 0:
                break
            size = sum(facts[i].n_tokens for i in blocks[b])
            used = 0
            for i in sorted(blocks[b], key=lambda i: (keys[i][1], i)):
                used += facts[i].n_tokens
                if size <= left or used <= left:
                    want.add((i, e))
            left -= size
        assert got[s] == want, s
        assert all(block[i] == keys[i][0] for i, _ in got[s])


def test_op3_walks_every_tree(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    counts = {r.doc_id: r for r in quality.features(docs).collect()}
    x = quality.matrix({k: np.array([c[k] for c in counts.values()]) for k in quality.COUNTS})
    by_hand = dict(zip(counts, (walk(model, row) for row in x)))
    rows = queries.op3_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert abs(r.probability - by_hand[r.doc_id]) < 1e-9 and r.kept == (not r.base_failed and r.probability >= 0.5)


def walk(model, row):
    """One row down every tree, a node at a time."""
    total = model.base
    for root in model.roots:
        node = int(root)
        while model.left[node] != node:  # a leaf leads to itself
            node = int(model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node])
        total += model.value[node]
    return 1 / (1 + np.exp(-total))


def test_op4_reads_the_library_s_ids_back(spark, texts):
    from tokenizers import Tokenizer

    own, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_ids(spark, SF).collect()}
    for i in sorted(texts):
        ids = [*own.encode(texts[i], add_special_tokens=False).ids, 2]
        assert got.pop(i) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_op5_keeps_base_spans(spark, texts):
    for r in queries.op5_personal_data(spark, SF).collect():
        base = pii.base_spans(texts[r.doc_id])
        spans = spans_of(r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert {(pii.KINDS[k], s, e) for k, s, e in base} <= set(spans)


def test_op6_counts_near_fingerprints(spark, texts):
    rows = queries.op6_fingerprints(spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert set(prints) == set(texts)
    for r in rows:
        near = sum((prints[r.doc_id] ^ p).bit_count() <= 3 for p in prints.values())
        assert r.n_near == (near if r.doc_id % 20 == 0 else None)
    assert any((r.n_near or 0) > 1 for r in rows)


def test_op7_as_the_library(spark, texts):
    import tiktoken
    from bibliarium.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op7_byte_bpe(spark, SF).collect():
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op8_scores_every_document(spark, texts):
    rows = queries.op8_lm_score(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(WORD.findall(t)) + 1 for i, t in texts.items()}
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pipeline_is_registered(spark):
    assert queries.QUERIES["pipeline"](spark, SF).count() > 0
