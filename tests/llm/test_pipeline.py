from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from bibliarium.llm import bpe, mixing, partenum, quality
from tests.llm.brute import NASTY
from tests.llm.test_partenum import brute as components_of
from tests.llm.test_secrets import base as secrets_of

D = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    import tiktoken

    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    counts = {r.doc_id: r for r in quality.features(docs).collect()}
    failed = {i: c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words for i, c in counts.items()}
    p = dict(zip(counts, model.predict(quality.matrix({k: np.array([c[k] for c in counts.values()]) for k in quality.COUNTS}))))
    kept = [i for i in rows if not failed[i] and p[i] >= 0.5]
    assert 0.5 * len(rows) < len(kept) < len(rows)
    group = components_of([(i, rows[i].text) for i in kept], percent=80, n=5)
    kept = [i for i in kept if group[i][1] == i]

    def redacted(t):
        out, at = "", 0
        for s, _, e, _ in secrets_of(t):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        return out + t[at:]

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: other.encode_ordinary(redacted(rows[i].text)) for i in kept}
    got = corpus_pipeline.run(spark, D).collect()
    assert {r.doc_id: r.ids for r in got} == want
    times = Counter(r.doc_id for r in got)
    tokens = Counter()
    for i in kept:
        tokens[rows[i].source] += len(redacted(rows[i].text).split())
    plan = mixing.plan(list(tokens.items()), 0.97, 2.0, None)
    drawn = Counter()
    for i, n in times.items():
        assert 1 <= n <= 2
        drawn[rows[i].source] += n * len(redacted(rows[i].text).split())
    for x in plan.sources:
        assert x["budget"] - 1100 * 20 <= drawn[x["source"]] <= x["budget"] + 1


def test_stages_keep_columns_and_take_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(i, t, None, None, None) for i, t in enumerate(NASTY)] + [(None, good, "en", "a", 1), (900, good, "en", "a", 1), (900, good, "en", "a", 1), (901, good + " tail", None, "b", 2)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, D)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
        assert {r.doc_id for r in out} == ({None, 900} if data else set())


def test_one_of_each_keeps_what_has_no_set(spark):
    rows = [(1, "a b c d e f"), (1, "A b c d e f"), (2, "a b c d e f"), (3, ""), (3, None), (None, "a b c d e f"), (4, "other words stand in this one")]
    out = partenum.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in out) == [(-1, "a b c d e f"), (1, "A b c d e f"), (3, ""), (3, ""), (4, "other words stand in this one")]
