import math
from collections import Counter, defaultdict

import pytest
from bibliarium.llm import mixing
from tests.llm.brute import NASTY, WORD


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "b") for i, t, s in rows], "doc_id long, text string, source string, epoch int, block string")


def some(n=3000):
    return [(i, "word " * (i % 37), ["big", "big", "big", "big", "mid", "mid", "small", None][i % 8]) for i in range(n)] + [(90_000 + i, t, "odd") for i, t in enumerate(NASTY)] + [(5, "same row", "odd")] * 2


@pytest.mark.parametrize(("goal", "most", "budget"), [(0.97, 4.0, 1.0), (1.0, 2.0, 1.0), (0.5, 9.0, 2.5), (0.97, 4.0, None), (1.0, 1.5, None)])
def test_weights_and_budgets(spark, goal, most, budget):
    data = some()
    rows = mixing.counted(frame(spark, data))
    copies, plan = mixing.mix(rows, target_entropy=goal, most_epochs=most, budget=budget, blocks=16)
    tokens = Counter()
    for _, t, s in data:
        tokens[s] += len(WORD.findall(t or ""))
    assert {x["source"]: x["tokens"] for x in plan.sources} == dict(tokens)
    w = {x["source"]: x["weight"] for x in plan.sources}
    top = max(tokens.values())
    raw = {s: (t / top) ** plan.exponent for s, t in tokens.items()}
    assert all(abs(w[s] - raw[s] / sum(raw.values())) < 1e-9 for s in raw)
    limited = any(abs(x["budget"] / x["tokens"] - most) < 0.02 for x in plan.sources)
    assert limited or abs(mixing.entropy(list(w.values())) - goal * math.log(len(w))) < 1e-6 or plan.exponent == 1
    assert all(x["budget"] <= x["tokens"] * most + 1 for x in plan.sources)
    got = defaultdict(lambda: defaultdict(list))
    for r in copies.collect():
        got[r.source][r.epoch].append(r)
    docs = Counter(s for _, _, s in data)
    for x in plan.sources:
        own = got[x["source"]]
        for e in range(x["whole"]):
            assert len(own[e]) == docs[x["source"]]
        last = sum(r.n_tokens for r in own.get(x["whole"], []))
        assert last <= x["rest"] and x["rest"] - last <= 300
        assert all(0 <= r.slot <= 1 for rows_ in own.values() for r in rows_)
        if budget is None:
            assert x["whole"] >= 1


@pytest.mark.parametrize("budget", [1.0, 2.5, None])
def test_many_sources_alike(spark, monkeypatch, budget):
    rows = mixing.counted(frame(spark, some()))
    how = {"target_entropy": 0.97, "most_epochs": 4.0, "budget": budget, "blocks": 16}
    few, plan = mixing.mix(rows, **how)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    many, apart = mixing.mix(rows, **how)
    assert abs(plan.exponent - apart.exponent) < 1e-9 and not apart.sources
    key = lambda r: (r.doc_id or 0, r.source or "", r.text_hash, r.epoch, r.block, round(r.slot, 9), round(r.weight, 9))
    assert sorted(map(key, few.collect())) == sorted(map(key, many.collect()))


def test_large_sources_have_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    data = some()
    copies, plan = mixing.mix(mixing.counted(frame(spark, data)), blocks=4)
    rows = copies.collect()
    blocks = {s: {r.block for r in rows if r.source == s} for s in ("big", "small")}
    tokens = {x["source"]: x["tokens"] for x in plan.sources}
    assert all(4 < max(blocks[s]) < max(5, tokens[s] / 200 + 1) for s in blocks)


def test_a_budget_above_the_limit_is_an_error():
    for budget, most in ((6.0, 4.0), (None, 0.5)):
        with pytest.raises(ValueError):
            mixing.plan([("a", 100), ("b", 10)], 0.9, most, budget)


def test_draw_keeps_columns_and_all_documents(spark):
    data = some(400)
    df = frame(spark, data)
    out = mixing.draw(df, target_entropy=0.97, most_epochs=2.0, budget=None, blocks=8)
    assert out.columns == df.columns
    times = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert set(times) == set(data) and max(times[d] for d in set(data) if d[0] != 5) <= 2


def test_empty(spark):
    assert mixing.draw(frame(spark, [])).count() == 0
    out, plan = mixing.mix(mixing.counted(frame(spark, [(1, None, None), (2, "", "a")])))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]
