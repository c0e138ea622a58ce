import numpy as np
from bibliarium.llm import whitening

ROW = "vec_id long, embedding array<float>"


def test_equals_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2).astype(np.float32)
    out = whitening.whiten(spark.createDataFrame([(k, v.tolist(), None) for k, v in enumerate(vectors)], ROW + ", component string").repartition(5)).toPandas()
    x = np.floor(vectors.astype(float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes[:, :8] / np.sqrt(values[:8])
    assert len(out) == 8 * n and set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-9
    for c in range(1, 9):
        some = out[out.component == c].sort_values("vec_id")
        w = some.whitened.to_numpy()
        w = w * np.sign(w @ want[:, c - 1])
        assert np.abs(w - want[:, c - 1]).max() < 1e-9 and abs(some.explained.iloc[0] - values[c - 1] / values.sum()) < 1e-12
        assert some.deviation.tolist() == np.square(n * x - s).sum(1).tolist()


def test_rows_that_are_not_fit_go(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [3e38, 0.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [3.0, 5.0])]
    out = whitening.whiten(spark.createDataFrame(rows, ROW)).collect()
    assert sorted((r.vec_id or -1, r.component, r.n) for r in out) == [(-1, 1, 4), (9, 1, 4), (9, 1, 4), (10, 1, 4)] and all(abs(r.explained - 1) < 1e-9 for r in out)


def test_no_variance_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, ROW)).collect() == []


def test_deviations_beyond_a_long_are_null_and_shares_hold(spark):
    rows = [(k, [1e7 * k, float(k % 3)]) for k in range(40)]
    out = whitening.whiten(spark.createDataFrame(rows, ROW)).collect()
    x = [[int(np.floor(np.float32(a) * 1024.0)) + 100000 for a in np.array(r[1], np.float32).astype(float)] for r in rows]
    s = [sum(c) for c in zip(*x)]
    want = {k: sum((40 * a - b) ** 2 for a, b in zip(v, s)) for k, v in enumerate(x)}
    assert any(w >= 2**63 for w in want.values()) and any(w < 2**63 for w in want.values()) or max(want.values()) >= 2**63
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in out) and abs(out[0].explained - 1) < 1e-4


def test_an_entry_s_floor_is_of_the_double(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [-0.0004]), (2, [0.0009]), (3, [0.001])], ROW), k=1).collect()
    x = {1: 99999, 2: 100000, 3: 100001}
    assert {r.vec_id: r.deviation for r in out} == {k: (3 * v - 300000) ** 2 for k, v in x.items()}
