import numpy as np
from bibliarium.llm import quality
from tests.llm.brute import NASTY, quality_counts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words long")


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").toPandas()["text"].tolist() + NASTY
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(frame(spark, docs)).collect()}
    assert got == {i: quality_counts(t) for i, t in enumerate(docs)}


def test_empty_table(spark):
    assert quality.features(frame(spark, []).where("false")).count() == 0
    model = quality.train(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.judge(quality.features(frame(spark, ["a b"])), model).count() == 1


def test_monotonic_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) - x[:, 1] + 0.1 * rng.standard_normal(3000)) > 0).astype(float)
    model = quality.fit(x, y, [1, -1, 0])
    for f, sense in ((0, 1), (1, -1)):
        for _ in range(50):
            grid = np.tile(rng.random(3), (101, 1))
            grid[:, f] = np.linspace(0, 1, 101)
            assert (sense * np.diff(model.predict(grid)) >= -1e-12).all()
    assert ((model.predict(x) > 0.5) == y).mean() > 0.8


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(quality.features(docs), model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    print("kept of good", (good.probability >= 0.5).mean(), "base failed of good", good.base_failed.mean(), "rejected of bad", 1 - bad.kept.mean())
    assert (good.probability >= 0.5).mean() > 0.99
    assert 1 - bad.kept.mean() > 0.9
