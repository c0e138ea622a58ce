import random

import pytest
from bibliarium.operators import grams
from bibliarium.operators.grams import GramIndex
from bibliarium.plans import search as S
from pyspark.sql import functions as F

FIELDS = ["title", "keywords", "description"]
AWKWARD = ["50% of_it", "back\\slash", "a\\%b", "Ünïcode ÀÉ", "İstanbul", "ΟΔΟΣ ΣΑΣ", "日本語の題", "🙂🙂🙂 face", "ab", "", " ", None, "line\nbreak here", "x" * 50_000, "aXbXc", "100%"]
ASKED = ["bolt", "BoLT ", "ab", "a", "", "%", "50%", "of_it", "o_t", "ck\\sl", "a\\%b", "\\", "ÀÉ", "àé", "istanbul", "İst", "οδος", "ΟΔΟΣ", "本語の", "🙂🙂🙂", "k\nbr", "xxx", "nothing of it", "a%c", "red%tin", "pol_shed", "title 7", "100%%", "e h_re"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    words = ["bolt", "tin", "polished", "Red", "green", "brass", "title"]
    rows = [(k, f"{rng.choice(words)} {rng.choice(words)} {k % 50}", rng.choice([None, "", "Bolt; nut", "steel"]), None if k % 3 else " ".join(rng.choices(words, k=4))) for k in range(600)]
    rows += [(1000 + k, t, None, t) for k, t in enumerate(AWKWARD)] + [(2000 + k, None, t, None) for k, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "id long, title string, keywords string, description string").repartition(5, "id").withColumn("authors", F.col("title")).withColumn("doi", F.concat(F.lit("10.1/"), "id")).withColumn("year", F.lit(2000))


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    odd = GramIndex(spark, root).add(table.where("id % 2 = 0"), [*FIELDS, "authors", "doi", "no such column"])
    return odd.add(table.where("id % 2 = 1"), [*FIELDS, "authors", "doi"])  # a segment more



def test_equals_the_scan(table, index):
    for k, text in enumerate(ASKED):
        for field, fields in (("all", FIELDS), ("author", ["authors"]))[: 1 + (k % 6 == 0)]:
            want = sorted(r.id for r in S.matching(table, text, field).select("id").collect())
            assert sorted(r.id for r in S.matching(index.rows(text, fields), text, field).select("id").collect()) == want, text


def test_few_rows_are_read_and_said(index):
    got = index.report("0.1/25", ["doi"])
    assert got["rows"] == 632 and got["candidates"] == 11 and got["read"] < 600
    assert index.report("no such text", FIELDS) == {"rows": 632, "read": 0, "candidates": 0}
    assert index.report("ab", FIELDS) == {"rows": 632, "read": 632, "candidates": 632}


def test_shuffled_where_candidates_have_no_bound(table, index, monkeypatch):
    monkeypatch.setattr(grams, "MOST_BROADCAST", 3)
    rows = index.rows("title", FIELDS)
    assert "Broadcast" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in S.matching(rows, "title").collect()) == sorted(r.id for r in S.matching(table, "title").collect())
    monkeypatch.setattr(grams, "MOST_BROADCAST", 10**6)
    monkeypatch.setattr(grams, "MOST_RANGES", 1)
    assert S.matching(index.rows("title", FIELDS), "title").count() == S.matching(table, "title").count()


def test_a_trigram_of_every_row_is_many_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "BLOCK_BITS", 4)
    own = GramIndex(spark, f"{tmp_path}/i").add(spark.range(1000).select("id", F.concat(F.lit("same "), F.col("id")).alias("title")), ["title"])
    lists = own._read("grams").where("gram = 'sam'").collect()
    assert len(lists) >= 1000 // 16 and max(r.n for r in lists) <= 16 and sum(r.n for r in lists) == 1000
    assert [r.id for r in own.rows("same 777", ["title"]).collect()] == [777]


def test_look_ups_go_to_the_lists_of_their_trigrams(index):
    lists = index._read("grams").where((F.col("field") == "doi") & F.col("gram").isin(["0.1"]))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(field,doi)" in plan and "EqualTo(gram,0.1)" in plan


def test_a_segment_that_was_not_finished_is_not_seen(spark, tmp_path):
    own = GramIndex(spark, f"{tmp_path}/i")
    with pytest.raises(FileNotFoundError):
        own.rows("abc", ["title"])
    own.add(spark.createDataFrame([("first title",)], "title string"), ["title"])
    spark.createDataFrame([("lost title", 5)], "title string, _row long").write.parquet(f"{tmp_path}/i/rows/000001")
    assert own.table().count() == 1 and own.rows("title", ["title"]).count() == 1
    own.add(spark.createDataFrame([("second title",), (None,)], "title string"), ["title"])
    assert own.table().count() == 3 and own.rows("title", ["title"]).count() == 2
    own.add(spark.createDataFrame([], "title string"), ["title"])
    assert own.table().count() == 3
    with pytest.raises(ValueError):
        own.add(spark.range(1).withColumnRenamed("id", "_row"), [])
