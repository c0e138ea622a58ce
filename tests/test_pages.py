import pytest
from bibliarium.plans import pages
from bibliarium.plans import search as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """120,000 rows: a year that holds a third, years that are null, titles of which one is in a third of that year's rows."""
    path = f"{tmp_path_factory.mktemp('pages')}/t"
    k = F.col("id")
    year = F.when(k % 3 == 0, 2004).when(k % 17 == 0, None).otherwise(1990 + k % 31).cast("int")
    title = F.when(k % 9 == 0, "the same").when(k % 101 == 0, None).otherwise(F.sha2(k.cast("string"), 256))
    spark.range(120_000).select(k, year.alias("year"), title.alias("title"), F.concat(F.lit("10.1/"), k).alias("doi")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("falls", [True, False])
def test_pages_equal_the_sorted_table(table, falls):
    order = [("year", falls), ("title", False), ("doi", False)]
    rows = [tuple(r) for r in table.orderBy(F.desc("year") if falls else F.asc("year"), "title", "doi").collect()]
    for offset, limit in [(0, 10), (60_000, 50), (47_013, 2500), (119_990, 50), (112_000, 100), (200_000, 10)]:
        page = pages.page_of(table, order, offset, limit, most=6000)
        assert [tuple(r) for r in page.rows.collect()] == rows[offset : offset + limit], offset
        assert page.total == 120_000 and page.sorted <= 9000 and page.levels <= 3


def test_ties_and_empty_tables(spark, table):
    same = table.where("id % 3 = 0").select("id", F.lit(5).alias("year"))
    page = pages.page_of(same, [("year", True)], 20_000, 7, most=100)
    assert page.rows.count() == 7 and page.total == 40_000 and page.levels == 2
    assert pages.page_of(table.where("false"), [("year", True)], 0, 5).rows.count() == 0
    nulls = pages.page_of(table.where("year IS NULL"), [("year", True), ("doi", False)], 3, 2, most=10)
    assert [r.doi for r in nulls.rows.collect()] == [r.doi for r in table.where("year IS NULL").orderBy("doi").limit(5).collect()][3:]


def test_deep_search_is_the_search(table):
    df = table.withColumns({"authors": F.lit("A, B"), "keywords": F.lit("k"), "description": F.col("title"), "repository": F.lit("r")})
    for sort in ("year", "oldest", "title"):
        page, total = S.search(df, "ab", limit=20, offset=30_000, sort=sort, year_from=1995)
        deep = S.search_deep(df, "ab", limit=20, offset=30_000, sort=sort, year_from=1995, most=3000)
        assert deep.rows.collect() == page.collect() and deep.total == total.first().total_count and deep.sorted <= 5000


@pytest.mark.parametrize("has_id", [True, False])
def test_ties_of_the_order_are_parted_the_same_way_on_all_pages(spark, has_id):
    """Rows of one title and no identifier, in tasks that hold them in another order: by id, or by what a page shows."""
    k = F.col("id")
    df = spark.range(3000).select(k, F.lit(2001).alias("year"), F.lit("t").alias("title"), F.concat(F.lit("A"), k % 2999).alias("authors"), F.lit(None).cast("string").alias("doi"))
    df = df.repartition(7, F.hash("id")) if has_id else df.repartition(7, F.hash("id")).drop("id")
    want = [f"A{i % 2999}" for i in range(3000)]
    want = want if has_id else sorted(want)
    for sort in ("year", "title"):
        got = [r.authors for at in (0, 10, 20) for r in S.search(df, limit=10, offset=at, sort=sort)[0].collect()]
        assert got == want[:30]
        assert [r.authors for r in S.search_deep(df, limit=30, offset=1500, sort=sort, most=100).rows.collect()] == want[1500:1530]
        assert S.search(df, limit=1)[0].columns == S.search_deep(df, limit=1).rows.columns == S.projected(df).columns
